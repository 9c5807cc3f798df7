"""Running sums in a global order, over ranges of it, and exact percentiles by histograms.

For running sums rows are put in order by range and written with the number of their range, so one key with most of all rows (or one
value that most rows share) is spread over as many tasks as there are ranges. Sums of whole ranges are few rows (keys
times ranges) and are cumulated by key; within a range, rows add up in its own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.plans.staging import staged


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name of sums, the sum over a key's rows up to this one (name) and over all of them (all_name).
    order must leave no ties that matter."""
    terms = {f"_{n}": e for n, e in sums.items()}
    placed = staged(rows.withColumns(terms).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    per = placed.groupBy(*keys, "_range").agg(*[F.sum(f"_{n}").alias(f"_r_{n}") for n in sums])
    upto, whole = W.partitionBy(*keys).orderBy("_range"), W.partitionBy(*keys)
    per = per.select(
        *keys, "_range", *[(F.sum(f"_r_{n}").over(upto) - F.col(f"_r_{n}")).alias(f"_b_{n}") for n in sums], *[F.sum(f"_r_{n}").over(whole).alias(f"all_{n}") for n in sums]
    )
    own = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(per, [*keys, "_range"]).withColumns({n: F.col(f"_b_{n}") + F.sum(f"_{n}").over(own) for n in sums})
    return out.select(*rows.columns, *sums, *[f"all_{n}" for n in sums])


#: Bins that a stretch of values is cut into, rows of a stretch that one task may put in order, most narrowing passes.
BINS, PICK_ROWS, PASSES = 4096, 1_000_000, 4


def _narrowed(values: DataFrame, state: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """One pass: the values of each stretch counted by bin, and of the bins those that hold a wanted rank."""
    v = F.col("v").cast("double")
    width = F.col("hi") * 0.5 - F.col("lo") * 0.5  # halves do not overflow
    inside = F.coalesce(F.floor(F.try_divide(v * 0.5 - F.col("lo") * 0.5, width) * BINS), F.lit(0).cast("long"))
    odd = {float("-inf"): -1, float("inf"): BINS, float("nan"): BINS + 1}
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), inside))
    for value, at in odd.items():
        place = F.when(v == F.lit(value), F.lit(at)).otherwise(place)
    met = values.join(state.select(*keys, "slot", "lo", "hi"), keys)
    met = met if first else met.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    counts = met.groupBy(*keys, "slot", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("n").over(W.partitionBy(*keys, "slot").orderBy("bin"))
    c = counts.join(state.select(*keys, "slot", "below", "ranks"), [*keys, "slot"]).withColumn("below", F.col("below") + upto - F.col("n"))
    held = F.filter("ranks", lambda r: (r["rank"] >= F.col("below")) & (r["rank"] < F.col("below") + F.col("n")))
    c = c.withColumn("ranks", held).where("size(ranks) > 0")
    return c.select(*keys, (F.col("slot") * (BINS + 3) + F.col("bin") + 1).alias("slot"), "lo", "hi", "n", "below", "ranks")


def _picked(values: DataFrame, state: DataFrame, keys: list[str], first: bool) -> DataFrame:
    """Ranks within stretches that are few rows, by the order of their values."""
    met = values.join(state.select(*keys, "slot", "lo", "hi"), keys)
    met = met if first else met.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    counts = met.groupBy(*keys, "slot", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*keys, "slot").orderBy("v"))
    c = counts.join(state.select(*keys, "slot", "below", "ranks"), [*keys, "slot"]).withColumn("below", F.col("below") + upto - F.col("n"))
    c = c.select(*keys, "n", "below", "v", F.explode("ranks").alias("r"))
    return c.where("r.rank >= below and r.rank < below + n").select(*keys, F.col("r.i").alias("i"), F.col("v").alias("value"))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n and p: the percentiles of a key's values, linear between neighbours.

    Histograms narrow in on the wanted ranks: a pass counts values by bin (counts are summed within tasks first) and keeps
    the bins with a wanted rank; where a bin holds one value, or the rank is its first or last, the bin's least or largest
    value is the answer. Once what is left of a stretch is few rows, their order gives the rest. Nothing is sorted as a
    whole, so neither a key nor a value with most of all rows meets in one task."""
    values = staged(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v")), "values")
    finite = F.when(F.abs(F.col("v").cast("double")) < float("inf"), F.col("v"))
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    wanted = [f((F.col("n") - 1) * F.lit(float(s))) for s in shares for f in (F.floor, F.ceil)]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, r in enumerate(wanted)])
    whole = staged(whole.withColumns({"ranks": ranks, "slot": F.lit(0).cast("long"), "below": F.lit(0).cast("long")}), "stretches")
    found, state = [], whole
    most = whole.agg(F.max("n")).first()[0]
    for nth in range(PASSES + 1):
        if most is None:
            break
        if most <= PICK_ROWS or nth == PASSES:
            found.append(_picked(values, state, keys, nth == 0))
            break
        cut = staged(_narrowed(values, state, keys, nth == 0), "stretches")
        r = cut.select(*keys, "slot", "lo", "hi", "n", "below", F.explode("ranks").alias("r"))
        first, last = F.col("lo").eqNullSafe(F.col("hi")) | (F.col("r.rank") == F.col("below")), F.col("r.rank") == F.col("below") + F.col("n") - 1
        r = r.withColumn("value", F.when(first, F.col("lo")).when(last, F.col("hi")))
        found.append(r.where("value is not null").select(*keys, F.col("r.i").alias("i"), "value"))
        state = r.where("value is null").groupBy(*keys, "slot", "lo", "hi", "n", "below").agg(F.collect_list("r").alias("ranks"))
        most = state.agg(F.max("n")).first()[0]
    every = values.select(*keys, F.lit(0).alias("i"), F.col("v").alias("value")).where("false")
    for more in found:
        every = every.unionAll(more)
    picked = [F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"_p{i}") for i in range(2 * len(shares))]
    out = every.groupBy(*keys).agg(*picked).join(whole.select(*keys, "n"), keys)

    def between(i: int, share: float) -> Column:
        at, low, high = (F.col("n") - 1) * F.lit(float(share)), F.col(f"_p{2 * i}"), F.col(f"_p{2 * i + 1}")
        return F.when(F.ceil(at) == F.floor(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*keys, "n", F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("p"))

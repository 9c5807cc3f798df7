"""Scene statistics of windows, layout vectors, and changes between neighbouring vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.functions.geometry import num
from curvetrail.functions.signals import robust_unit, top_share_mean


def _dims(t: DataFrame) -> DataFrame:
    """Frame size of each frame: the largest known, else the largest corner, 1 at least."""
    d = t.groupBy("video_id", "frame_id").agg(F.max("frame_w").alias("a"), F.max("frame_h").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"))
    known = (F.col("a") > 0) & (F.col("b") > 0)
    return d.select("video_id", "frame_id", F.when(known, F.col("a")).otherwise(F.greatest(num(1), "c")).alias("fw"), F.when(known, F.col("b")).otherwise(F.greatest(num(1), "d")).alias("fh"))


def frame_counts(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Objects and share of the frame that their boxes cover, of every frame (0 where there is none)."""
    sized = tracks.join(_dims(tracks), ["video_id", "frame_id"])
    per = sized.groupBy("video_id", "frame_id").agg(F.count("*").alias("n"), (F.sum("area") / F.max(F.greatest(num(1), F.col("fw") * F.col("fh")))).alias("density"))
    return frames.join(per, ["video_id", "frame_id"], "left").select("video_id", "idx", "frame_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("density", num(0)).alias("density"))


def scene_counts(tracks: DataFrame, frames: DataFrame, size: int = 8) -> DataFrame:
    """Current, mean, deviation (of the population) and change of count and density over each window."""
    w = W.partitionBy("video_id").orderBy("idx").rowsBetween(-(size - 1), 0)
    f = frame_counts(tracks, frames)
    cols = {}
    for c, name in (("n", "count"), ("density", "density")):
        v = F.col(c).cast("double")
        cols |= {f"cur_{name}": v, f"{name}_mean": F.avg(v).over(w), f"{name}_std": F.stddev_pop(v).over(w), f"{name}_delta": v - F.first(v).over(w)}
    return f.withColumns(cols).where(F.col("idx") >= size - 1).select("video_id", (F.col("idx") - (size - 1)).alias("window_id"), *cols)


def layout_cells(tracks: DataFrame, frames: DataFrame, grid: int = 4) -> DataFrame:
    """Where objects are on a grid, as sparse unit vectors: video_id, idx, cell, value. Cells 0 to grid^2 - 1 hold
    counts, the next grid^2 area shares, the last two the totals."""
    grid = max(2, grid)
    t = tracks.join(_dims(tracks), ["video_id", "frame_id"])
    place = lambda c, full: F.least(F.lit(grid - 1), F.greatest(F.lit(0), (F.col(c) / F.greatest(num(1), F.col(full)) * grid).cast("int")))
    share = F.col("area") / F.greatest(num(1), F.col("fw") * F.col("fh"))
    cell = place("cy", "fh") * grid + place("cx", "fw")
    per = t.select("video_id", "frame_id", cell.alias("c"), share.alias("a")).groupBy("video_id", "frame_id", "c").agg(F.count("*").cast("double").alias("k"), F.sum("a").alias("a"))
    n = grid * grid
    long = per.select("video_id", "frame_id", F.explode(F.array(
        F.struct(F.col("c").alias("cell"), F.col("k").alias("value")), F.struct((F.col("c") + n).alias("cell"), F.col("a").alias("value")),
        F.struct(F.lit(2 * n).alias("cell"), F.col("k").alias("value")), F.struct(F.lit(2 * n + 1).alias("cell"), F.col("a").alias("value")),
    )).alias("e")).groupBy("video_id", "frame_id", F.col("e.cell").alias("cell")).agg(F.sum("e.value").alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy("video_id", "frame_id"))) + 1e-6
    unit = long.withColumn("value", F.col("value") / norm)
    return unit.join(frames, ["video_id", "frame_id"]).select("video_id", "idx", "cell", "value")


def layout_vectors(cells: DataFrame, frames: DataFrame, grid: int = 4) -> DataFrame:
    """Dense arrays of layout_cells for every frame (zeros where there is no object)."""
    dim = 2 * max(2, grid) ** 2 + 2
    found = cells.groupBy("video_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], num(0)))
    return frames.join(found, ["video_id", "idx"], "left").select("video_id", "idx", F.when(F.col("m").isNull(), F.array_repeat(num(0), dim)).otherwise(vec).alias("embedding"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), num(0), lambda s, x: s + x)


def pair_errors(vectors: DataFrame, keys: list[str], order: str, embedding: str = "embedding", unit: bool = False) -> DataFrame:
    """How far each vector is from the one before it in its series: squared distance, 1 - cosine, and their sum; also
    distance and the change of the sum. The first of a series has none. unit: vectors already have length 1."""
    w = W.partitionBy(*keys).orderBy(order)
    v = vectors.select(*keys, order, F.col(embedding).cast("array<double>").alias("v")).withColumn("p", F.lag("v").over(w)).where("p is not null")
    cur, prev = F.col("v"), F.col("p")
    sq = F.aggregate(F.zip_with(cur, prev, lambda a, b: (a - b) * (a - b)), num(0), lambda s, x: s + x)
    norm = lambda x: F.sqrt(_dot(x, x)) + 1e-6
    cos = num(1) - (_dot(cur, prev) if unit else _dot(cur, prev) / (norm(cur) * norm(prev)))
    out = v.select(*keys, order, sq.alias("sq_l2"), cos.alias("cosine"))
    out = out.withColumns({"combined": F.col("sq_l2") + F.col("cosine"), "l2": F.sqrt("sq_l2")})
    return out.withColumn("delta", F.coalesce(F.abs(F.col("combined") - F.lag("combined").over(w)), num(0)))


def pair_signal(frames: DataFrame, errors: DataFrame, keys: list[str], value: str = "combined", order: str = "idx") -> DataFrame:
    """The error of each pair on its later frame, 0 on the first."""
    return frames.join(errors.select(*keys, order, F.col(value).alias("signal")), [*keys, order], "left").withColumn("signal", F.coalesce("signal", num(0)))


def eventness(signal: DataFrame, keys: list[str], value: str = "signal", share: float = 0.25) -> DataFrame:
    """Mean of the top quarter of a signal after robust scaling, by key."""
    return top_share_mean(robust_unit(signal, value, "_u", keys), "_u", "eventness", keys, share)

"""Document rates that give domains their target share of tokens. DataFrame operations only.

1. A labelled table gives domains. On a bounded sample of it (about FIT_DOCS documents of each domain, chosen by a hash
   of the id; whole texts) word counts in hashed buckets give a naive Bayes model of BUCKETS numbers a domain.
2. Every text gets its tokens counted and its posterior over domains. Words meet the model by a broadcast join (BUCKETS
   rows) and are summed before the shuffle, by id and hashes of the text, so rows that share an id but not their text
   stay apart. Words of a text are not independent, so the evidence of n tokens counts as that of
   n * EVIDENCE / (n + EVIDENCE), one smooth rule for all lengths, and membership stays soft.
3. The rates r >= 0 start at 1 and follow projected gradient steps on the least squares of expected domain token totals
   sum_i r_i n_i p_id against target share times all tokens. A step is scaled by the inverse of the domains' Gram matrix
   over the texts that still have a rate (as many numbers as pairs of domains, with a little of the masses on its
   diagonal), and by a factor that halves when the squares have grown. Each step sums totals and Gram matrix over all
   documents in one pass and moves every rate. Steps end when totals are within CLOSE (of all tokens) of the targets; if
   that does not come within STEPS, a warning says how far they are. Rates stay beside posteriors in a narrow table,
   written now and then; rows get theirs by one join on id and hashes.

Tokens are pieces between white space. A null or empty text has none: its posterior is the prior and it moves no total.
Each row counts for itself, also where ids repeat or are null. A target for a domain that no document has any mass in
cannot be met and is left out, and shares are scaled to sum to one. Without labelled rows all rates are 1 and there are
no posteriors; an empty input gives an empty result. Columns of the input that have the names of new ones are replaced.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import drop_table, materialize, sample_share

FIT_DOCS, BUCKETS, LEAN, EVIDENCE, STEPS, CLOSE, RIDGE = 2000, 1 << 14, 5000.0, 30.0, 60, 1e-4, 1e-5
#: Steps after which rates are written to a table, so that expressions stay small.
WRITE_EVERY = 8


def num(x: float) -> Column:
    return F.lit(float(x))


def _words(text: Column) -> Column:
    return F.split(F.coalesce(F.lower(text), F.lit("")), r"\s+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _named(key: str, text: str) -> list[Column]:
    """What names a text: its id and two hashes."""
    return [F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_one"), F.hash(F.col(text)).alias("_two")]


NAME = ["_id", "_one", "_two"]


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", fit_docs: int = FIT_DOCS
) -> tuple[list[str], list[float], list[list[float]]]:
    """labels: key and domain (nulls are passed over; of an id's several domains the least counts). Gives the domains,
    their log priors, and for each the log frequency of each bucket."""
    labels = labels.where(F.col(domain).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(domain).alias("domain"))
    sizes = {r[0]: r[1] for r in labels.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if not names:
        return [], [], []
    share = F.lit(0.0)
    for name in names:
        share = F.when(F.col("domain") == name, F.lit(min(1.0, fit_docs / sizes[name]))).otherwise(share)
    unit = sample_share(F.col(key))
    sample = F.broadcast(labels.where(unit < share).orderBy(unit, key).limit(2 * len(names) * fit_docs))
    words = docs.select(key, F.col(text).alias("text")).join(sample, key).select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word <> ''")
    counts = words.groupBy(_bucket(F.col("word")).alias("bucket")).agg(*[F.count_if(F.col("domain") == x).alias(f"c{i}") for i, x in enumerate(names)])
    count = np.zeros((len(names), BUCKETS))
    for r in counts.collect():
        count[:, r[0]] = r[1:]
    # each domain's frequency leans on that of all domains together, so a bucket rare in a small domain says little
    base = (count.sum(0) + 1.0) / (count.sum() + BUCKETS)
    logs = np.log((count + LEAN * base) / (count.sum(1, keepdims=True) + LEAN))
    return names, [math.log(sizes[x] / sum(sizes.values())) for x in names], logs.tolist()


def _soft(docs: DataFrame, model: tuple[list[str], list[float], list[list[float]]], key: str, text: str) -> DataFrame:
    """For each different text of an id: rows that have it, n_tokens of each, and p0, p1, ..."""
    names, priors, logs = model
    table = docs.sparkSession.createDataFrame([(k, *map(float, w)) for k, w in enumerate(np.array(logs).T)], "bucket int, " + ", ".join(f"w{i} double" for i in range(len(names))))
    named = docs.select(*_named(key, text), _words(F.col(text)).alias("words"))  # hashed once a text, not once a word
    words = named.select(*NAME, F.posexplode("words").alias("at", "word"))
    met = words.withColumn("bucket", F.when(F.col("word") != "", _bucket(F.col("word")))).join(F.broadcast(table), "bucket", "left")
    sums = met.groupBy(*NAME).agg(F.count_if(F.col("at") == 0).alias("rows"), F.count("bucket").alias("all"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(names))])
    sums = sums.withColumn("n_tokens", F.floor(F.col("all") / F.col("rows")))
    weight = num(EVIDENCE) / (F.col("n_tokens") + EVIDENCE) / F.col("rows")
    sums = sums.withColumns({f"z{i}": F.coalesce(F.col(f"s{i}") * weight, num(0)) + p for i, p in enumerate(priors)})
    top = F.greatest(*[F.col(f"z{i}") for i in range(len(names))]) if len(names) > 1 else F.col("z0")
    sums = sums.withColumn("top", top).withColumns({f"e{i}": F.exp(F.col(f"z{i}") - F.col("top")) for i in range(len(names))})
    whole = sum((F.col(f"e{i}") for i in range(1, len(names))), F.col("e0"))
    return sums.select(*NAME, "rows", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(len(names))])


def _given(docs: DataFrame, facts: DataFrame, key: str, text: str) -> DataFrame:
    """Every row of docs with the facts of its text. Facts are the smaller side; rows of docs are shuffled, not sorted."""
    new = [c for c in facts.columns if c not in NAME]
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in new]).alias("_row"), *_named(key, text)).alias("a")
    met = rows.join(facts.alias("b").hint("shuffle_hash"), F.expr(" and ".join(f"a.{c} <=> b.{c}" for c in NAME)))
    return met.select("_row.*", *new)


def posteriors(docs: DataFrame, model: tuple[list[str], list[float], list[list[float]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_tokens and p0, p1, ... of every row."""
    return _given(docs, _soft(docs, model, key, text).drop("rows"), key, text)


def solve_rates(soft: DataFrame, targets: list[float], weight: str = "n_tokens", steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """soft: tokens in column weight, p0, p1, ...; targets: a share for each. Adds rate."""
    d = len(targets)
    mass = soft.agg(F.sum(weight), *[F.sum(F.col(weight) * F.col(f"p{i}")) for i in range(d)]).first()
    tokens = float(mass[0] or 0)
    held = [i for i in range(d) if mass[i + 1]]
    whole = sum(targets[i] for i in held)
    if not tokens or not whole:
        return soft.withColumn("rate", num(1))
    share, goal = np.array([mass[i + 1] / tokens for i in held]), np.array([targets[i] / whole for i in held])
    cols = [F.col(f"p{i}") for i in held]
    pairs = [(a, b) for a in range(len(held)) for b in range(a + 1)]
    rated, rate, table, factor, squares = soft.withColumn("_rate", num(1)), F.col("_rate"), None, 1.0, math.inf
    for step in range(steps + 1):
        mass = F.col("r") * F.col(weight)
        on = F.when(F.col("r") > 0, F.col(weight)).otherwise(F.lit(0))
        sums = rated.select(rate.alias("r"), weight, *cols).agg(*[F.sum(mass * c) for c in cols], *[F.sum(on * cols[a] * cols[b]) for a, b in pairs]).first()
        off = np.array(sums[: len(held)], dtype=float) / tokens - goal
        if np.abs(off).max() < close:
            break
        if step == steps:
            warnings.warn(f"rates stopped after {steps} steps, {np.abs(off).max():.4f} from the target shares", stacklevel=2)
            break
        gram = np.diag(RIDGE * share)
        for (a, b), x in zip(pairs, sums[len(held) :]):
            gram[a, b] += x / tokens
            if a != b:
                gram[b, a] += x / tokens
        now = float((off**2 / share).sum())
        factor = max(factor / 2, 0.1) if now > squares else min(1.0, factor * 1.3)
        squares = now
        pull = (factor * np.linalg.solve(gram, off)).tolist()
        rate = F.greatest(num(0), rate - sum((num(e) * c for e, c in zip(pull[1:], cols[1:])), num(pull[0]) * cols[0]))
        if (step + 1) % WRITE_EVERY == 0:
            rated = materialize(rated.select(*soft.columns, rate.alias("_rate")), "mixing-rates")
            if table is not None:
                drop_table(table)
            rate, table = F.col("_rate"), rated
    return rated.select(*soft.columns, rate.alias("rate"))


def mix(docs: DataFrame, labelled: DataFrame, labels: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", domain: str = "domain", fit_docs: int = FIT_DOCS) -> DataFrame:
    """docs, every row and column, with n_tokens, p_<domain> of each domain and rate. labelled: where the texts of
    labels (key, domain) are; targets: domain to share, 0 where absent. A domain of the targets that no document is
    labelled with has p 0 everywhere, so the columns are those of the targets whatever the labels hold."""
    model = fit(labelled, labels, key, text, domain, fit_docs)
    names = model[0]
    if not names:
        tokens = F.size(F.filter(_words(F.col(text)), lambda w: w != "")).cast("long")
        return docs.withColumns({"n_tokens": tokens, "rate": num(1)} | {f"p_{x}": num(0) for x in sorted(targets)})
    soft = materialize(_soft(docs, model, key, text).withColumn("tokens", F.col("n_tokens") * F.col("rows")), "mixing-posteriors")
    rated = solve_rates(soft, [float(targets.get(x, 0.0)) for x in names], "tokens")
    absent = [num(0).alias(f"p_{x}") for x in sorted(set(targets) - set(names))]
    facts = rated.select(*NAME, "n_tokens", *[F.col(f"p{i}").alias(f"p_{x}") for i, x in enumerate(names)], *absent, "rate")
    return _given(docs, facts, key, text)

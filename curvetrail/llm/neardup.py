"""Documents whose sets of word n-grams overlap: Jaccard join by MinHash bands.

Words are lower-case letters and digits between white space; n-grams are five words (fewer where a text has fewer).
1. One pass over the texts gives a 128-bit hash of each word sequence and band hashes of a MinHash signature. Equal
   sequences are copies: they form one class, and only its least id goes on.
2. Band hashes are shuffled. A bucket of up to PAIRS_UP_TO texts gives all its pairs. In a larger one, each text is
   paired with the least id (a star), which is linear in the bucket. Candidate pairs are verified on the full n-gram
   sets, which only candidate texts get.
3. Texts of larger buckets that are unlike the least id are compared with the whole bucket, block of texts by block of
   texts in one matrix product each; of the links found only a spanning forest becomes rows. Nothing is capped.
4. Verified links are contracted to classes. Within a class, the links of each text are counted exactly, block of
   texts by block of texts, so that a class of any size is spread over tasks and its pairs are never rows. The price of
   an exact count is quadratic in the different texts of a class (copies are one text): n / BLOCK times each set is
   shuffled, n^2 / 2 overlaps are counted in matrix products. links=False leaves it out; n_links is null then.

Band and row counts follow from the target recall: with ROWS rows a band, the least number of bands with which a pair
at the threshold meets with probability RECALL.

Texts without a letter or digit are copies where their pieces between white space are the same, control characters
aside; null, empty and other blank texts are copies of each other. A null id has class null and no
links. Rows that repeat an id and text are one document; of an id with several texts the one with the least hash counts.

A text, word sequence or class that a third of all rows share: joins that bring rows to it are salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import materialize, mixed, pieces, salted_join, word_codes, word_hashes
from curvetrail.llm.components import connected_components

WORDS, THRESHOLD, ROWS, RECALL, PAIRS_UP_TO, BLOCK = 5, 0.8, 8, 0.995, 8, 256


def band_count(threshold: float, rows: int, recall: float) -> int:
    """The least b with 1 - (1 - threshold^rows)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def plain_words(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), r"[^\p{L}\p{N}]+", "")


def _sequence_hashes(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of word hashes."""
    size = np.diff(starts)
    inside = np.arange(len(hashes)) - np.repeat(starts[:-1], size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + mixed(inside.astype(np.uint64) + np.uint64(1))), dtype=np.uint64)])
    one = mixed(sums[starts[1:]] - sums[starts[:-1]] + size.astype(np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ mixed(inside.astype(np.uint64) + np.uint64(1 << 40))), dtype=np.uint64)])
    return one, mixed(sums[starts[1:]] - sums[starts[:-1]] + np.uint64(3) * size.astype(np.uint64))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word n-grams in turn, where each text's start, and two hashes of each word sequence."""
    codes, words, starts = word_codes(texts)
    plain = plain_words(words)
    real = np.asarray(pc.greater(pc.binary_length(plain), 0)) if len(words) else np.zeros(0, bool)
    keep = real[codes]
    raw_starts, starts = starts, np.concatenate([[0], np.cumsum(keep)])[starts]
    hashes = word_hashes(plain)[codes][keep]
    size = np.diff(starts)
    one, two = _sequence_hashes(hashes, starts)
    bare = np.repeat(size == 0, np.diff(raw_starts))
    if bare.any():  # a text without words is the sequence of its signs
        signs = pc.replace_substring_regex(words.cast(pa.large_string()), r"\p{Cc}+", "")
        seen = bare & np.asarray(pc.greater(pc.binary_length(signs), 0))[codes]
        others = _sequence_hashes(word_hashes(signs)[codes][seen], np.concatenate([[0], np.cumsum(seen)])[raw_starts])
        one, two = (np.where(size == 0, x, y) for x, y in zip(others, (one, two)))
    mult = np.uint64(0x9E3779B97F4A7C15)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out = np.zeros(int(count.sum()), np.uint64)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(hashes) >= n:
        rolled = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            rolled = rolled * mult + hashes[k : len(hashes) - n + 1 + k]
        left = np.repeat(starts[1:], size) - np.arange(len(hashes))  # words up to the end of the text
        full = np.flatnonzero(left[: len(rolled)] >= n)
        long = np.repeat(size >= n, count)
        out[long] = mixed(rolled[full])
    for t in np.flatnonzero((size > 0) & (size < n)):
        out[first[t]] = one[t]
    return out, first, one, two


def band_hashes(grams: np.ndarray, first: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """uint64 [text, band]; texts without n-grams get zeros."""
    size = np.diff(first)
    some = np.flatnonzero(size > 0)
    out = np.zeros((len(size), bands), np.uint64)
    if not len(some):
        return out
    rng = np.random.default_rng(seed)
    mult = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    base = (grams >> np.uint64(32)).astype(np.uint32)
    begin = first[:-1][some]
    work = np.empty_like(base)
    for b in range(bands):
        band = np.full(len(some), b + 1, np.uint64)
        for r in range(rows):
            np.multiply(base, mult[b * rows + r], out=work)
            work += add[b * rows + r]
            band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, begin))
        out[some, b] = band
    return out


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams, first, one, two = shingles(batch.column(1), words)
            sig = band_hashes(grams, first, bands, rows)
            size = np.diff(first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * bands, pa.int32()), pa.array(sig.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(size, pa.int32()), lists], names=["id", "one", "two", "grams", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams, first, one, two = shingles(batch.column(1), words)
            grams = grams.view(np.int64)
            own = [np.unique(grams[a:b]) for a, b in zip(first, first[1:])]
            place = np.cumsum([0, *map(len, own)])
            sets = pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(np.concatenate(own) if own else grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), sets], names=["id", "one", "two", "grams"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets, by blocks of a 0/1 matrix product."""
    known, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    held = np.bincount(at, minlength=len(known)) > 1  # an n-gram of one text alone is in no intersection
    number = np.cumsum(held) - 1
    row, at = row[held[at]], number[at[held[at]]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for c in range(0, int(held.sum()), columns):
        a, b = np.searchsorted(at, [c, c + columns])
        block = np.zeros((len(left) + len(right), columns), np.float32)
        block[row[a:b], at[a:b] - c] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out


def _linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of a and b are similar enough."""
    inter = overlaps(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - inter
    return inter.astype(np.float64) / union >= threshold


def _count_links(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        left = frame[frame["block"] == i]
        right = left if i == j else frame[frame["block"] == j]
        a, b = [np.asarray(x) for x in left["grams"]], [np.asarray(x) for x in right["grams"]]
        if not a or not b:
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        link = _linked(a, b, threshold)
        if i == j:
            np.fill_diagonal(link, False)
            return pd.DataFrame({"id": left["id"].to_numpy(), "n": link.sum(1).astype(np.int64)})
        return pd.DataFrame({"id": np.concatenate([left["id"], right["id"]]), "n": np.concatenate([link.sum(1), link.sum(0)]).astype(np.int64)})

    return run


def _forest(threshold: float):
    """Of the links between the two sides of a group, enough to connect what they connect."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            link = _linked([np.asarray(x) for x in left["grams"]], [np.asarray(x) for x in right["grams"]], threshold)
            a, b = left["id"].to_numpy(), right["id"].to_numpy()
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for r, c in zip(*np.nonzero(link)):
                x, y = root(int(a[r])), root(int(b[c]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(a[r]), int(b[c])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _block_links(members: DataFrame, odd: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges between odd texts (bucket, id) and all members of their buckets, in blocks of both."""
    many = members.join(odd.select("bucket").distinct(), "bucket", "left_semi")
    sized = many.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n1"))
    sized = sized.join(odd.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n0")), "bucket")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = odd.join(sized, "bucket").select("bucket", "id", F.lit(0).alias("side"), own("n0").alias("i"), all_of("n1").alias("j"))
    right = many.join(sized, "bucket").select("bucket", "id", F.lit(1).alias("side"), own("n1").alias("j"), all_of("n0").alias("i"))
    dealt = left.unionByName(right).join(sets, "id")
    return dealt.groupBy("bucket", "i", "j").applyInPandas(_forest(threshold), "a long, b long").where("a <> b")


def _candidates(members: DataFrame, pairs_up_to: int) -> DataFrame:
    """(bucket, center, id, small) of members (bucket, id): bucket's least id against the others; in small buckets
    all pairs, center being the smaller id."""
    sized = members.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1")
    met = members.join(sized, "bucket")
    star = met.where((F.col("n") > pairs_up_to) & (F.col("id") != F.col("center"))).select("bucket", "center", "id", F.lit(False).alias("small"))
    few = met.where(F.col("n") <= pairs_up_to).groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    heads = few.select("bucket", F.posexplode("ids").alias("at", "center"), "ids")
    pairs = heads.select("bucket", "center", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("id"), F.lit(True).alias("small"))
    return star.unionAll(pairs)


def similar_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    rows: int = ROWS, recall: float = RECALL, pairs_up_to: int = PAIRS_UP_TO, block: int = BLOCK, links: bool = True,
) -> DataFrame:
    """id, class_id, copy_of (the least id with the same words) and n_links (texts with other words that are similar).
    One row for each distinct id; null ids are absent."""
    bands = band_count(threshold, rows, recall)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    signed = materialize(
        source.mapInArrow(_signatures(words, bands, rows), "id long, one long, two long, grams int, bands array<long>"), "signatures"
    )
    name = ["one", "two"]
    own = signed.groupBy("id").agg(F.min(F.struct(*name)).alias("n")).select("id", "n.*")
    own = materialize(own, "sequences")
    shared = own.groupBy(*name).agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(*name, "least")
    copies = salted_join(own, shared, name, F.col("id")).select("id", *name, F.coalesce("least", "id").alias("copy_of"))
    copies = materialize(copies, "copies")
    # of equal texts the least id goes on, with one signature
    lead = copies.where("id = copy_of").select("id", *name)
    some = signed.where("grams > 0").select("id", *name, "bands").join(lead, ["id", *name]).dropDuplicates(["id"])
    members = some.select("id", F.explode("bands").alias("bucket"))

    todo = materialize(_candidates(members, pairs_up_to), "candidates")
    pairs = materialize(todo.select("center", "id").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("center", "id")).alias("id")).distinct()
    wanted = source.join(ids.hint("shuffle_hash"), "id", "left_semi")
    found = wanted.mapInArrow(_sets(words), "id long, one long, two long, grams array<long>")
    sets = materialize(found.join(lead, ["id", *name], "left_semi").dropDuplicates(["id"]).select("id", "grams"), "sets")
    with_left = pairs.join(sets.select(F.col("id").alias("center"), F.col("grams").alias("x")), "center")
    both = with_left.join(sets.select("id", F.col("grams").alias("y")), "id")
    inter = F.size(F.array_intersect("x", "y"))
    judged = materialize(both.select("center", "id", (inter / (F.size("x") + F.size("y") - inter) >= threshold).alias("ok")), "judged")
    # in large buckets, texts unlike the least id meet the whole bucket
    odd = todo.where("not small").join(judged.where("not ok"), ["center", "id"], "left_semi").select("bucket", "id")
    odd = materialize(odd, "odd")
    large = todo.where("not small")
    large = large.select("bucket", "id").unionAll(large.select("bucket", F.col("center").alias("id")).distinct())
    more = _block_links(large, odd, sets, threshold, block)
    edges = judged.where("ok").select(F.col("center").alias("a"), F.col("id").alias("b")).unionAll(more)

    classes = materialize(connected_components(edges), "classes")
    counts = classes.select("id", F.lit(None).cast("long").alias("n_links"))
    if links:
        sized = classes.groupBy("class").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
        placed = salted_join(classes, sized, ["class"], F.col("id"), "inner")
        numbered = placed.join(sets, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = numbered.withColumn("other", other).select(
            "class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "grams"
        )
        counts = dealt.groupBy("class", "i", "j").applyInPandas(_count_links(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))
    texts = classes.join(counts, "id", "left").select(F.col("id").alias("copy_of"), F.col("class").alias("class_id"), "n_links")
    none = F.lit(0 if links else None).cast("long")
    return salted_join(copies.select("id", "copy_of"), texts, ["copy_of"], F.col("id")).select(
        "id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", none).alias("n_links")
    )

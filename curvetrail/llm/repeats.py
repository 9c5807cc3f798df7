"""Bytes that repeat: every byte covered by a LENGTH-byte string that also starts earlier is removed.

Prefix doubling over positions that can still repeat. A rank names a prefix; pairs of ranks at growing offsets are brought
together, ranked anew, and a position leaves as soon as its rank is unique or its prefix reaches LENGTH:

1. SEED bytes. Of the SEED-byte prefixes that start in a LENGTH-byte window the one with the least hash ranks the window;
   windows in a row that share it form a run. Equal windows have equal ranks, so windows whose rank is unique are done,
   and one row a run is counted, about one in (LENGTH - SEED) / 2 bytes. Of runs that are equal as a whole (pair of rank
   and rank of all bytes of the run) all but the first repeat it; one of each stays if its rank has several.
2. The windows of these runs are told apart from the text around the ranked seed. Every STEP-th place from the seed on is
   a position, if a window has it in its first STEP bytes; equal windows have it at the same place. In round after round
   the rank of a position's first k bytes is paired with the rank of the k bytes that begin k (or less) further on, equal
   pairs are counted, and the positions whose pair is unique leave: 24, 48, 88 bytes.
3. LENGTH bytes. The windows of the positions that are left are ranked by all their bytes; all but the first of a rank
   repeat it.

Order is (doc_id, start). Ranks are 64-bit fingerprints (polynomials over the ring of 64-bit numbers, mixed). Equal ones
of different bytes would only keep a position that could leave; what is removed is decided by pairs of 128 bits. A rank with a third of all rows: within a batch all but its first run are settled before the
shuffle; counts are summed within tasks before they are shuffled; rows meet the counts in joins, whose large partitions
adaptive execution splits. No rank is gathered or listed.

Null and empty texts have no bytes. Rows that repeat an id and text are one document: neither is earlier, each is
returned. Of an id with several texts the one with the least hash is the document; rows with its other texts, like
rows with a null id, are returned whole and are not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.llm.common import _TABLE, drop_table, materialize, mixed, pieces

LENGTH, SEED, STEP = 100, 24, 8
SEGMENT = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Prints:
    """Fingerprints of any stretches of some bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.empty(len(raw) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_TABLE[:256][raw] * up[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k))


def segments(texts: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Packs texts into stretches of about SEGMENT bytes: the bytes, and for each part (text, place of its first byte
    in the text, where it begins in the stretch) and an end. A longer text comes in parts that overlap."""
    held, parts, size = [], [], 0
    for t, text in enumerate(texts):
        if len(text) <= overlap:
            continue
        at = 0
        while True:
            piece = text[at : at + SEGMENT]
            if size and size + len(piece) > SEGMENT:
                yield np.frombuffer(b"".join(held), np.uint8), [*parts, (-1, 0, size)]
                held, parts, size = [], [], 0
            held.append(piece)
            parts.append((t, at, size))
            size += len(piece)
            if at + SEGMENT >= len(text):
                break
            at += SEGMENT - overlap
    if size:
        yield np.frombuffer(b"".join(held), np.uint8), [*parts, (-1, 0, size)]


def find_runs(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of all runs: text, start of the first window, windows, place of the ranked seed, its rank, and rank of the whole."""
    out = [[], [], [], [], [], []]
    wide = length - seed + 1
    for raw, parts in segments(texts, length - 1):
        begin = np.array([p[2] for p in parts])
        prints = Prints(raw)
        rank = prints.grams(seed)
        bits = np.uint64(21)
        low = (rank >> bits << bits) | np.arange(len(rank), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        place = (low & np.uint64((1 << 21) - 1)).astype(np.int64)  # of each window's least seed, the leftmost of equals
        valid = np.ones(len(place), bool)
        for b in begin[1:-1]:  # windows over the end of a text
            valid[max(0, b - length + 1) : b] = False
        fresh = np.empty(len(place), bool)
        fresh[:1] = True
        fresh[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        start = np.flatnonzero(fresh & valid)
        stop = np.flatnonzero(np.append(fresh[1:] | ~valid[1:], True) & valid) + 1
        part = np.searchsorted(begin, start, "right") - 1
        shift = np.array([p[1] - p[2] for p in parts])[part]
        out[0].append(np.array([p[0] for p in parts])[part])
        out[1].append(start + shift)
        out[2].append(stop - start)
        out[3].append(place[start] + shift)
        out[4].append(rank[place[start]])
        out[5].append(prints.of(start, stop - 1 + length))
    kinds = [np.int64] * 4 + [np.uint64] * 2
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds))


#: spot packs start << 16 | windows << 8 | (place - start): windows and place - start are under 2 * LENGTH - SEED.
RUNS = "rank long, whole long, id long, spot long, settled boolean"


def _runs(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = np.asarray(batch.column(0), dtype=np.int64)
            text, start, windows, place, rank, whole = find_runs([x.as_py() or b"" for x in batch.column(1)], length, seed)
            own = ids[text]
            # all but the first of equal runs in this batch repeat it
            key = mixed(rank ^ (whole * np.uint64(3)))
            order = np.lexsort((start, own, key))
            k, i, s = key[order], own[order], start[order]
            head = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
            lead = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
            settled = np.zeros(len(k), bool)
            settled[order] = (i != i[lead]) | (s != s[lead])
            # settled rows need no rank any more: they travel along, dealt by document and place
            rank, whole = np.where(settled, mixed(own.view(np.uint64)), rank), np.where(settled, start.view(np.uint64), whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(own), pa.array(start << 16 | windows << 8 | place - start), pa.array(settled)],
                names=["rank", "whole", "id", "spot", "settled"],
            )

    return run


STRETCHES = "id long, start int, windows int, place int, stretch binary"


def _stretches(length: int):
    """The text of each open run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for row in range(batch.num_rows):
                text, runs = batch.column(1)[row].as_py() or b"", batch.column(2)[row].values
                start, windows, place = (np.asarray(runs.field(n), dtype=np.int64) for n in ("start", "windows", "place"))
                for at in range(0, len(start), 20_000):
                    s, w, p = (x[at : at + 20_000] for x in (start, windows, place))
                    data = [text[a:z] for a, z in zip(s.tolist(), (s + w - 1 + length).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), batch.column(0)[row].as_py())), *(pa.array(x.astype(np.int32)) for x in (s, w, p)), pa.array(data, pa.binary())],
                        names=["id", "start", "windows", "place", "stretch"],
                    )

    return run


#: spot packs start << 16 | at. at: bytes from the start of the run.
POSITIONS = "rank long, id long, spot long"


def heads_of(windows: np.ndarray, ahead: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run the first and the last position (from its start) that a window has in its first `step` bytes. ahead:
    where the ranked seed is; positions are a whole number of steps from it."""
    return ahead - step * (ahead // step), ahead - step * ((ahead - windows + 1) // step)


def _pairs(known: int, offset: int, step: int):
    """Positions of runs with the pair of the rank of their first `known` bytes and of as many `offset` bytes on. Rows are
    STRETCHES and the positions that are left (null: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, start, windows, place = (np.asarray(batch.column(k), dtype=np.int64) for k in range(4))
            texts, left = batch.column(4).to_pylist(), batch.column(5)
            if left.null_count:
                low, high = heads_of(windows, place - start, step)
                n = (high - low) // step + 1
                of = np.repeat(np.arange(len(ids)), n)
                at = np.repeat(low, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            else:
                of = np.repeat(np.arange(len(ids)), np.diff(np.asarray(left.offsets)))
                at = np.asarray(left.flatten(), dtype=np.int64)
            prints = Prints(np.frombuffer(b"".join(texts), np.uint8))
            x = np.cumsum([0, *map(len, texts)])[:-1][of] + at
            rank = mixed(prints.of(x, x + known) + prints.of(x + offset, x + offset + known) * np.uint64(_BASE))
            yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(ids[of]), pa.array(start[of] << 16 | at)], names=["rank", "id", "spot"])

    return run


def _not_unique(positions: DataFrame) -> DataFrame:
    """The positions whose rank another has too: id, start, at; written out."""
    met = positions.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    found = positions.join(met, "rank")
    return materialize(found.select("id", F.shiftright("spot", 16).cast("int").alias("start"), F.col("spot").bitwiseAND(0xFFFF).cast("int").alias("at")), "repeat-ranks")


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Spans joined where they touch, cut to the text."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = []
        for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
            data = text.as_py() or b""
            spans = merged(list(zip(starts.as_py() or [], ends.as_py() or [])), len(data))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            rows.append((len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _one_text(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with the mark whether they are compared, and those that are: one text for each id."""
    digest = F.xxhash64("text")
    several = every.where("id is not null").select("id", digest.alias("d")).groupBy("id").agg(F.min("d").alias("d"), F.max("d").alias("z"))
    several = materialize(several.where("d <> z").select("id", F.col("d").alias("least")), "repeat-ids")
    if several.isEmpty():
        every = every.withColumn("compared", F.col("id").isNotNull())
    else:
        every = every.join(several.hint("shuffle_hash"), "id", "left").withColumn("compared", F.col("id").isNotNull() & (F.coalesce("least", digest) == digest)).drop("least")
    return every, every.where("compared").select("id", "text")


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, step: int = STEP) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges) of every row."""
    if 2 * length - seed > 255 or not 0 < seed <= length:
        raise ValueError("places within a run must fit a byte")
    core = seed + step * ((length - step + 1 - seed) // step)  # what a head's windows have in common, in whole steps
    if seed % step or core <= seed:
        raise ValueError("the seed must be a whole number of steps, and a step shorter than what a window has besides")
    every = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    every, rows = _one_text(every)
    runs = rows.mapInArrow(_runs(length, seed), RUNS)
    counted = runs.where("not settled").groupBy("rank").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("differ"))
    shared = materialize(counted.where("n > 1").select("rank", "differ"), "repeat-seeds")
    live = materialize(runs.join(shared, "rank", "left").where("settled or differ is not null"), "repeat-runs")
    whole = live.where("not settled").groupBy("rank", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "spot")).alias("least"))
    later = whole.where("n > 1").select("rank", "whole", "least")
    again = F.col("settled") | (F.col("least").isNotNull() & (F.struct("id", "spot") > F.col("least")))
    start, windows, ahead = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(0xFF), F.col("spot").bitwiseAND(0xFF)
    first = live.join(later, ["rank", "whole"], "left").withColumn("again", again).where("again or differ")
    first = materialize(first.select("id", start.cast("int").alias("start"), windows.cast("int").alias("windows"), (start + ahead).cast("int").alias("place"), "again"), "repeat-runs")
    drop_table(live)
    drop_table(shared)
    spans = first.where("again").select("id", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))

    # a repeated row must not count as a second occurrence
    todo = first.where("not again").distinct().groupBy("id").agg(F.collect_list(F.struct("start", "windows", "place")).alias("runs"))
    once = rows.join(todo.hint("shuffle_hash"), "id").select("id", "text", "runs")
    stretches = materialize(once.mapInArrow(_stretches(length), STRETCHES), "repeat-stretches")
    left, known, ranked = stretches.withColumn("left", F.lit(None).cast("array<int>")), seed, None
    while known < core:
        offset = min(known, core - known)
        before, ranked = ranked, _not_unique(left.mapInArrow(_pairs(known, offset, step), POSITIONS))
        if before is not None:
            drop_table(before)
        known += offset
        if known < core:
            of_run = ranked.groupBy("id", "start").agg(F.collect_list("at").alias("left"))  # at most a few positions a run
            left = stretches.join(of_run, ["id", "start"]).select(*stretches.columns, "left")

    # a window has its head at most step - 1 bytes after its start
    windows = ranked.join(stretches.select("id", "start", "windows", "stretch"), ["id", "start"])
    windows = windows.withColumn("nth", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - step + 1), F.least("at", F.col("windows") - 1))))
    window = F.expr(f"substring(stretch, nth + 1, {length})")
    windows = windows.select(F.xxhash64(window).alias("left"), F.xxhash64(F.lit(1), window).alias("right"), "id", (F.col("start") + F.col("nth")).alias("start"))
    # named twice, once to count and once to meet the counts: a table of all windows would take more disk than both shuffles
    name = ["left", "right"]
    least = windows.groupBy(*name).agg(F.min(F.struct("id", "start")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = windows.join(least, name).where(F.struct("id", "start") > F.col("least")).select("id", "start", (F.col("start") + length).alias("end"))

    # windows in a row are one span already where they are settled together, so a document has few
    gathered = spans.unionAll(late).groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("s"))
    gathered = materialize(gathered.select("id", F.col("s.start").alias("starts"), F.col("s.end").alias("ends")), "repeat-spans")
    for table in (ranked, stretches, first):
        drop_table(table)
    mine = F.when(F.col("compared"), F.col("id"))
    whole = every.withColumn("mine", mine).join(gathered.withColumnRenamed("id", "mine").hint("shuffle_hash"), "mine", "left").select("id", "text", "starts", "ends")
    return whole.mapInArrow(_kept, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")

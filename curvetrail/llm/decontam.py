"""Benchmark passages in documents, by the q-gram lemma.

A region of a document that is within e edits of an item of m characters shares at least m - q + 1 - q * e character
q-grams with it, and all of them lie on diagonals (document place minus item place) that differ by at most e. So the
shared q-grams are counted in bands of diagonals 2e + 1 wide that overlap by half, bands that meet the bound are kept,
and a banded alignment of the whole item against the region decides. e is RATE of the item's length, or less for a
short item, so that the bound is at least one q-gram; an item shorter than q is sought exactly.

Texts are compared in lower case with white space runs as one space, whole texts, as code points. The items are the
query set: they are put into blocks of at most BLOCK_CHARS characters, and one block after the other goes over all
documents, its results written before the next is sent, so what the executors hold is bounded whatever the benchmark's
size. Hits are counted HITS at a time, so a passage that many items share does not fill a worker.

Null and empty texts or items match nothing; repeated rows each match; an item that occurs twice in a document gives its
best region (fewest edits, then the first). An item_id with several texts stands for all of them, its best region is
that of any; items without an id count as one item with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import materialize, pieces

Q, RATE, BLOCK_CHARS = 10, 0.08, 2_000_000
MATCHES = "id long, item_id long, edits int, region_start int, region_end int"
#: Shared q-grams that are spread over bands at a time.
HITS = 4_000_000
_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of the q characters from each place on."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out, mult = np.zeros(n, np.uint32), np.uint32(0x01000193)
    for k in range(q):
        out *= mult
        out += points[k : n + k]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


class Items:
    """A block of benchmark items, indexed by q-gram."""

    def __init__(self, rows: list[tuple[int | None, str]], q: int = Q, rate: float = RATE):
        rows = list(dict.fromkeys((i, t) for i, t in ((i, normal(t)) for i, t in rows) if t))
        self.q = q
        self.short = [(i, t) for i, t in rows if len(t) < q]
        rows = [r for r in rows if len(r[1]) >= q]
        self.ids = [r[0] for r in rows]
        self.text = [_points(r[1]) for r in rows]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q)
        self.bound = self.size - q + 1 - q * self.edits
        grams = [_hashes(t, q) for t in self.text]
        gram = np.concatenate([np.zeros(0, np.uint32), *grams])
        item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.mask = np.zeros(1 << _BITS, bool)
        self.mask[self.gram >> np.uint32(32 - _BITS)] = True

    def candidates(self, points: np.ndarray, owner_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and band start (diagonal within points) of every band that meets the bound."""
        h = _hashes(points, self.q)
        at = np.flatnonzero(self.mask[h >> np.uint32(32 - _BITS)])
        lo, hi = np.searchsorted(self.gram, h[at], "left"), np.searchsorted(self.gram, h[at], "right")
        ends, keys, counts, done = np.cumsum(hi - lo), [], [], 0
        while done < len(at):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, "right")))
            key, count = self._bands(at[done:stop], lo[done:stop], hi[done:stop], owner_of)
            keys.append(key)
            counts.append(count)
            done = stop
        if not keys:
            none = np.zeros(0, np.int64)
            return none, none, none
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        doc, item, band = key >> 53, key >> 32 & ((1 << 21) - 1), (key & ((1 << 32) - 1)) - (1 << 31)
        keep = count >= self.bound[item]
        doc, item, band = doc[keep], item[keep], band[keep]
        return doc, item, band * (self.edits[item] + 1)

    def _bands(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner_of) -> tuple[np.ndarray, np.ndarray]:
        """How many of these places of the text share a q-gram with an item, by document, item and band (in one number)."""
        n = hi - lo
        pos = np.repeat(at, n)
        spot = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        item = self.item[spot]
        # hashes may collide: the characters decide in the alignment, the count only keeps a band
        band = (pos - self.place[spot]) // (self.edits[item] + 1) + (1 << 31)
        key = owner_of(pos) << 53 | item << 32
        return np.unique(np.concatenate([key | band, key | band - 1]), return_counts=True)

    def align(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fewest edits that turn the whole item into some region of points[low:high] on diagonals start - e to
        start + 3e + 1, and where that region begins and ends."""
        n = len(item)
        best, first, last = np.full(n, 1 << 20), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for e in np.unique(self.edits[item]):
            lanes = np.flatnonzero(self.edits[item] == e)
            width = 4 * int(e) + 3
            base = start[lanes] - e  # the diagonal of column 0
            size = self.size[item[lanes]]
            most = int(size.max())
            text = np.zeros((len(lanes), most), np.uint32)
            for r, i in enumerate(item[lanes]):
                text[r, : self.size[i]] = self.text[i]
            k = np.arange(width)
            place = base[:, None] + k[None, :]  # where in points the region would begin
            lo, hi = low[lanes][:, None], high[lanes][:, None]
            far = 1 << 20
            cost = np.where((place >= lo) & (place <= hi), 0, far)
            begin = place.copy()
            for i in range(most):
                col = place + i  # the character that diagonal k pairs with item character i
                inside = (col >= lo) & (col < hi)
                same = points[np.clip(col, 0, len(points) - 1)] == text[:, i : i + 1]
                pair = np.where(inside, cost + ~same, far)
                # an item character without a partner: from diagonal k + 1 of the row before
                drop = np.full_like(cost, far)
                drop[:, :-1] = cost[:, 1:] + 1
                from_drop = np.full_like(begin, 0)
                from_drop[:, :-1] = begin[:, 1:]
                take = drop < pair
                now, origin = np.where(take, drop, pair), np.where(take, from_drop, begin)
                # characters of the document without a partner: along the row
                slid = now - k[None, :]
                lowest = np.minimum.accumulate(slid, axis=1)
                fresh = np.maximum.accumulate(np.where(slid == lowest, k[None, :], 0), axis=1)
                now, origin = lowest + k[None, :], np.take_along_axis(origin, fresh, 1)
                live = size > i
                cost, begin = np.where(live[:, None], now, cost), np.where(live[:, None], origin, begin)
            end = place + size[:, None]
            cost = np.where((end >= lo) & (end <= hi), cost, far)
            c = cost.argmin(1)
            rows = np.arange(len(lanes))
            best[lanes], first[lanes], last[lanes] = cost[rows, c], begin[rows, c], end[rows, c]
        return best, first, last

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of each item's best region; places are in normalized texts."""
        out = []
        for i, t in self.short:
            out += [(d, i, 0, x.find(t), x.find(t) + len(t)) for d, x in enumerate(texts) if t in x]
        if not self.ids or not texts:
            return out
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        points = _points("\x00".join(texts) + "\x00")
        doc, item, band = self.candidates(points, lambda pos: np.searchsorted(starts, pos, "right") - 1)
        for at in range(0, len(doc), 512):
            d, i, b = doc[at : at + 512], item[at : at + 512], band[at : at + 512]
            edits, first, last = self.align(points, starts[d], starts[d + 1] - 1, i, b)
            ok = np.flatnonzero(edits <= self.edits[i])
            out += zip(d[ok].tolist(), [self.ids[x] for x in i[ok].tolist()], edits[ok].tolist(), (first[ok] - starts[d[ok]]).tolist(), (last[ok] - starts[d[ok]]).tolist())
        return out


def blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    rows, size = [], 0
    for r in benchmark.select(F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull()).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """id, item_id, edits and region (normalized text) for each document row and item within the edit budget."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = []
    for block in blocks(benchmark, item_key, item_text, block_chars):
        shared = spark.sparkContext.broadcast(Items(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                ids, texts = batch.column(0).to_pylist(), [normal(t) for t in batch.column(1).to_pylist()]
                best: dict[tuple[int, int | None], tuple] = {}
                for d, i, e, s, t in shared.value.matches(texts):
                    best[d, i] = min(best.get((d, i), (1 << 30,)), (e, s, t))
                cols = list(zip(*[(ids[d], i, *v) for (d, i), v in best.items()])) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]], names=["id", "item_id", "edits", "region_start", "region_end"])

        found.append(materialize(rows.mapInArrow(run, MATCHES), "leaks"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionAll, found)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of docs, all columns, in which no item is found. Each block of items filters what the last one kept,
    which is written in between; with a benchmark of one block nothing is."""
    spark = docs.sparkSession
    at, out, shared = docs.columns.index(text), docs, None
    for block in blocks(benchmark, item_key, item_text, block_chars):
        if shared is not None:
            out = materialize(out, "unleaked")
            shared.destroy()
        shared = spark.sparkContext.broadcast(Items(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in shared.value.matches([normal(t) for t in batch.column(at).to_pylist()])]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out

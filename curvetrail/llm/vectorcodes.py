"""Product codes of vectors: each vector is cut into equal parts, each part takes the number of its nearest entry in the
codebook of its place. All numbers are integers, so results do not depend on the order of rows or on how Spark cuts them.

A component x becomes floor(scale * x). A codebook starts as that part of the vectors with the smallest ids. Each round
assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and moves an entry to the
floored mean of its parts; an entry without parts stays. Codebooks have `entries` times the vector's length numbers: they
go to the workers with the task and come back as sums, added up per entry by a shuffle of at most so many rows a task.

Rows: vectors that are null, or have a null, NaN or infinite component, are left out. Null ids are kept and count as the
largest; ties of ids go by the vector itself. Vectors of different lengths are filled with zeros to the longest, rounded up
to whole parts; empty ones are all zeros. Integers of any size are exact: where 64 bits could overflow, a batch is
worked out with Python's; an error (or a sum of errors) that no long holds is null. Fewer vectors than entries make
smaller codebooks; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import materialize, salted_join

#: Vectors whose distances are worked out together.
BLOCK_ROWS = 1024
#: Components below this in size, with codebooks alike, have exact distances and sums in 64 bits.
SAFE = 1 << 26
#: Sums travel as two decimals, high * LIMB + low.
LIMB = 1 << 60


@dataclass(frozen=True)
class Codebooks:
    """books[part, entry, place]: integers; int64 where all are below SAFE, else Python's."""

    books: np.ndarray

    @property
    def parts(self) -> int:
        return self.books.shape[0]

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def digest(self) -> str:
        """Of all integers in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.ravel()).encode()).hexdigest()


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as integers: int64 if all are below SAFE, else Python's."""
    if (np.abs(values) < SAFE).all():
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column as [row, width], short vectors filled with zeros."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    sizes = np.asarray(pc.list_value_length(vectors), dtype=np.int64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return whole(np.floor(out * scale))


def nearest(rows: np.ndarray, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part [row, part] and its squared distance. |p - c|^2 is |p|^2 - 2 p.c + |c|^2; the first least one
    of an entry is taken."""
    books = codebooks.books
    if rows.dtype != books.dtype:
        rows, books = rows.astype(object), books.astype(object)
    parts = rows.reshape(len(rows), books.shape[0], books.shape[2]).transpose(1, 0, 2)
    far = (books * books).sum(axis=2)[:, None, :] - 2 * np.matmul(parts, books.transpose(0, 2, 1))
    code = far.argmin(axis=2)
    least = np.take_along_axis(far, code[:, :, None], 2)[:, :, 0] + (parts * parts).sum(axis=2)
    return code.T, least.T


def _blocks(batch: pa.RecordBatch, at: int, codebooks: Codebooks, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for start in range(0, batch.num_rows, BLOCK_ROWS):
        rows = integers(batch.column(at).slice(start, BLOCK_ROWS), codebooks.width, scale)
        yield start, rows, *nearest(rows, codebooks)


def _sums(vectors: DataFrame, codebooks: Codebooks, scale: int) -> dict[tuple[int, int, int], tuple[int, int]]:
    """For each part, entry and place: the sum of the parts' components and their number."""
    p, e, w = codebooks.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((p, e, w), object), np.zeros((p, e), np.int64)
        for batch in batches:
            for _, rows, code, _ in _blocks(batch, 0, codebooks, scale):
                cell = (code + np.arange(p) * e).ravel()
                counts += np.bincount(cell, minlength=p * e).reshape(p, e)
                block = np.zeros((p * e, w), rows.dtype)
                np.add.at(block, cell, rows.reshape(-1, w))  # BLOCK_ROWS * SAFE fits 64 bits
                totals += block.reshape(p, e, w)
        part, entry = np.nonzero(counts)
        each = [(int(a), int(b), k, int(totals[a, b, k]), int(counts[a, b])) for a, b in zip(part, entry) for k in range(w)]
        cols = list(zip(*each)) or [[]] * 5
        high, low = [s // LIMB for s in cols[3]], [s % LIMB for s in cols[3]]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(high, kind), pa.array(low, kind), pa.array(cols[4], pa.int64())], names=["part", "entry", "place", "high", "low", "n"])

    some = vectors.select("vector").mapInArrow(run, "part int, entry int, place int, high decimal(38,0), low decimal(38,0), n long")
    merged = some.groupBy("part", "entry", "place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))
    return {(r.part, r.entry, r.place): (int(r.high) * LIMB + int(r.low), r.n) for r in merged.collect()}  # entries * width rows


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, vector, label) of the rows whose vector is whole and finite."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select(F.col(key).alias("id"), v.alias("vector"), F.col(label).alias("label")).where(F.col(vector).isNotNull() & ~odd)


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    """Codebooks of (id, vector, label); None if there are no vectors. Each round reads all vectors once."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts)) * parts
    first = vectors.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    rows = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, scale)
    books = np.ascontiguousarray(rows.reshape(len(rows), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        moved = books.astype(object)
        for at, (total, n) in _sums(vectors, Codebooks(books), scale).items():
            moved[at] = total // n
        books = moved.astype(np.int64) if all(abs(x) < SAFE for x in moved.ravel()) else moved
    return Codebooks(books)


def assign(vectors: DataFrame, codebooks: Codebooks, scale: int) -> DataFrame:
    """(id, label, code: two hex digits a part, error: squared distances summed over the parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows, code, far in _blocks(batch, 1, codebooks, scale):
                raw = code.astype(np.uint8).tobytes().hex()
                n = 2 * codebooks.parts
                codes = [raw[i * n : (i + 1) * n] for i in range(len(rows))]
                errors = [int(x) if x < 1 << 63 else None for x in far.sum(axis=1)]
                some = batch.slice(start, len(rows))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("id", "vector", "label").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each usable row. label_error: errors summed over equal labels,
    null labels together; a label with a third of all rows is summed within tasks first and joined back over salts."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors = usable(rows, key, vector, label)
    codebooks = fit(vectors, parts, entries, rounds, scale)
    if codebooks is None:
        codebooks = Codebooks(np.zeros((parts, 1, 1), np.int64))
    coded = materialize(assign(vectors, codebooks, scale), "codes")
    known = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    none, label_key = F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("0").cast(coded.schema["label"].dataType)).alias("label")
    sums = coded.groupBy(none, label_key).agg(known.alias("label_error"))
    joined = salted_join(coded.select("id", none, label_key, "code", "error"), sums, ["none", "label"], F.col("code"))
    return joined.select("id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256"))

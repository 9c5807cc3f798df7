"""What the corpus operators share: scratch tables, batch sizes within workers, salted joins, word codes, hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of the widest column, that a worker handles at a time.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Parts that the rows of one key are dealt over in salted joins.
SALTS = 16


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one for a local master;
    on a cluster that would be a different folder on each machine, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="curvetrail-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends: what is written to a table is never computed from them again.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends here, a lost executor costs nothing,
    and the shuffle files of the steps before are given back. options: of the Parquet writer."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder below the shared one."""
    if path.split(":", 1)[-1].lstrip("/").startswith(scratch_root(spark).split(":", 1)[-1].lstrip("/")):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Removes a table of materialize() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `rows` rows and about `size` bytes (one row at least), whatever the session's Arrow
    options are: a worker's memory follows from these two numbers and the longest row."""
    for batch in batches:
        wide = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                wide += np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        ends, at = np.cumsum(wide), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """rows joined with a table that has a row for each key. A key with a third of all rows is dealt over `salts` tasks:
    each of its rows takes a salt from `spread`, and the table comes once for each salt, so it should hold only keys
    that the join has something to say of."""
    some = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(table.withColumn("_salt", some), [*keys, "_salt"], how).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text modulo folds; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def sample_share(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) / F.lit(float(1 << 30))


# ---------------------------------------------------------------- words of an Arrow batch


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Splits at white space. Gives the code of each word in turn, the distinct words, and for each text the
    place where its words start (one place more than texts). Null texts have no words."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(filled)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = pc.dictionary_encode(flat)
    codes = np.asarray(coded.indices, dtype=np.int64)
    words = coded.dictionary
    real = np.asarray(pc.greater(pc.binary_length(words), 0)) if len(words) else np.zeros(0, bool)
    if not real.all():  # split pieces at the ends of a text are empty
        keep = real[codes]
        starts = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]
        renumber = np.cumsum(real) - 1
        return renumber[codes[keep]], words.filter(pa.array(real)), starts
    return codes, words, offsets - offsets[0]


def string_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each starts (one place more than strings)."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1 + words.offset)[words.offset :]
    data = words.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a multiply and xor-shift finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


_TABLE = mixed(np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    data, starts = string_bytes(words)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts[:-1], np.diff(starts))
    terms = mixed((_TABLE[data.astype(np.int64)] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    return mixed(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64))


def char_grams(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of <word>, with the number of the word that each belongs to."""
    kind = pa.large_string()
    marked = pc.binary_join_element_wise(pa.scalar("<", kind), words.cast(kind), pa.scalar(">", kind), pa.scalar("", kind))
    raw, starts = string_bytes(marked)
    lead = (raw & 0xC0) != 0x80  # first bytes of characters
    points = np.flatnonzero(lead)
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), np.diff(starts))[points]
    # a character as one number: its bytes folded together
    ends = np.append(points[1:], len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(_TABLE[raw.astype(np.int64)] + (np.arange(len(raw)) - np.repeat(points, ends - points)).astype(np.uint64)), dtype=np.uint64)])
    chars = sums[ends] - sums[points]
    out = chars[: len(chars) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + chars[k : len(chars) - n + 1 + k]
    inside = owner[: len(out)] == owner[n - 1 :]
    return mixed(out[inside] + np.uint64(n)), owner[: len(out)][inside]


def letters_only(words: pa.Array) -> pa.Array:
    """Lower case, letters alone."""
    return pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), r"[^\p{L}]+", "")

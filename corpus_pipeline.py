"""A corpus from documents to rates: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents, the last those and its own; of them only doc_id and text have
to be there. Rows with a null doc_id cannot be named in a decision and
are kept; rows that repeat a doc_id are kept or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvetrail.llm import decontam, mixing, neardup, secrets, toxicity
from curvetrail.llm.common import drop_path, read_table, scratch_path
from curvetrail.llm.queries import MIX_TARGETS, label_domains

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.7
#: What stands in a kept text where a secret was.
MASK = "[secret]"


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those whose doc_id is in ids. Both sides are shuffled by doc_id once; ids are hashed, texts not sorted.
    Rows without an id take no part in the shuffle, where all of them would meet in one task."""
    named = docs.where("doc_id is not null").join(ids.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti")
    return named.select(*docs.columns).unionAll(docs.where("doc_id is null"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The score is a column of the row itself, so nothing is shuffled."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.keep_below(docs, model, TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the least doc_id stays. A text that is null or has nothing but
    white space and control characters is no copy of another."""
    classes = neardup.similar_texts(docs.where(F.col("text").rlike(r"[^\p{Z}\p{Cc}]")), links=False)
    return without(docs, classes.where("id <> class_id").select(F.col("id").alias("doc_id")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found credentials are replaced by a mask; all documents stay."""
    return secrets.mask(docs, MASK)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of docs, all columns, with n_tokens, posteriors and rate: how often the document is to be drawn."""
    labels = label_domains(read_table(spark, sf_dir, "labels"))
    return mixing.mix(docs, docs, labels, MIX_TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("mixing", mix_domains),
]

#: Trained models, minhash and alignment are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are removed once the next one's are written; what the last one wrote stays for its reader."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs

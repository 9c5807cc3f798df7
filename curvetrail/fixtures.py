"""Tracks, frames, curves, intervals and answers as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.functions.geometry import exact_mean, num


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen users are a video; a user's events in order are an object's observations, cut into ids of 20."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    u, s = F.col("user_id"), F.col("seq")
    lane = u % 15
    e = e.withColumn("seq", seq).where((s % 20 != 19) & (F.col("value") > 1.0))
    small = lane == 14
    k = e.select(
        F.floor(u / 15).alias("video_id"), (s * 2).alias("frame_id"), (u * 100 + F.floor(s / 20)).alias("track_id"), (u % 3).alias("cls_id"),
        F.when(small, num(12)).otherwise(num(40) + 6 * (u % 5)).alias("w"),
        F.when(small, num(9)).otherwise(num(30) + (u % 5) * 4.5).alias("h"),
        (num(50) + 36 * lane + (u % 7 - 3) * num(0.8) * s + F.least("value", num(150)) / 6.0).alias("cx"),
        (num(60) + 24 * lane + (u % 4 - 1.5) * num(0.9) * s + F.least("value", num(150)) / 9.0).alias("cy"),
        "value",
    )
    x, y, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return k.select(
        "*", (x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2"), (w * h).alias("area"),
        num(640).alias("frame_w"), num(480).alias("frame_h"),
    )


def frames(tracks: DataFrame) -> DataFrame:
    """Every even frame up to a video's last, also those without objects."""
    last = tracks.groupBy("video_id").agg(F.max("frame_id").alias("m"))
    f = last.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), "m", F.lit(2).cast("long"))).alias("frame_id"))
    return f.select("video_id", F.floor(F.col("frame_id") / 2).alias("idx"), "frame_id")


def scores(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    mean = tracks.groupBy("video_id", "frame_id").agg(exact_mean(F.col("value")).alias("v"))
    joined = frames.join(mean, ["video_id", "frame_id"], "left")
    return joined.select("video_id", "idx", "frame_id", F.least(num(1), F.coalesce("v", num(0)) / 200.0).alias("score"))


def gt(tracks: DataFrame) -> DataFrame:
    """One labelled interval a video; a quarter of the videos is marked normal."""
    v = F.col("video_id")
    s = (v * 7) % 40 * 2
    last = tracks.groupBy("video_id").agg((F.max("frame_id") + 1).alias("total_frames"))
    normal = v % 4 == 3
    return last.select("video_id", "total_frames", F.when(normal, F.lit(-1)).otherwise(s).cast("long").alias("s"), F.when(normal, F.lit(-1)).otherwise(s + 20 + v % 9).cast("long").alias("e"))


def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "props")
    return e.select("event_id", F.floor(F.col("user_id") / 15).alias("video_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to score spans: JSON between other words."""
    k = F.col("k")
    raw = F.concat(F.lit('answer: {"anomaly_score": '), (k / 80.0).cast("string"), F.lit(', "confidence": '), ((99 - k) / 100.0).cast("string"), F.lit("} end"))
    return event_numbers(spark, sf_dir).select("event_id", "video_id", "k", raw.alias("raw"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with scores that tie."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.round(F.least("n_chars", F.lit(4000)) / 4000.0 + 1e-9, 2)
    return lab.join(d, "doc_id").select(F.col("doc_id").alias("ord"), F.col("quality").cast("long").alias("y"), score.alias("score"))

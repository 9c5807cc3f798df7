"""Nested JSON of tracks and its reader, CSV of curves, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvetrail.schema import TRACK_JSON


def tracks_by_frame(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a video: its frame ids and the objects on each frame, empty frames included."""
    obj = F.struct("track_id", "cls_id", "x1", "y1", "x2", "y2")
    per = tracks.groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_list(obj)).alias("tracks"))
    empty = F.array().cast("array<struct<track_id:bigint,cls_id:bigint,x1:double,y1:double,x2:double,y2:double>>")
    f = frames.join(per, ["video_id", "frame_id"], "left").select("video_id", F.struct("frame_id", F.coalesce("tracks", empty).alias("tracks")).alias("f"))
    rows = f.groupBy("video_id").agg(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["frame_id"] < b["frame_id"], -1).when(a["frame_id"] > b["frame_id"], 1).otherwise(0)).alias("tracks_per_frame"))
    return rows.select("video_id", F.transform("tracks_per_frame", lambda x: x["frame_id"]).alias("frame_ids"), "tracks_per_frame")


def write_tracks(tracks: DataFrame, frames: DataFrame, path: str) -> None:
    tracks_by_frame(tracks, frames).write.mode("overwrite").json(path)


def flat_tracks(nested: DataFrame) -> DataFrame:
    """Back to a row an object."""
    f = nested.select("video_id", F.explode("tracks_per_frame").alias("f")).select("video_id", "f.frame_id", F.explode("f.tracks").alias("t"))
    return f.select("video_id", "frame_id", "t.*")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks that were written before, so that they need not be made again."""
    return flat_tracks(spark.read.schema(TRACK_JSON).json(path))


def write_curves(curves: DataFrame, path: str) -> None:
    """A CSV with a header, by video."""
    curves.repartition("video_id").sortWithinPartitions("video_id", "frame_id").write.mode("overwrite").option("header", True).csv(path)


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet or JSON, a folder for each bucket of videos, so that readers prune."""
    df.withColumn("video_bucket", F.pmod(F.xxhash64("video_id"), F.lit(64))).write.mode("overwrite").partitionBy("video_bucket").format(kind).save(path)


def tracks_by_id(tracks: DataFrame) -> DataFrame:
    """One row a video: its tracks, each with its observations in frame order."""
    seen = F.struct("frame_id", "x1", "y1", "x2", "y2")
    per = tracks.groupBy("video_id", "track_id").agg(F.min_by("cls_id", "frame_id").alias("cls_id"), F.array_sort(F.collect_list(seen)).alias("seen"))
    return per.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("track_id", "cls_id", "seen"))).alias("tracks"))


def run_results(frames: DataFrame, spans: DataFrame, merged: DataFrame, window: int = 8) -> DataFrame:
    """One row a video, those without spans too: counts of sampled frames and windows, the proposed spans with their peaks
    and the merged ones, in order. frames: video_id, idx, frame_id; spans: video_id, start_frame, end_frame, peak_frame;
    merged: these and merged_id, fused_score. Each side is summed up by video before they meet."""
    span = F.struct("start_frame", "end_frame", "peak_frame")
    final = F.struct("start_frame", "end_frame", "peak_frame", "merged_id", "fused_score")
    f = frames.groupBy("video_id").agg(F.count("*").alias("num_sampled_frames"))
    s = spans.groupBy("video_id").agg(F.count("*").alias("num_pred_spans"), F.array_sort(F.collect_list(span)).alias("pred_spans"))
    m = merged.groupBy("video_id").agg(F.count("*").alias("num_final_spans"), F.array_sort(F.collect_list(final)).alias("final_spans"))
    out = f.join(s, "video_id", "left").join(m, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    windows = F.greatest(F.lit(0), F.col("num_sampled_frames") - (window - 1)).cast("long").alias("num_windows")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    kinds = {x.name: x.dataType.simpleString() for x in out.schema}
    return out.select("video_id", zero("num_sampled_frames"), windows, zero("num_pred_spans"), zero("num_final_spans"), none("pred_spans", kinds["pred_spans"]), none("final_spans", kinds["final_spans"]))

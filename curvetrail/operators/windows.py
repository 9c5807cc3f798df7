"""Sliding windows over sampled frames, and what lies on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sample_frames(frames: DataFrame, target_fps: float, source_fps: str = "source_fps") -> DataFrame:
    """Every stride-th frame; the stride is the ratio of the rates, half to even, 1 at least."""
    ratio = F.greatest(F.col(source_fps), F.lit(1.0)) / F.lit(max(float(target_fps), 1.0))
    stride = F.greatest(F.lit(1), F.bround(ratio, 0).cast("long"))
    return frames.withColumn("stride", stride).where(F.col("frame_id") % F.col("stride") == 0)


def with_idx(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Observations with the place of their frame among the sampled ones."""
    return tracks.join(frames.select("video_id", "frame_id", "idx"), ["video_id", "frame_id"])


def sliding_windows(frames: DataFrame, size: int = 8, step: int = 1) -> DataFrame:
    """video_id, window_id (place of the first frame), start_frame, end_frame. Ids start at 0 in every video."""
    w = W.partitionBy("video_id").orderBy("idx")
    out = frames.withColumn("start_frame", F.lag("frame_id", size - 1).over(w)).where((F.col("idx") >= size - 1) & ((F.col("idx") - (size - 1)) % step == 0))
    return out.select("video_id", (F.col("idx") - (size - 1)).alias("window_id"), "start_frame", F.col("frame_id").alias("end_frame"))


def windows_of(first: F.Column | str, last: F.Column | str):
    return F.explode(F.sequence(first, last))


def dense_curve(frames: DataFrame, curve: DataFrame, value: str = "score", size: int = 8, step: int = 1) -> DataFrame:
    """A window's value on its last frame; the first frames take the first window's, frames past the last one the
    last window's, and a video without windows 0. Only step 1 lines up with the frames; others are refused."""
    if step != 1:
        raise ValueError("a dense curve needs windows at every frame")
    n = curve.groupBy("video_id").agg((F.max("window_id") + 1).alias("_n"))
    placed = frames.join(n, "video_id", "left").withColumn("window_id", F.least(F.greatest(F.col("idx") - (size - 1), F.lit(0)), F.col("_n") - 1))
    joined = placed.join(curve.select("video_id", "window_id", value), ["video_id", "window_id"], "left")
    return joined.select("video_id", "idx", "frame_id", F.coalesce(value, F.lit(0.0)).alias(value))

"""Frames that stand for a span, crops, summaries and evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.functions.geometry import bround, num


def nearest_to_middle(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds the sampled frame of the span that is nearest to its middle (the first of equally near ones)."""
    on = spans.join(frames.select("video_id", "frame_id"), "video_id").where("frame_id between start_frame and end_frame")
    middle = (F.col("start_frame") + F.col("end_frame")) / 2.0
    return on.groupBy(*spans.columns).agg(F.min_by("frame_id", F.struct(F.abs(F.col("frame_id") - middle), "frame_id")).alias("middle_frame"))


def span_keyframes(start: Column, middle: Column, peak: Column, end: Column) -> Column:
    """Start, middle, peak and end, each once, in this order."""
    return F.array_distinct(F.array(start, middle, peak, end))


def select_keyframes(start: Column, end: Column, peak: Column, n: int = 4) -> Column:
    """n frames from start in even steps, the last one the end; the peak, if not among them, takes the middle place."""
    step = F.greatest(F.lit(1), F.floor((end - start) / max(n - 1, 1)))
    picks = F.array(*[(start + step * i) if i < n - 1 else end for i in range(n)])
    spot = min(n - 1, n // 2)
    swapped = F.array(*[peak if i == spot else (start + step * i) if i < n - 1 else end for i in range(n)])
    chosen = F.when(F.array_contains(picks, peak), picks).otherwise(swapped)
    return F.when(end <= start, F.array(start)).otherwise(F.array_sort(F.array_distinct(chosen)))


def crop_boxes(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """The padded box around all boxes of a group, held to the frame; the whole frame if nothing is left of it."""
    g = tracks.groupBy(*keys).agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"), F.max("frame_w").alias("w"), F.max("frame_h").alias("h"))
    pad_x = F.greatest(num(12), (F.col("c") - F.col("a") + 1.0) * 0.15)
    pad_y = F.greatest(num(12), (F.col("d") - F.col("b") + 1.0) * 0.15)
    low = lambda x: F.greatest(num(0), bround(x))
    x1, y1 = low(F.col("a") - pad_x), low(F.col("b") - pad_y)
    x2, y2 = F.least(F.col("w"), bround(F.col("c") + pad_x)), F.least(F.col("h"), bround(F.col("d") + pad_y))
    g = g.select(*keys, "w", "h", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    bad = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    pick = lambda whole, c: F.when(bad, whole).otherwise(F.col(c)).cast("long").alias(f"crop_{c}")
    return g.select(*keys, pick(num(0), "x1"), pick(num(0), "y1"), pick(F.greatest(num(1), "w"), "x2"), pick(F.greatest(num(1), "h"), "y2"))


def event_summary() -> Column:
    """What a prompt is told of a span."""
    return F.struct(
        F.col("span_id").alias("event_id"), "start_frame", "end_frame", "peak_frame", "eventness_peak", "eventness_mean",
        F.col("prior_score").alias("span_prior_score"),
    )


def evidence_frames(spans: DataFrame, frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """A row for each key frame of each span (peak_frame given), in order, with the objects on it."""
    keyed = nearest_to_middle(spans, frames)
    pos = keyed.select("video_id", "start_frame", "end_frame", F.posexplode(span_keyframes(F.col("start_frame"), F.col("middle_frame"), F.col("peak_frame"), F.col("end_frame"))).alias("pos", "frame_id"))
    n = tracks.groupBy("video_id", "frame_id").agg(F.count("*").alias("n"))
    return pos.join(n, ["video_id", "frame_id"], "left").select("video_id", "start_frame", "end_frame", F.col("pos").cast("long").alias("pos"), "frame_id", F.coalesce("n", F.lit(0)).alias("n_tracks"))

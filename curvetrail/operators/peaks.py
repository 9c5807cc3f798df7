"""Spans around the peaks of a curve.

Thresholds, local maxima, spans and anchors are window functions and range lookups. The two greedy choices (peaks far
enough apart, spans far enough apart) are folds, as higher-order functions, over clusters: peaks or spans in a row
of which each is close to some one before it. What lies in different clusters cannot clash, so a long series costs what its
clusters cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.config import Boundary
from curvetrail.functions.geometry import finite, num
from curvetrail.functions.signals import local_peak, with_median


def sanitize(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", finite(F.col("score")))


def check_frames(scores: DataFrame) -> DataFrame:
    """Fails where frame ids fall along idx."""
    w = W.partitionBy("video_id").orderBy("idx")
    ok = F.assert_true(F.coalesce(F.col("frame_id") >= F.lag("frame_id").over(w), F.lit(True)), "frame ids must ascend")
    return scores.withColumn("_ok", ok).where("_ok is null").drop("_ok")


def with_thresholds(scores: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    """Adds median, sigma, high and max_score of the video to each frame."""
    w = W.partitionBy("video_id")
    s = with_median(sanitize(scores), "score", ["video_id"], "median", "_off")
    sigma = F.greatest(num(1e-6), F.percentile("_off", F.lit(0.5)).over(w) * 1.4826)
    s = s.withColumns({"sigma": sigma, "max_score": F.max("score").over(w)}).drop("_off")
    return s.withColumn("high", F.col("median") + F.col("sigma") * cfg.high_z)


def boundary_thresholds(scores: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    """median, sigma, high and max_score of each video."""
    names = ["median", "sigma", "high", "max_score"]
    return with_thresholds(scores, cfg).groupBy("video_id").agg(*[F.first(c).alias(c) for c in names])


def local_peaks(scores: DataFrame) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("idx")
    return sanitize(scores).withColumn("peak", local_peak(F.col("score"), w)).where("peak").drop("peak")


def high_peaks(scores: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    """Local maxima at or over both thresholds."""
    w = W.partitionBy("video_id").orderBy("idx")
    s = with_thresholds(scores, cfg).withColumn("peak", local_peak(F.col("score"), w))
    return s.where(F.col("peak") & (F.col("score") >= F.greatest("high", num(cfg.min_peak)))).select(*scores.columns)


def _ranked(*fields: str) -> Column:
    """A video's peaks, highest first, of equal height the earlier one."""
    return F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), F.col("idx").alias("idx"), *[F.col(f).alias(f) for f in fields])))


def _fold(items: Column, kind: str, clashes) -> Column:
    """Keeps each item that clashes with none kept before."""
    return F.aggregate(items, F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: clashes(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def _clustered(df: DataFrame, first: str, last: str, reach: int) -> DataFrame:
    """Adds the number of the cluster: a new one begins where a row starts more than reach past all ends before it."""
    w = W.partitionBy("video_id").orderBy(first, last)
    cut = F.col(first) > F.max(last).over(w.rowsBetween(W.unboundedPreceding, -1)) + reach
    return df.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(0))).withColumn("_cluster", F.sum("_cut").over(w)).drop("_cut")


def nms_peaks(peaks: DataFrame, cfg: Boundary = Boundary(), *carried: str) -> DataFrame:
    """Strongest first, those more than peak_gap frames from all kept. carried: other columns to keep (bigint)."""
    names = ["frame_id", *carried]
    kind = "array<struct<low:double,idx:bigint," + ",".join(f"{c}:bigint" for c in names) + ">>"
    kept = _fold(F.col("items"), kind, lambda k, x: F.abs(k["frame_id"] - x["frame_id"]) <= cfg.peak_gap)
    grouped = _clustered(peaks, "frame_id", "frame_id", int(cfg.peak_gap)).groupBy("video_id", "_cluster").agg(_ranked(*names).alias("items"))
    out = grouped.select("video_id", F.explode(kept).alias("p"))
    return out.select("video_id", F.col("p.idx").alias("idx"), *[F.col(f"p.{c}").alias(c) for c in names], (-F.col("p.low")).alias("score"))


def frame_spans(frames: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    """For every frame the first and last sampled frame within reach of it, by a range frame over frame numbers."""
    w = W.partitionBy("video_id").orderBy("frame_id").rangeBetween(-int(cfg.expand[0]), int(cfg.expand[1]))
    span = {"start_idx": F.min("idx"), "end_idx": F.max("idx"), "start_frame": F.min("frame_id"), "end_frame": F.max("frame_id")}
    return frames.select("video_id", "idx", "frame_id", *[e.over(w).alias(c) for c, e in span.items()])


def peak_spans(peaks: DataFrame, frames: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    return peaks.join(frame_spans(frames, cfg).drop("frame_id"), ["video_id", "idx"])


def _close(cfg: Boundary):
    return lambda a, b: (a["start_frame"] <= b["end_frame"] + cfg.merge_gap) & (b["start_frame"] <= a["end_frame"] + cfg.merge_gap)


SPAN = "start_frame:bigint,end_frame:bigint,start_idx:bigint,end_idx:bigint"


def greedy_spans(spans: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    """Strongest first, spans that keep more than merge_gap frames from all kept."""
    kept = _fold(F.col("items"), f"array<struct<low:double,idx:bigint,{SPAN}>>", _close(cfg))
    near = _clustered(spans, "start_frame", "end_frame", int(cfg.merge_gap))
    grouped = near.groupBy("video_id", "_cluster").agg(_ranked("start_frame", "end_frame", "start_idx", "end_idx").alias("items"))
    out = grouped.select("video_id", F.explode(kept).alias("p"))
    return out.select("video_id", F.col("p.idx").alias("peak_idx"), *[F.col(f"p.{c}").alias(c) for c in ("start_idx", "end_idx", "start_frame", "end_frame")], (-F.col("p.low")).alias("score"))


def anchors(frames: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    """The frames nearest to evenly spread targets (of equally near ones the first), each once, in order of target."""
    ends = frames.groupBy("video_id").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("z"))
    n = cfg.anchors
    target = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("a") + (F.col("z") - F.col("a")) * (k / max(1, n - 1))).alias("target")) for k in range(n)]))
    t = ends.select("video_id", target.alias("t")).select("video_id", "t.k", "t.target")
    near = frames.join(t, "video_id").groupBy("video_id", "k").agg(F.min_by(F.struct("idx", "frame_id"), F.struct(F.abs(F.col("frame_id") - F.col("target")), "idx")).alias("f"))
    return near.groupBy("video_id", F.col("f.idx").alias("idx"), F.col("f.frame_id").alias("frame_id")).agg(F.min("k").cast("long").alias("k"))


def anchor_spans(frames: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    a = anchors(frames, cfg).join(frame_spans(frames, cfg).drop("frame_id"), ["video_id", "idx"])
    return a.groupBy("video_id", "start_idx", "end_idx", "start_frame", "end_frame").agg(F.min("k").alias("k"))


def _nearest(k: int, cfg: Boundary, names: list[str]) -> Column:
    """Within a video: what the frame nearest to target k has (of equally near ones the first)."""
    target = F.col("_a") + (F.col("_z") - F.col("_a")) * (k / max(1, cfg.anchors - 1))
    return F.min_by(F.struct("idx", *names), F.struct(F.abs(F.col("frame_id") - target), "idx"))


def boundary_spans(scores: DataFrame, cfg: Boundary = Boundary()) -> DataFrame:
    """Kept spans and, where no kept or earlier one is too close, anchor spans: video_id, start_idx, end_idx,
    start_frame, end_frame, is_anchor. A curve that stays under min_peak has anchor spans alone. Thresholds, peaks and
    spans of all frames come from windows by video in one shuffle, which both the peaks and the anchors read."""
    names = ["start_frame", "end_frame", "start_idx", "end_idx"]
    w, whole = W.partitionBy("video_id").orderBy("idx"), W.partitionBy("video_id")
    reach = W.partitionBy("video_id").orderBy("frame_id").rangeBetween(-int(cfg.expand[0]), int(cfg.expand[1]))
    s = with_thresholds(check_frames(sanitize(scores)), cfg)
    s = s.withColumns({"peak": local_peak(F.col("score"), w), "_a": F.min("frame_id").over(whole), "_z": F.max("frame_id").over(whole)})
    ends = {"start_idx": F.min("idx"), "end_idx": F.max("idx"), "start_frame": F.min("frame_id"), "end_frame": F.max("frame_id")}
    s = s.withColumns({c: e.over(reach).cast("long") for c, e in ends.items()})
    high = s.where(F.col("peak") & (F.col("score") >= F.greatest("high", num(cfg.min_peak))) & (F.col("max_score") >= cfg.min_peak))
    kept = greedy_spans(nms_peaks(high.select("video_id", "idx", "frame_id", "score", *names), cfg, *names), cfg)
    have = kept.groupBy("video_id").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in names])).alias("kept"))
    facts = s.groupBy("video_id").agg((F.max("score") < cfg.min_peak).alias("quiet"), F.array(*[_nearest(k, cfg, names) for k in range(cfg.anchors)]).alias("near"))
    both = facts.join(have, "video_id", "left")
    kind = f"array<struct<{SPAN}>>"
    first = F.coalesce("kept", F.array().cast(kind))
    bare = F.array_distinct(F.transform("near", lambda x: F.struct(*[x[c].cast("long").alias(c) for c in names])))
    close = _close(cfg)
    joined = F.aggregate(bare, first, lambda acc, x: F.when(~F.col("quiet") & F.exists(acc, lambda k: close(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    placed = both.withColumn("n", F.size(first)).select("video_id", "n", F.posexplode(joined).alias("at", "s"))
    return placed.select("video_id", F.col("s.start_idx").alias("start_idx"), F.col("s.end_idx").alias("end_idx"), F.col("s.start_frame").alias("start_frame"), F.col("s.end_frame").alias("end_frame"), (F.col("at") >= F.col("n")).alias("is_anchor"))

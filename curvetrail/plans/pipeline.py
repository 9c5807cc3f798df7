"""Whole analyses: tracks to merged spans, and windows scored by a model to intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.config import EngineConfig
from curvetrail.functions.signals import savgol, series, smooth_edge, top_share_mean
from curvetrail.operators import gate, metrics, motion, peaks, scene, spans, tracks, windows
from curvetrail.operators.plugins import FeatureSet
from curvetrail.plans.staging import staged


def analyze(
    observations: DataFrame, frames: DataFrame, answers: DataFrame | None = None, cfg: EngineConfig = EngineConfig(), plugins: FeatureSet | None = None
) -> dict[str, DataFrame]:
    """Repair ids, window features, gate, dense and smoothed curve, spans; with answers (video_id, span_no, raw) also
    scored and merged spans. plugins: further features that the gate listens to. All videos at once; every step is keyed by
    video_id."""
    ids = tracks.refine_ids(observations, cfg.refinement)
    ids = staged(ids, "id-map")
    refined = staged(tracks.apply_id_map(observations, ids), "tracks")
    frames = staged(frames, "frames")
    size = cfg.sampling.window
    features = motion.track_features(refined, frames, size, cfg.motion).join(scene.scene_counts(refined, frames, size), ["video_id", "window_id"])
    if plugins:
        features = plugins.extend(features, refined, frames, size)
    features = staged(features, "features")
    curves = gate.trigger_curve(features, plugins.gate(cfg.gate) if plugins else cfg.gate)
    dense = windows.dense_curve(frames, curves, "trigger", size).withColumnRenamed("trigger", "raw_score")
    scores = dense.withColumn("score", smooth_edge(F.col("raw_score"), series("video_id"), cfg.boundary.smooth))
    scores = staged(scores, "scores")
    found = peaks.boundary_spans(scores.select("video_id", "idx", "frame_id", "score"), cfg.boundary)
    out = {"id_map": ids, "tracks": refined, "features": features, "curves": curves, "scores": scores, "spans": found}
    if answers is not None:
        out["merged"] = spans.refine_spans(found.select("video_id", "start_frame", "end_frame"), scores, answers, cfg.spans)
    return out


def window_baseline(frames: DataFrame, chunk_scores: DataFrame, cfg: EngineConfig = EngineConfig()) -> dict[str, DataFrame]:
    """chunk_scores: video_id, window_no, chunk, score. Frame scores, smoothed, and predicted intervals of frames."""
    c = cfg.chunks
    scored = spans.chunk_windows(frames, c).join(chunk_scores, ["video_id", "window_no", "chunk"])
    raw = spans.chunk_projection(frames, scored).withColumnRenamed("score", "raw")
    smooth = savgol(raw, "raw", "score", ["video_id"], c.savgol_window, c.savgol_order, c.average_window)
    found = spans.mask_intervals(smooth, F.col("score") > c.threshold, ["video_id"], c.merge_gap, c.min_len)
    return {"scores": smooth, "intervals": spans.to_frames(found, frames)}


def evaluate(scores: DataFrame, labels: DataFrame, threshold: float = 0.5, share: float = 0.10) -> DataFrame:
    """Pooled measures of frames (of videos with labels) and of videos (mean of the highest frames): level and values.
    labels: video_id, idx, y, video_y."""
    joined = scores.select("video_id", "idx", "score").join(labels.select("video_id", "idx", "y", "video_y"), ["video_id", "idx"])
    joined = staged(joined, "labelled-scores")  # read by both levels, and by the ranking's own sample
    frame = joined.where("video_y = 1").select(F.lit("frame").alias("level"), F.struct("video_id", "idx").alias("ord"), "y", "score")
    top = top_share_mean(joined, "score", "score", ["video_id", "video_y"], share)
    video = top.select(F.lit("video").alias("level"), F.struct("video_id", F.lit(0).cast("long").alias("idx")).alias("ord"), F.col("video_y").alias("y"), "score")
    rows = frame.unionAll(video)
    keys = ["level"]
    counts = staged(metrics.ranked_counts(rows, keys), "ranking")
    n = counts.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    curve = metrics.curve_of(metrics.by_threshold(counts, keys), keys)
    for part in (metrics.auc_of(counts, keys), metrics.precision_of(counts, keys), metrics.eer_of(curve, keys), metrics.accuracy_at(counts, keys, threshold)):
        n = n.join(part, keys, "left")
    return n

"""Intervals: islands of a mask, scored spans, fusion with model scores, merging, and windows of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.config import Chunks, Spans
from curvetrail.functions.geometry import clip01, num
from curvetrail.functions.parse import with_answer


def mask_intervals(df: DataFrame, mask: Column, keys: list[str], gap: int = 8, least: int = 10, order: str = "idx") -> DataFrame:
    """Runs of true places; runs with at most gap false places between them are one; short ones go last."""
    w = W.partitionBy(*keys).orderBy(order)
    on = df.where(mask).select(*keys, order)
    # a run goes on over up to `gap` false places
    starts = on.withColumn("new", (F.coalesce(F.col(order) - F.lag(order).over(w), F.lit(1 << 30)) > gap + 1).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(w)).groupBy(*keys, "run").agg(F.min(order).alias("s"), F.max(order).alias("e"))
    return runs.where(F.col("e") - F.col("s") + 1 >= max(1, least)).drop("run")


def to_frames(intervals: DataFrame, frames: DataFrame, keys: list[str] = ["video_id"]) -> DataFrame:
    """Intervals of places as intervals of frame numbers, places held to those there are."""
    last = frames.groupBy(*keys).agg(F.max("idx").alias("_last"))
    held = intervals.join(last, keys)
    for c in ("s", "e"):
        held = held.withColumn(c, F.greatest(F.lit(0), F.least(c, "_last")))
    a = frames.select(*keys, F.col("idx").alias("s"), F.col("frame_id").alias("start_frame"))
    z = frames.select(*keys, F.col("idx").alias("e"), F.col("frame_id").alias("end_frame"))
    return held.drop("_last").join(a, [*keys, "s"]).join(z, [*keys, "e"])


def span_gaps(spans: DataFrame) -> DataFrame:
    """Ends in order, and the frames to the span before and after (0 at the ends and where they overlap)."""
    a, z = F.least("start_frame", "end_frame"), F.greatest("start_frame", "end_frame")
    s = spans.withColumns({"start_frame": a, "end_frame": z})
    w = W.partitionBy("video_id").orderBy("start_frame", "end_frame")
    left = F.greatest(F.lit(0), F.coalesce(F.col("start_frame") - F.lag("end_frame").over(w), F.lit(0)))
    right = F.greatest(F.lit(0), F.coalesce(F.lead("start_frame").over(w) - F.col("end_frame"), F.lit(0)))
    return s.withColumns({"span_no": F.row_number().over(w).cast("long"), "left_gap": left.cast("long"), "right_gap": right.cast("long")})


def span_prior(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """Peak (the first of equals), mean and prior score of the curve on each span. Ends must be sampled frames."""
    places = scores.select("video_id", F.col("frame_id"), F.col("idx"))
    a = places.select("video_id", F.col("frame_id").alias("start_frame"), F.col("idx").alias("start_idx"))
    z = places.select("video_id", F.col("frame_id").alias("end_frame"), F.col("idx").alias("end_idx"))
    s = spans.join(a, ["video_id", "start_frame"], "left").join(z, ["video_id", "end_frame"], "left")
    off = F.col("start_idx").isNull() | F.col("end_idx").isNull()
    s = s.withColumn("start_idx", F.when(off, F.raise_error(F.lit("a span does not end on sampled frames")).cast("long")).otherwise(F.col("start_idx")))
    on = s.withColumn("idx", F.explode(F.sequence("start_idx", "end_idx"))).join(scores.select("video_id", "idx", "frame_id", "score"), ["video_id", "idx"])
    keys = [c for c in s.columns]
    best = F.max_by(F.struct("idx", "frame_id"), F.struct("score", -F.col("idx")))
    out = on.groupBy(*keys).agg(best.alias("b"), F.max("score").alias("eventness_peak"), F.avg("score").alias("eventness_mean"))
    prior = F.col("eventness_peak") * 0.7 + F.col("eventness_mean") * 0.3
    return out.select(*keys, F.col("b.idx").alias("peak_idx"), F.col("b.frame_id").alias("peak_frame"), "eventness_peak", "eventness_mean", prior.alias("prior_score"))


def fuse_scores(spans: DataFrame, raw: str = "raw", cfg: Spans = Spans()) -> DataFrame:
    """A span's prior with what the model's answer says. An unsure answer counts as the prior; a score of 0 does too."""
    prior = clip01(F.col("prior_score"))
    s = with_answer(spans, raw, "span_score", "_a")
    conf = clip01(F.col("_a.confidence"))
    vlm = F.when(conf < cfg.min_confidence, prior).otherwise(clip01(F.col("_a.anomaly_score")))
    s = s.withColumns({"vlm_confidence": conf, "vlm_score": vlm})
    used = clip01(F.when(F.col("vlm_score") > 0, F.col("vlm_score")).otherwise(prior))
    fused = clip01((num(1) - F.col("vlm_confidence")) * prior + F.col("vlm_confidence") * used)
    return s.withColumn("fused_score", fused).withColumn("is_positive", F.col("fused_score") >= cfg.positive_from).drop("_a", raw)


def merge_spans(spans: DataFrame, gap: int = 10) -> DataFrame:
    """Positive spans in a row become one: a span that is not positive always parts them, a distance over gap does if
    gap is positive. Ends then grow by half the distance to the neighbours (of all spans), if that is within gap."""
    gap = max(0, gap)
    w = W.partitionBy("video_id").orderBy("start_frame", "end_frame")
    prev_on, prev_end = F.lag("is_positive").over(w), F.lag("end_frame").over(w)
    cut = F.coalesce(~prev_on, F.lit(True))
    if gap > 0:
        cut = cut | (F.col("start_frame") - prev_end > gap)
    s = spans.withColumn("_cut", cut.cast("int")).where("is_positive").withColumn("ord", F.row_number().over(w))
    s = s.withColumn("grp", F.sum("_cut").over(w))
    rank = F.struct("fused_score", "vlm_score", "prior_score", "eventness_peak", -F.col("ord"))
    most = ["eventness_peak", "prior_score", "vlm_score", "vlm_confidence", "fused_score"]
    m = s.groupBy("video_id", "grp").agg(
        F.min_by("start_frame", "ord").alias("start_frame"), F.max_by("end_frame", "ord").alias("end_frame"),
        F.max_by("peak_frame", rank).alias("peak_frame"), F.min_by("left_gap", "ord").alias("left_gap"), F.max_by("right_gap", "ord").alias("right_gap"),
        F.avg("eventness_mean").alias("eventness_mean"), F.count("*").alias("n_spans"), *[F.max(c).alias(c) for c in most],
    )
    grow = lambda c: F.when((F.col(c) > 0) & (F.col(c) <= gap), F.floor(F.col(c) / 2)).otherwise(F.lit(0))
    m = m.withColumns({"start_frame": F.greatest(F.lit(0), F.col("start_frame") - grow("left_gap")), "end_frame": F.col("end_frame") + grow("right_gap")})
    return m.withColumn("merged_id", F.concat(F.lit("merged."), F.col("grp").cast("string"))).drop("grp")


def refine_spans(spans: DataFrame, scores: DataFrame, answers: DataFrame, cfg: Spans = Spans()) -> DataFrame:
    """spans (video_id, start_frame, end_frame), a curve, and answers (video_id, span_no, raw) to merged spans."""
    proposals = span_prior(span_gaps(spans), scores)
    scored = fuse_scores(proposals.join(answers, ["video_id", "span_no"], "left"), cfg=cfg)
    return merge_spans(scored, cfg.merge_gap)


def chunk_windows(frames: DataFrame, cfg: Chunks = Chunks()) -> DataFrame:
    """Windows of whole videos of enough frames, cut into chunks: video_id, window_no, chunk, first and last place.
    What a window's length leaves over after equal chunks belongs to none."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.window)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - cfg.window, F.lit(cfg.step).cast("long")))
    w = n.select("video_id", start.alias("start")).withColumn("window_no", (F.col("start") / cfg.step).cast("long"))
    size = cfg.window // cfg.chunks
    c = w.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cfg.chunks - 1).cast("long"))))
    first = F.col("start") + F.col("chunk") * size
    return c.select("video_id", "window_no", "chunk", first.alias("first_idx"), (first + size - 1).alias("last_idx"))


def uniform_sample(n: Column, k: int) -> Column:
    """k places spread over 0..n-1, half to even; one place for k <= 1, the same one k times for n = 1."""
    if k <= 1:
        return F.array(F.lit(0).cast("long"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i.cast("double") * (n - 1) / float(k - 1), 0).cast("long"))
    return F.when(n <= 1, F.array_repeat(F.lit(0).cast("long"), k)).otherwise(spread)


def chunk_projection(frames: DataFrame, chunks: DataFrame, score: str = "score") -> DataFrame:
    """The highest score of the chunks that lie on each frame; 0 and not covered where there is none."""
    on = chunks.select("video_id", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"), score)
    top = on.groupBy("video_id", "idx").agg(F.max(score).alias("score"))
    return frames.join(top, ["video_id", "idx"], "left").select("video_id", "idx", "frame_id", F.coalesce("score", num(0)).alias("score"), F.col("score").isNotNull().alias("scored"))


def coverage(frames: DataFrame, cfg: Chunks = Chunks()) -> DataFrame:
    """Frames that lie in some window, by video (videos too short for a window have none)."""
    w = chunk_windows(frames, cfg).where("chunk = 0").select("video_id", F.explode(F.sequence(F.col("first_idx"), F.col("first_idx") + cfg.window - 1)).alias("idx")).distinct()
    n = frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    got = w.groupBy("video_id").agg(F.count("*").alias("covered"))
    return n.join(got, "video_id", "left").select("video_id", "n_frames", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) / F.col("n_frames")).alias("ratio"))


def frame_labels(frames: DataFrame, gt: DataFrame, drop_negative: bool = True) -> DataFrame:
    """1 on places that lie in a labelled interval, else 0. An interval of negative ends labels nothing; unless
    drop_negative, its video still counts as one with intervals."""
    on = gt.where("e >= 0").select("video_id", F.greatest(F.lit(0), F.col("s")).alias("s"), "e")
    n = frames.groupBy("video_id").agg(F.max("idx").alias("m"))
    hit = on.join(n, "video_id").where("s <= least(e, m)").select("video_id", F.explode(F.expr("sequence(s, least(e, m))")).alias("idx")).distinct().withColumn("y", F.lit(1))
    has = gt.where("e >= 0" if drop_negative else "true").select("video_id").distinct().withColumn("video_y", F.lit(1))
    out = frames.join(hit, ["video_id", "idx"], "left").join(has, "video_id", "left")
    return out.select("video_id", "idx", "frame_id", F.coalesce("y", F.lit(0)).cast("long").alias("y"), F.coalesce("video_y", F.lit(0)).cast("long").alias("video_y"))

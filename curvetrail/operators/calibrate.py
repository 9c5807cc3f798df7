"""Distributions of track measures outside labelled intervals, and parameters that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.config import Motion
from curvetrail.functions.geometry import area_ratio, box, box_iou, diagonal, edge_distance, num, point_x, point_y, scale
from curvetrail.operators.ranking import exact_percentiles
from curvetrail.plans.staging import staged

QUANTILES = [5, 25, 50, 75, 85, 90, 95, 98, 99]

#: Parameter, distribution, percentile, value without data, least, most: fixed values.
RULES = [
    ("STATIC_MOVE_RATIO", "track_disp_ratio", 35, 0.15, 0.10, 0.30),
    ("DISAPPEAR_FAR_EDGE_RATIO", "disappear_edge_norm", 90, 0.18, 0.15, 0.25),
    ("MIN_TURN_SPEED_RATIO", "low_disp_step_ratio", 90, 0.05, 0.03, 0.10),
    ("MIN_DIR_MOTION_RATIO", "low_disp_step_ratio", 85, 0.04, 0.03, 0.10),
    ("MIN_DIR_MOTION_PX", "low_disp_step_px", 90, 3.0, 2.0, 8.0),
    ("MAX_MOTION_AREA_RATIO", "area_ratio", 99, 1.5, 1.5, 3.0),
    ("MAX_STEP_RATIO", "step_ratio", 98, 1.5, 1.0, 3.0),
]


#: Parameters that are passed on as they are: fixed names, values from the settings.
PASSED_ON = {
    "DISAPPEAR_LOOKAHEAD": "lookahead", "DISAPPEAR_MIN_TRACK_LEN": "min_seen", "TURN_CHANGE_RATIO": "turn_limit", "SPEED_SCALING_FACTOR": "speed_factor",
    "TOPK_AGG_COUNT": "top_k", "EDGE_UNSTABLE_RATIO": "edge_ratio", "REPLACEMENT_CENTER_RATIO": "near_ratio", "REPLACEMENT_IOU": "near_iou",
    "TRACK_POINT_Y_RATIO": "point_height",
}


#: Frames of a bin of the anti join with labelled intervals.
BIN = 512


def outside(rows: DataFrame, gt: DataFrame) -> DataFrame:
    """Rows whose frame lies in no labelled interval of their video. A row meets only intervals that reach into its own
    bin of frames."""
    spread = F.explode(F.sequence(F.floor(F.col("s") / BIN), F.floor(F.col("e") / BIN)))
    g = gt.where("e >= 0 and s <= e").select(F.col("video_id").alias("_v"), "s", "e", spread.alias("_bin"))
    here = (F.col("video_id") == F.col("_v")) & (F.floor(F.col("frame_id") / BIN) == F.col("_bin"))
    return rows.join(g, here & (F.col("frame_id") >= F.col("s")) & (F.col("frame_id") <= F.col("e")), "left_anti")


def calib_stats(tracks: DataFrame, frames: DataFrame, gt: DataFrame, window: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """Long rows (video_id, stat, value) of ten measures. Observations in labelled intervals leave before pairs are
    made, so a pair may bridge an interval."""
    kept = ["video_id", "frame_id", "track_id", "cls_id", "x1", "y1", "x2", "y2", "area", "frame_w", "frame_h"]
    free = staged(outside(tracks.select(*kept), gt).withColumns({"px": point_x(), "py": point_y(height=cfg.point_height)}), "free")  # read twice
    w = W.partitionBy("video_id", "track_id").orderBy("frame_id")
    whole = W.partitionBy("video_id", "track_id")
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    prev = {f"p_{c}": F.lag(c).over(w) for c in ("px", "py", "area")}
    t = free.withColumns(prev | {
        "n": F.count("*").over(whole), "nth": F.row_number().over(w), "mean_area": F.avg("area").over(whole),
        "fx": F.first("px").over(full), "fy": F.first("py").over(full), "lx": F.last("px").over(full), "ly": F.last("py").over(full),
    })
    fw, fh = F.greatest(num(1), "frame_w"), F.greatest(num(1), "frame_h")
    disp = F.hypot(F.col("lx") - F.col("fx"), F.col("ly") - F.col("fy")) / F.sqrt(F.greatest(num(1), F.col("mean_area")))
    edge = edge_distance(F.col("px"), F.col("py"), fw, fh) / diagonal(fw, fh)
    px = F.hypot(F.col("px") - F.col("p_px"), F.col("py") - F.col("p_py"))
    t = t.withColumns({
        "disp": disp, "edge": edge, "step_px": px, "step_ratio": px / F.greatest(num(1), (scale(F.col("p_area")) + scale(F.col("area"))) * 0.5),
        "pair_area": area_ratio(F.col("p_area"), F.col("area")),
    })
    low = (F.col("n") >= 3) & (F.col("disp") < 0.5)
    before = {c: F.lag(c).over(w) for c in ("step_px", "step_ratio")}
    pair = F.col("nth") > 1
    t = t.withColumns({"before_px": before["step_px"], "before_ratio": before["step_ratio"]})
    triple = F.col("nth") > 2
    both = lambda a, b: F.when(triple, F.least(F.col(a), F.col(b)))
    entries = {
        "track_disp_ratio": F.when((F.col("nth") == 1) & (F.col("n") >= max(3, window)), F.col("disp")),
        "edge_distance_norm": F.col("edge"), "area_ratio": F.when(pair, F.col("pair_area")),
        "step_ratio": F.when(pair, F.col("step_ratio")), "step_px": F.when(pair, F.col("step_px")),
        "low_disp_step_ratio": F.when(pair & low, F.col("step_ratio")), "low_disp_step_px": F.when(pair & low, F.col("step_px")),
        "triplet_min_step_ratio": both("before_ratio", "step_ratio"), "triplet_min_step_px": both("before_px", "step_px"),
    }
    long = t.select("video_id", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("value")) for k, v in entries.items()])).alias("e"))
    long = long.select("video_id", "e.stat", "e.value").where("value is not null")
    return long.unionAll(_vanished(free, frames, cfg))


def _vanished(free: DataFrame, frames: DataFrame, cfg: Motion) -> DataFrame:
    """Edge distance of objects that are gone from the next sampled frames and not replaced close by."""
    ends = frames.select("video_id", "frame_id", "idx", F.max("idx").over(W.partitionBy("video_id")).alias("last_idx"))
    w = W.partitionBy("video_id", "track_id").orderBy("idx")
    per = W.partitionBy("video_id", "idx")
    t = free.join(ends, ["video_id", "frame_id"])
    t = staged(t.withColumns({"next_idx": F.lead("idx").over(w), "seen": F.row_number().over(w), "mw": F.max("frame_w").over(per), "mh": F.max("frame_h").over(per)}), "followed")
    gone = t.where((F.col("idx") < F.col("last_idx")) & (F.col("seen") >= cfg.min_seen) & (F.col("next_idx").isNull() | (F.col("next_idx") > F.col("idx") + cfg.lookahead)))
    gone = gone.withColumn("diag", diagonal(F.col("mw"), F.col("mh")))
    look = gone.withColumn("look", F.explode(F.array(*[F.col("idx") + k for k in range(1, cfg.lookahead + 1)])))
    other = t.select("video_id", "cls_id", F.col("idx").alias("look"), *[F.col(c).alias(f"o_{c}") for c in ("track_id", "x1", "y1", "x2", "y2", "px", "py")])
    met = look.join(other, ["video_id", "cls_id", "look"]).where("track_id <> o_track_id")
    close = F.hypot(F.col("o_px") - F.col("px"), F.col("o_py") - F.col("py")) / F.col("diag") <= cfg.near_ratio
    near = met.where(close | (box_iou(box(""), box("o_"), floor=True) >= cfg.near_iou)).select("video_id", "track_id", "idx").distinct()
    fw, fh = F.greatest(num(1), "frame_w"), F.greatest(num(1), "frame_h")
    left = gone.join(near, ["video_id", "track_id", "idx"], "left_anti")
    return left.select("video_id", F.lit("disappear_edge_norm").alias("stat"), (edge_distance(F.col("px"), F.col("py"), fw, fh) / diagonal(fw, fh)).alias("value"))


def calib_percentiles(stats: DataFrame) -> DataFrame:
    """Count and exact percentiles of each measure over all videos."""
    p = exact_percentiles(stats, ["stat"], "value", [q / 100 for q in QUANTILES])
    return p.select("stat", "n", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate(QUANTILES)])


def calib_recommend(stats: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """Parameter and value: a percentile of its measure, held to a range; parameters without a measure as they are."""
    wanted = sorted({q for _, _, q, _, _, _ in RULES})
    p = exact_percentiles(stats, ["stat"], "value", [q / 100 for q in wanted]).drop("n")
    rules = stats.sparkSession.createDataFrame([(a, b, wanted.index(q), d, lo, hi) for a, b, q, d, lo, hi in RULES], "parameter string, stat string, at int, base double, low double, high double")
    found = rules.join(p, "stat", "left")
    value = F.coalesce(F.get(F.col("p"), F.col("at")), F.col("base"))
    fixed = stats.sparkSession.createDataFrame([(k, float(getattr(cfg, v))) for k, v in PASSED_ON.items()], "parameter string, value double")
    return found.select("parameter", F.least("high", F.greatest("low", value)).alias("value")).unionAll(fixed)

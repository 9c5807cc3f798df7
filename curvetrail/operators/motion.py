"""Motion features of sliding windows.

What a window says of the objects on its last frame needs only each object's own last `size` observations, so it comes
from range frames over (video, track) without exploding observations into windows. _windowed() takes all of that in
one shuffle by track; track_features() writes its rows once, with the fits but without the observations they were made
of, and every feature reads them. Window rows arise only where a feature needs them: objects that vanish. The number of
tracks is a running sum of those that come and go. All features of a window then meet in one aggregation, the
window's own frames among its rows. Frame sizes are a property of the video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.config import Motion
from curvetrail.functions.fits import closed_fits, fit_slope, fit_value, orthogonal_fit
from curvetrail.functions.geometry import area_ratio, box, box_at, box_iou, diagonal, edge_unstable, far_score, num, point_x, point_y, scale, top_mean
from curvetrail.operators.grid import FEW, cell_at, cells, overlapping_pairs
from curvetrail.plans.staging import staged

FEATURES = [
    "track_count", "speeds_mean", "pred_center_max_err", "pred_iou_max_err", "pred_center_sum_err", "pred_iou_sum_err",
    "speed_turn_rates_max", "speed_turn_rates_sum", "dir_turn_rates_max", "dir_turn_rates_sum", "turn_active_ratio",
    "collision_warning", "disappear_far_sum",
]


def _frame_size(rows: DataFrame, *more: Column) -> DataFrame:
    """frame_w and frame_h of each video, 640 x 480 where unknown; and more aggregates."""
    size = rows.groupBy("video_id").agg(F.max("frame_w").alias("fw"), F.max("frame_h").alias("fh"), *more)
    known = lambda c, usual: F.when(F.col(c) > 0, F.col(c)).otherwise(num(usual))
    return size.withColumns({"fw": known("fw", 640), "fh": known("fh", 480)})


def frame_facts(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Sampled frames with the last place and the frame size of their video, and whether all its frames hold few boxes."""
    last = F.max("idx").over(W.partitionBy("video_id"))
    held = tracks.groupBy("video_id", "frame_id").agg(F.count("*").alias("n"), F.max("frame_w").alias("frame_w"), F.max("frame_h").alias("frame_h"))
    size = _frame_size(held, (F.max("n") <= FEW).alias("few"))
    return frames.select("video_id", "frame_id", "idx", last.alias("last_idx")).join(size, "video_id", "left")


#: What _last_step() adds.
STEP = ["stable", "dt", "s0", "pair_scale", "a_w", "a_h", "b_w", "b_h", *[f"b_{c}" for c in ("px", "py", "x1", "y1", "x2", "y2")]]


def _last_step(t: DataFrame, cfg: Motion) -> DataFrame:
    """What the last two observations of seq, a and b, say without a fit: whether the step is stable, its time, the scale
    of b and of both, their sides, and b itself."""
    t = t.withColumns({"a": F.try_element_at("seq", F.lit(-2)), "b": F.try_element_at("seq", F.lit(-1))})
    fw, fh = F.col("fw"), F.col("fh")
    s0, s1 = scale(F.col("b.area")), scale(F.col("a.area"))
    pair_scale = F.greatest(num(1), (s0 + s1) * 0.5)
    step = F.hypot(F.col("b.px") - F.col("a.px"), F.col("b.py") - F.col("a.py"))
    stable = ~edge_unstable("a.", fw, fh, cfg.edge_ratio) & ~edge_unstable("b.", fw, fh, cfg.edge_ratio)
    stable = stable & (area_ratio(F.col("a.area"), F.col("b.area")) <= cfg.max_area_ratio) & (step / pair_scale <= cfg.max_step_ratio)
    dt = F.greatest(F.lit(1), F.col("b.frame_id") - F.col("a.frame_id")).cast("double")
    dims = lambda p: (F.col(f"{p}.x2") - F.col(f"{p}.x1"), F.col(f"{p}.y2") - F.col(f"{p}.y1"))
    sides = {f"{p}_{n}": c for p in "ab" for n, c in zip("wh", dims(p))}
    return t.withColumns({"stable": stable, "dt": dt, "s0": s0, "pair_scale": pair_scale, **sides, **{c: F.col(c.replace("_", ".")) for c in STEP[8:]}}).drop("a", "b")


def _windowed(tracks: DataFrame, facts: DataFrame, size: int, cfg: Motion) -> DataFrame:
    """Observations on sampled frames with what lies around them on their track, within the window that ends there:
    seq (its observations), n, disp_ratio and whether it is static; the places before and after; seen (the places in seq)
    where the track is not on the next frame; and what the last step says."""
    obs = F.struct("frame_id", "idx", "px", "py", "area", "x1", "y1", "x2", "y2")
    w = W.partitionBy("video_id", "track_id").orderBy("idx")
    back, ahead = w.rangeBetween(-(size - 1), 0), w.rangeBetween(0, size - 1)
    t = tracks.withColumns({"px": point_x(), "py": point_y(height=cfg.point_height)}).join(facts, ["video_id", "frame_id"])
    t = t.select(
        "video_id", "track_id", "cls_id", "frame_id", "idx", "last_idx", "fw", "fh", "few", "x1", "y1", "x2", "y2", "px", "py",
        F.collect_list(obs).over(back).alias("seq"), F.avg("area").over(back).alias("mean_area"), F.lag("idx").over(w).alias("prev_idx"), F.lead("idx").over(w).alias("next_idx"),
    ).withColumn("n", F.size("seq"))
    o = F.try_element_at("seq", F.lit(1))
    moved = F.hypot(F.col("px") - o["px"], F.col("py") - o["py"])
    t = t.withColumn("disp_ratio", moved / F.sqrt(F.greatest(num(1), F.col("mean_area"))))
    t = t.withColumn("still", (F.col("n") >= max(3, size)) & (F.col("disp_ratio") < cfg.static_ratio))
    t = t.withColumn("seen", F.when(F.col("next_idx").isNull() | (F.col("next_idx") > F.col("idx") + 1), F.col("seq.idx")))
    # the step comes before the last window function and the fits after it, so neither grows too large a method to be compiled
    return _last_step(t, cfg).withColumn("still_ends", F.collect_list(F.when(F.col("still") & (F.col("idx") >= size - 1), F.col("idx"))).over(ahead))


def _orthogonal(seq: Column, t0: Column, degree: Column) -> Column:
    """The fit of x and y over observations, for degrees beyond the closed forms; times from t0."""
    times = F.transform(seq, lambda o: (o["frame_id"] - t0).cast("double"))
    return orthogonal_fit(times, {"x": F.transform(seq, lambda o: o["px"]), "y": F.transform(seq, lambda o: o["py"])}, degree)


def _moving(size: int) -> Column:
    """Whether a track that is not static is on the last frame of a window and has been seen in it three times or more."""
    return (F.col("idx") >= size - 1) & (F.col("n") >= 3) & ~F.col("still")


def _with_motion(t: DataFrame, size: int, cfg: Motion) -> DataFrame:
    """Rows of _windowed(), their observations replaced by what they say of a moving track (undefined for others): fitted
    value and velocity, speed, whether the last step is stable, the predicted next box, and for tracks of full history
    the errors of the previous fit and the changes of speed and direction."""
    if cfg.fit_degree < 1:
        raise ValueError("a fit has a degree of 1 at least")
    hist = min(size, max(3, cfg.history)) if cfg.history is not None else size
    own = [c for c in t.columns if c not in ("seq", *STEP)]
    t = t.withColumn("seq", F.when(_moving(size), F.col("seq")))
    full = F.col("n") >= hist
    if cfg.fit_degree <= 2:
        t = t.withColumns({"fs": F.col("seq.frame_id"), "xs": F.col("seq.px"), "ys": F.col("seq.py")}).drop("seq")
        t = t.withColumn("fit", closed_fits(cfg.fit_degree, hist)("fs", "xs", "ys"))
        t = t.select(*[c for c in t.columns if c not in ("fs", "xs", "ys", "fit")], "fit.*")
        at = lambda p, c, d: F.col(f"{p}{c}0") + F.col(f"{p}v{c}") * F.col(d) + F.col(f"{p}q{c}") * F.col(d) * F.col(d)
    else:
        # the current fit takes the last `hist` observations, the one before it those without the current one
        now = F.slice("seq", F.greatest(F.lit(1), F.col("n") - hist + 1), hist)
        before = F.slice("seq", F.greatest(F.lit(1), F.col("n") - hist), F.least(F.col("n") - 1, F.lit(hist)))
        degree = lambda full: F.when(full, F.lit(cfg.fit_degree)).otherwise(F.lit(1))
        gaps = F.zip_with(F.slice(now, 2, hist), F.slice(now, 1, F.size(now) - 1), lambda z, y: z["frame_id"] - y["frame_id"])
        usual = F.greatest(F.lit(1), F.try_element_at(F.array_sort(gaps), F.floor(F.size(gaps) / 2).cast("int") + 1)).cast("double")
        t = t.withColumns({"fit": _orthogonal(now, F.try_element_at("seq", F.lit(-1))["frame_id"], degree(full)), "pfit": _orthogonal(before, F.try_element_at("seq", F.lit(-2))["frame_id"], degree(F.col("n") - 1 >= hist)), "next_dt": usual})
        t = t.withColumns({f"{p}{c}0": fit_value(F.col(f"{p}fit"), c, num(0)) for p in ("", "p") for c in "xy"} | {f"{p}v{c}": fit_slope(F.col(f"{p}fit"), c, num(0)) for p in ("", "p") for c in "xy"})
        at = lambda p, c, d: fit_value(F.col(f"{p}fit"), c, F.col(d))
    t = t.withColumns({"n1": F.hypot("pvx", "pvy"), "n2": F.hypot("vx", "vy")})
    t = t.withColumns({"ex": at("p", "x", "dt"), "ey": at("p", "y", "dt"), "r1": F.col("n1") * F.col("dt") / F.col("pair_scale"), "r2": F.col("n2") * F.col("dt") / F.col("pair_scale")})
    sides = ("x1", "y1", "x2", "y2")
    t = t.withColumns({f"p_{n}": c for n, c in zip(sides, box_at(F.col("ex"), F.col("ey"), F.col("a_w"), F.col("a_h"), cfg.point_height))})
    nb = box_at(at("", "x", "next_dt"), at("", "y", "next_dt"), F.col("b_w"), F.col("b_h"), cfg.point_height)
    change = F.abs(F.col("r1") - F.col("r2")) / F.greatest(num(cfg.min_turn_speed), (F.col("r1") + F.col("r2")) * 0.5)
    enough = F.least("n1", "n2") * F.col("dt") >= F.greatest(num(cfg.min_dir_px), F.col("pair_scale") * cfg.min_dir_ratio)
    turn = F.when(enough, F.abs(F.sin(F.atan2("vy", "vx") - F.atan2("pvy", "pvx")))).otherwise(num(0))
    t = t.withColumn("judged", full & F.col("stable"))
    judged = F.col("judged")
    t = t.withColumns({"speed_turn": F.when(judged, change), "dir_turn": F.when(judged, turn)})
    return t.select(
        *own, "x0", "y0", "vx", "vy", "stable", "judged",
        (F.col("n2") * F.col("dt") / F.col("s0") * cfg.speed_factor).alias("speed"),
        *[F.when(F.col("stable"), c).alias(f"next_{n}") for n, c in zip(sides, nb)],
        F.when(judged, F.hypot(F.col("b_px") - F.col("ex"), F.col("b_py") - F.col("ey")) / F.col("s0")).alias("center_err"),
        F.when(judged, num(1) - box_iou(box("p_"), box("b_"))).alias("iou_err"), "speed_turn", "dir_turn",
        ((F.col("speed_turn") > cfg.turn_limit) | (F.col("dir_turn") > cfg.turn_limit)).cast("double").alias("turned"),
    )


def _motion(t: DataFrame, size: int) -> DataFrame:
    """Of rows of _with_motion() those of moving tracks, with the window that ends there."""
    return t.where(_moving(size)).withColumn("window_id", F.col("idx") - (size - 1))


def last_frame_motion(tracks: DataFrame, frames: DataFrame, size: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """A row for each moving track on the last frame of a window."""
    t = _windowed(tracks, frame_facts(tracks, frames), size, cfg).where(_moving(size))
    return _motion(_with_motion(t, size, cfg), size).select("video_id", "window_id", "track_id", "fw", "fh", "few", "n", *MOTION)


def stable_pairs(tracks: DataFrame, cfg: Motion = Motion()) -> DataFrame:
    """Consecutive observations of a track and whether the step between them is stable."""
    w = W.partitionBy("video_id", "track_id").orderBy("frame_id")
    names = ["frame_id", "x1", "y1", "x2", "y2", "area", "px", "py"]
    t = tracks.join(_frame_size(tracks), "video_id").withColumns({"px": point_x(), "py": point_y(height=cfg.point_height)})
    t = t.withColumns({f"p_{c}": F.lag(c).over(w) for c in names}).where("p_frame_id is not null")
    ratio = area_ratio(F.col("p_area"), F.col("area"))
    step = F.hypot(F.col("px") - F.col("p_px"), F.col("py") - F.col("p_py")) / F.greatest(num(1), (scale(F.col("p_area")) + scale(F.col("area"))) * 0.5)
    ok = ~edge_unstable("p_", F.col("fw"), F.col("fh"), cfg.edge_ratio) & ~edge_unstable("", F.col("fw"), F.col("fh"), cfg.edge_ratio)
    ok = ok & (ratio <= cfg.max_area_ratio) & (step <= cfg.max_step_ratio)
    return t.select("video_id", "track_id", F.col("p_frame_id").alias("prev_frame"), "frame_id", ratio.alias("area_ratio"), step.alias("step_ratio"), ok.alias("stable"))


def static_tracks(tracks: DataFrame, frames: DataFrame, size: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """(video_id, window_id, track_id, disp_ratio) of tracks seen on every frame of a window that barely move."""
    t = _windowed(tracks, frame_facts(tracks, frames), size, cfg)
    return t.where(F.col("still") & (F.col("idx") >= size - 1)).select("video_id", (F.col("idx") - (size - 1)).alias("window_id"), "track_id", "disp_ratio")


#: What _with_motion() adds.
MOTION = [
    "x0", "y0", "vx", "vy", "stable", "judged", "speed", "next_x1", "next_y1", "next_x2", "next_y2", "center_err", "iou_err", "speed_turn",
    "dir_turn", "turned",
]
EVENT = ["video_id", "track_id", "idx"]


def _lost(t: DataFrame, size: int, cfg: Motion) -> DataFrame:
    """Observations after which a track is not on the next frame, with the first and last place of a window that could
    say so, and how far inside the frame they are. Rows of _windowed()."""
    t = t.where("seen is not null")
    far = far_score(F.col("px"), F.col("py"), F.col("fw"), F.col("fh"), cfg.far_from, cfg.far_to)
    t = t.withColumns({
        "first_end": F.greatest(F.col("idx") + 1, F.lit(size - 1).cast("long")), "last_end": F.least(F.col("idx") + (size - 1), F.col("last_idx")),
        "far": far,
    })
    keep = ["cls_id", "x1", "y1", "x2", "y2", "px", "py", "fw", "fh", "few", "next_idx", "first_end", "last_end", "seen", "far"]
    return t.where("first_end <= last_end").select(*EVENT, *keep)


def _gone(lost: DataFrame, size: int, cfg: Motion) -> DataFrame:
    """A row for each window (its last place is end) in which a lost track stays away long enough, after being seen
    often enough. Lookahead never leaves the window."""
    t = lost.withColumn("end", F.explode(F.sequence("first_end", "last_end")))
    away = F.col("next_idx").isNull() | (F.col("next_idx") > F.least(F.col("idx") + cfg.lookahead, F.col("end")))
    often = F.size(F.filter("seen", lambda i: i > F.col("end") - size)) >= cfg.min_seen
    return t.where(away & often).withColumn("window_id", F.col("end") - (size - 1))


def _with_rivals(lost: DataFrame, t: DataFrame, cfg: Motion) -> DataFrame:
    """lost with the observations of others of the class close by on the next frames: where, and the windows (by their
    last place) in which each is static. They meet by cells of a grid: a lost track looks as far as its box and the
    circle of near_ratio around its point reach, another is where its box is. One shuffle to meet them, one to bring
    them to the lost track's row."""
    ahead = F.explode(F.sequence(F.col("idx") + 1, F.least(F.col("idx") + cfg.lookahead, F.col("last_end"))))
    reach = diagonal(F.col("fw"), F.col("fh")) * cfg.near_ratio
    seen = {"r_x1": F.least(F.col("x1"), F.col("px") - reach), "r_y1": F.least(F.col("y1"), F.col("py") - reach), "r_x2": F.greatest(F.col("x2"), F.col("px") + reach), "r_y2": F.greatest(F.col("y2"), F.col("py") + reach)}
    frame = (F.col("fw"), F.col("fh"), F.col("few"))
    look = lost.select(*EVENT, "cls_id", "x1", "y1", "x2", "y2", "px", "py", *frame, ahead.alias("look")).withColumns(seen)
    look = look.withColumn("cell", F.explode(cells(*map(F.col, seen), *frame)))
    where = F.explode(cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), *frame)).alias("cell")
    others = t.select("video_id", "cls_id", F.col("idx").alias("look"), F.col("track_id").alias("o_track_id"), "still_ends", *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2", "px", "py")], where)
    met = look.join(others, ["video_id", "cls_id", "look", "cell"]).where("track_id <> o_track_id")
    met = met.where(F.col("cell") == cell_at(F.greatest("r_x1", "o_x1"), F.greatest("r_y1", "o_y1"), *frame))
    close = F.hypot(F.col("o_px") - F.col("px"), F.col("o_py") - F.col("py")) / diagonal(F.col("fw"), F.col("fh")) <= cfg.near_ratio
    near = met.where(close | (box_iou(box(""), box("o_")) >= cfg.near_iou)).select(*EVENT, F.struct("look", "still_ends").alias("rival"))
    rest = [c for c in lost.columns if c not in EVENT]
    both = lost.select(*EVENT, F.struct(*rest).alias("own")).unionByName(near, allowMissingColumns=True)
    return both.groupBy(*EVENT).agg(F.first("own", ignorenulls=True).alias("own"), F.collect_list("rival").alias("rivals")).select(*EVENT, "own.*", "rivals")


def _replaced(cfg: Motion) -> Column:
    """Whether a rival that is not static in the window shows up within it."""
    until = F.least(F.col("idx") + cfg.lookahead, F.col("end"))
    return F.exists("rivals", lambda r: (r["look"] <= until) & ~F.array_contains(r["still_ends"], F.col("end")))


def vanished(tracks: DataFrame, frames: DataFrame, size: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """Objects that are gone from the next frames of a window: video_id, window_id, track_id, idx, end, far."""
    gone = _gone(_lost(_windowed(tracks, frame_facts(tracks, frames), size, cfg), size, cfg), size, cfg)
    return gone.select("video_id", "window_id", "track_id", "idx", "end", "far")


def near_replacements(tracks: DataFrame, frames: DataFrame, size: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """Of vanished objects those for which another of the class appears close by on the next frames of the window."""
    t = staged(_windowed(tracks, frame_facts(tracks, frames), size, cfg).drop("seq", *STEP), "observations")
    gone = _gone(_with_rivals(_lost(t, size, cfg), t, cfg), size, cfg)
    return gone.where(_replaced(cfg)).select("video_id", "window_id", "track_id", "idx")


def _far(t: DataFrame, size: int, cfg: Motion) -> DataFrame:
    """Far scores of vanished objects without a replacement, a row each."""
    gone = _gone(_with_rivals(_lost(t, size, cfg).where("far > 0"), t, cfg), size, cfg)
    return gone.where(~_replaced(cfg)).select("video_id", "window_id", "far")


def disappear_far(tracks: DataFrame, frames: DataFrame, size: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """Top mean of far scores of vanished objects without a replacement, by window (windows without any are absent)."""
    t = staged(_windowed(tracks, frame_facts(tracks, frames), size, cfg).drop("seq", *STEP), "observations")
    return _far(t, size, cfg).groupBy("video_id", "window_id").agg(F.count("*").alias("n_far"), top_mean(F.collect_list("far"), cfg.top_k).alias("disappear_far_sum"))


def _overlaps(motion: DataFrame) -> DataFrame:
    """Overlapping pairs of boxes predicted within a window: video_id, window_id, a, b, iou."""
    boxes = motion.where("stable").select("video_id", "window_id", "track_id", *[F.col(f"next_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], *[c for c in ("fw", "fh", "few") if c in motion.columns])
    return overlapping_pairs(boxes, ["video_id", "window_id"], "track_id")


def collision_warning(motion: DataFrame) -> DataFrame:
    """Largest overlap of two predicted boxes of a window; 0 where there are two that do not overlap."""
    several = motion.where("stable").groupBy("video_id", "window_id").agg(F.count("*").alias("n")).where("n > 1")
    top = _overlaps(motion).groupBy("video_id", "window_id").agg(F.max("iou").alias("top"))
    return several.join(top, ["video_id", "window_id"], "left").select("video_id", "window_id", F.coalesce("top", num(0)).alias("collision_warning"))


def _counts(t: DataFrame, size: int) -> DataFrame:
    """Changes of the number of tracks from one window to the next: 1 at the first window of a stretch of windows that a
    track is in, -1 past the last. A stretch ends where the track pauses for a whole window."""
    apart = lambda a, b: a.isNull() | b.isNull() | (b - a > size)
    entry = lambda w, one: F.struct(w.alias("window_id"), F.lit(one).alias("change"))
    starts = F.when(apart(F.col("prev_idx"), F.col("idx")), entry(F.greatest(F.col("idx") - (size - 1), F.lit(0).cast("long")), 1))
    ends = F.when(apart(F.col("idx"), F.col("next_idx")), entry(F.least(F.col("idx"), F.col("last_idx") - (size - 1)) + 1, -1))
    return t.select("video_id", F.explode(F.array(starts, ends)).alias("e")).where("e is not null").select("video_id", "e.*")


def track_features(tracks: DataFrame, frames: DataFrame, size: int = 8, cfg: Motion = Motion()) -> DataFrame:
    """The thirteen motion features of every window; windows without objects have zeros."""
    facts = staged(frame_facts(tracks, frames), "frame-facts")
    t = _windowed(tracks, facts, size, cfg).drop("frame_id", "mean_area", "disp_ratio")
    t = staged(_with_motion(t, size, cfg).drop("x0", "y0", "vx", "vy", "judged"), "observations")
    motion = _motion(t, size)
    values = ["speed", "center_err", "iou_err", "speed_turn", "dir_turn", "turned"]
    ends = F.explode(F.array(
        F.struct(F.col("idx").alias("window_id"), F.col("frame_id").alias("start_frame"), F.lit(None).cast("long").alias("end_frame")),
        F.struct((F.col("idx") - (size - 1)).alias("window_id"), F.lit(None).cast("long").alias("start_frame"), F.col("frame_id").alias("end_frame")),
    ))
    rows = facts.select("video_id", ends.alias("e")).select("video_id", "e.*")
    still = t.where(F.col("still") & (F.col("idx") >= size - 1)).select("video_id", (F.col("idx") - (size - 1)).alias("window_id"), F.lit(1).alias("static"))
    for part in (_counts(t, size), still, motion.select("video_id", "window_id", *values), _overlaps(motion).select("video_id", "window_id", "iou"), _far(t, size, cfg)):
        rows = rows.unionByName(part, allowMissingColumns=True)
    top = lambda c: top_mean(F.collect_list(c), cfg.top_k)
    out = rows.groupBy("video_id", "window_id").agg(
        F.max("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("change").alias("change"), F.count("static").alias("static"),
        F.avg("speed").alias("speeds_mean"), F.max("center_err").alias("pred_center_max_err"), F.max("iou_err").alias("pred_iou_max_err"),
        top("center_err").alias("pred_center_sum_err"), top("iou_err").alias("pred_iou_sum_err"),
        F.max("speed_turn").alias("speed_turn_rates_max"), top("speed_turn").alias("speed_turn_rates_sum"),
        F.max("dir_turn").alias("dir_turn_rates_max"), top("dir_turn").alias("dir_turn_rates_sum"), F.avg("turned").alias("turn_active_ratio"),
        F.max("iou").alias("collision_warning"), top("far").alias("disappear_far_sum"),
    )
    so_far = W.partitionBy("video_id").orderBy("window_id").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("track_count", F.sum("change").over(so_far) - F.col("static")).where("start_frame is not null and end_frame is not null")
    return out.select("video_id", "window_id", "start_frame", "end_frame", *[F.coalesce(F.col(c).cast("double"), num(0)).alias(c) for c in FEATURES])

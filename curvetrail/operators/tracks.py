"""Per-track tables: parsing of detections, grouping, segments, and repair of broken identities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.config import Refinement
from curvetrail.functions.geometry import diagonal, foot_y, num, point_x, scale, upper_median
from curvetrail.operators.components import components
from curvetrail.plans.staging import staged


def parse_tracks(results: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """results: video_id, frame_id, frame_w, frame_h, boxes (nested; boxes without a track id are left out).
    names: cls_id, cls_name, a small dimension; an unknown class is named by its number."""
    flat = results.select("video_id", "frame_id", "frame_w", "frame_h", F.explode("boxes").alias("b")).where("b.track_id is not null")
    b = F.col("b")
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    out = flat.select(
        "video_id", "frame_id", b["track_id"].alias("track_id"), b["cls_id"].alias("cls_id"), b["score"].alias("score"),
        *[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
        (b["x1"] + w / 2).alias("cx"), (b["y1"] + h / 2).alias("cy"), w.alias("w"), h.alias("h"), (w * h).alias("area"), "frame_w", "frame_h",
    )
    if names is None:
        return out.withColumn("cls_name", F.col("cls_id").cast("string"))
    return out.join(names, "cls_id", "left").withColumn("cls_name", F.coalesce("cls_name", F.col("cls_id").cast("string")))


def detection_filter(tracks: DataFrame, min_score: float, classes: Iterable[int]) -> DataFrame:
    return tracks.where((F.col("score") >= min_score) & F.col("cls_id").isin(list(classes)))


def tracks_by_id(tracks: DataFrame) -> DataFrame:
    """One row a track with its observations in frame order."""
    obs = F.struct("frame_id", "cx", "cy", "area")
    return tracks.groupBy("video_id", "track_id").agg(F.array_sort(F.collect_list(obs)).alias("obs"))


def track_segments(tracks: DataFrame) -> DataFrame:
    """First and last observation of each track, and its class at the start."""
    end = F.struct("frame_id", "x1", "y1", "x2", "y2", "area", "frame_w", "frame_h")
    out = tracks.groupBy("video_id", "track_id").agg(
        F.min_by(F.struct("cls_id", end.alias("o")), "frame_id").alias("a"), F.max_by(end, "frame_id").alias("z"), F.count("*").alias("n_obs")
    )
    return out.select("video_id", "track_id", F.col("a.cls_id").alias("cls_id"), F.col("a.o.frame_id").alias("start_frame"), F.col("z.frame_id").alias("end_frame"), "n_obs", F.col("a.o").alias("start"), F.col("z").alias("end"))


def short_tracks(tracks: DataFrame, cfg: Refinement = Refinement()) -> DataFrame:
    """Facts of each track and whether it is a false one: short in count or span, and tiny by its upper median area.
    The frame's area takes 640 x 360 where the sizes are unknown."""
    known = (F.col("fw") > 1) & (F.col("fh") > 1)
    t = tracks.groupBy("video_id", "track_id").agg(
        F.count("*").alias("n_obs"), (F.max("frame_id") - F.min("frame_id") + 1).alias("span"),
        upper_median(F.collect_list("area")).alias("median_area"), F.max("frame_w").alias("fw"), F.max("frame_h").alias("fh"),
    )
    frame_area = F.when(known, F.col("fw") * F.col("fh")).otherwise(num(640 * 360))
    is_short = ~((F.col("n_obs") >= cfg.min_len) & (F.col("span") >= cfg.min_span))
    tiny = (F.col("median_area") < cfg.min_area) | (F.col("median_area") / frame_area < cfg.min_area_ratio)
    return t.select("video_id", "track_id", "n_obs", "span", "median_area", is_short.alias("is_short"), (is_short & tiny).alias("dropped"))


def tail_velocity(tracks: DataFrame, tail: int = 4) -> DataFrame:
    """Upper median step per frame over the last observations of each track, x and y apart."""
    w = W.partitionBy("video_id", "track_id").orderBy("frame_id")
    back = W.partitionBy("video_id", "track_id").orderBy(F.desc("frame_id"))
    t = tracks.select("video_id", "track_id", "frame_id", point_x().alias("px"), foot_y().alias("py"))
    dt = F.greatest(F.lit(1), F.col("frame_id") - F.lag("frame_id").over(w))
    t = t.withColumns({"vx": (F.col("px") - F.lag("px").over(w)) / dt, "vy": (F.col("py") - F.lag("py").over(w)) / dt, "r": F.row_number().over(back)})
    late = t.where(F.col("r") <= max(2, tail) - 1)
    med = lambda c: F.coalesce(upper_median(F.collect_list(c)), num(0))
    # a track seen once has no step: its list is empty
    return late.groupBy("video_id", "track_id").agg(
        F.when(F.count("vx") > 0, med("vx")).otherwise(num(0)).alias("vx"), F.when(F.count("vy") > 0, med("vy")).otherwise(num(0)).alias("vy")
    )


def _candidate_terms(cfg: Refinement) -> tuple[Column, Column]:
    """Whether a track may go on from another, and the score of that. Columns s_* and d_* of the two segments."""
    gap = F.col("d_start_frame") - F.col("s_end_frame")
    sa, da = F.col("s_end.area"), F.col("d_start.area")
    ratio = F.greatest(scale(sa) / scale(da), scale(da) / scale(sa))
    sx, sy = point_x("s_end."), foot_y("s_end.")
    dx, dy = point_x("d_start."), foot_y("d_start.")
    vx, vy = F.col("vx"), F.col("vy")
    sn, dn = F.hypot(vx, vy), F.hypot(dx - sx, dy - sy)
    cos = (vx * (dx - sx) + vy * (dy - sy)) / F.greatest(num(1e-6), sn * dn)
    implied = dn / F.greatest(num(1), gap.cast("double"))
    speed = F.greatest(implied / F.greatest(num(1e-6), sn), sn / F.greatest(num(1e-6), implied))
    moving = (sn > 1e-4) & (dn > 1e-4)
    fw = F.greatest(F.col("s_end.frame_w"), F.col("d_start.frame_w"), F.col("s_end.x2"), F.col("d_start.x2"), num(1))
    fh = F.greatest(F.col("s_end.frame_h"), F.col("d_start.frame_h"), F.col("s_end.y2"), F.col("d_start.y2"), num(1))
    score = F.hypot(sx + vx * gap - dx, sy + vy * gap - dy) / diagonal(fw, fh) + F.abs(F.log(ratio)) * 0.2
    allowed = (F.greatest(F.lit(0), gap - 1) * max(0.0, cfg.gap_relax) + 1.0) * cfg.max_dist
    ok = (ratio <= cfg.max_scale_ratio) & (~moving | ((cos >= max(-1.0, min(1.0, cfg.min_cos))) & (speed <= max(1.0, cfg.max_speed_ratio)))) & (score <= allowed)
    return ok, score


def _candidates(ends: DataFrame, cfg: Refinement) -> DataFrame:
    """Candidate pairs of tracks (video_id, track_id, cls_id, start_frame, end_frame, start, end, vx, vy).
    The range join is an equi join on bins of max_gap frames: a start meets ends of its own bin and the one before."""
    width = max(1, cfg.max_gap)
    src = ends.select(
        "video_id", "cls_id", F.col("track_id").alias("src"), F.col("end_frame").alias("s_end_frame"), F.col("end").alias("s_end"), "vx", "vy",
        F.floor(F.col("end_frame") / width).alias("bin"),
    )
    here = F.floor(F.col("start_frame") / width)
    dst = ends.select(
        "video_id", "cls_id", F.col("track_id").alias("dst"), F.col("start_frame").alias("d_start_frame"), F.col("start").alias("d_start"),
        F.explode(F.array(here, here - 1)).alias("bin"),
    )
    ok, score = _candidate_terms(cfg)
    gap = F.col("d_start_frame") - F.col("s_end_frame")
    met = src.join(dst, ["video_id", "cls_id", "bin"]).where((F.col("src") != F.col("dst")) & (gap >= 1) & (gap <= cfg.max_gap) & ok)
    return met.select("video_id", "src", "dst", gap.alias("gap"), score.alias("score"))


def stitch_candidates(tracks: DataFrame, cfg: Refinement = Refinement()) -> DataFrame:
    """Pairs (src, dst) of one class where dst starts 1 to max_gap frames after src ends and passes all tests."""
    return _candidates(track_segments(tracks).join(tail_velocity(tracks), ["video_id", "track_id"]), cfg)


def track_summary(tracks: DataFrame, cfg: Refinement = Refinement(), tail: int = 4) -> DataFrame:
    """All that the repair of ids asks of a track, from one shuffle: what track_segments, short_tracks and tail_velocity say
    of it. Medians are picked by place, so no list of a whole track is made."""
    track = W.partitionBy("video_id", "track_id")
    w = track.orderBy("frame_id")
    t = tracks.withColumns({"px": point_x(), "py": foot_y()})
    dt = F.greatest(F.lit(1), F.col("frame_id") - F.lag("frame_id").over(w))
    t = t.withColumns({
        "vx": (F.col("px") - F.lag("px").over(w)) / dt, "vy": (F.col("py") - F.lag("py").over(w)) / dt, "nth": F.row_number().over(w),
        "by_area": F.row_number().over(track.orderBy("area")), "n": F.count("*").over(track),
    })
    end = F.struct("frame_id", "x1", "y1", "x2", "y2", "area", "frame_w", "frame_h")
    late = F.col("n") - F.col("nth") < max(2, tail) - 1
    steps = lambda c: F.collect_list(F.when(late, F.col(c)))
    out = t.groupBy("video_id", "track_id").agg(
        F.min_by(F.struct("cls_id", end.alias("o")), "frame_id").alias("a"), F.max_by(end, "frame_id").alias("z"), F.count("*").alias("n_obs"),
        F.max(F.when(F.col("by_area") == F.floor(F.col("n") / 2) + 1, F.col("area"))).alias("median_area"),
        F.max("frame_w").alias("fw"), F.max("frame_h").alias("fh"), steps("vx").alias("vxs"), steps("vy").alias("vys"),
    )
    span = F.col("z.frame_id") - F.col("a.o.frame_id") + 1
    frame_area = F.when((F.col("fw") > 1) & (F.col("fh") > 1), F.col("fw") * F.col("fh")).otherwise(num(640 * 360))
    is_short = ~((F.col("n_obs") >= cfg.min_len) & (span >= cfg.min_span))
    tiny = (F.col("median_area") < cfg.min_area) | (F.col("median_area") / frame_area < cfg.min_area_ratio)
    usual = lambda c: F.when(F.size(c) > 0, upper_median(F.col(c))).otherwise(num(0))
    return out.select(
        "video_id", "track_id", F.col("a.cls_id").alias("cls_id"), F.col("a.o.frame_id").alias("start_frame"), F.col("z.frame_id").alias("end_frame"),
        F.col("a.o").alias("start"), F.col("z").alias("end"), "n_obs", "median_area", (is_short & tiny).alias("dropped"), usual("vxs").alias("vx"), usual("vys").alias("vy"),
    )


def _chained(rows: Iterable[tuple[int, int, float]]) -> Iterator[tuple[int, int]]:
    """(track, chain) of one component. rows: (dst, src or None, score) in order of start. Each track takes the free tail
    of best score among its candidates; of equal scores that of the chain that began first."""
    root: dict[int, int] = {}  # of each free tail
    began: dict[int, int] = {}  # the place of each chain's first track
    for dst, options in groupby(rows, key=lambda r: r[0]):
        best = min(((score, began[root[src]], src) for _, src, score in options if src in root), default=None)
        chain = root.pop(best[2]) if best else dst
        root[dst] = chain
        began.setdefault(dst, len(began))
        yield dst, chain


def _chain_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component and start, to the chain of each track: one component is held at a time."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    out: list[tuple[int, int, int]] = []
    kinds = [pa.int64()] * 3
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["video_id", "track_id", "new_id"])
    for (video, _), part in groupby(rows, key=lambda r: (r[0], r[1])):
        out += [(video, track, chain) for track, chain in _chained((dst, src, score) for _, _, _, dst, src, score in part)]
        if len(out) >= 10_000:
            yield make()
            out = []
    if out:
        yield make()


def chain_components(tracks: DataFrame, cfg: Refinement = Refinement()) -> DataFrame:
    """video_id, track_id, component: tracks that candidate pairs connect, named by their least track; a track that no
    candidate pair has is its own. Tails compete within a component only."""
    ends = staged(track_summary(tracks, cfg), "track-ends")
    parts = components(_candidates(ends.where("not dropped"), cfg), ["video_id"], "src", "dst").withColumnRenamed("node", "track_id")
    return ends.select("video_id", "track_id").join(parts, ["video_id", "track_id"], "left").withColumn("component", F.coalesce("component", "track_id"))


def refine_ids(tracks: DataFrame, cfg: Refinement = Refinement()) -> DataFrame:
    """video_id, track_id, new_id: the id each track goes on under, -1 for false tracks.
    Tracks become one summary each; the candidate pairs of a connected component are what meets in one task, so a camera
    that never pauses falls into as many parts as its tracks leave apart. Tracks without candidates keep their ids."""
    ends = staged(track_summary(tracks, cfg), "track-ends")
    pairs = staged(_candidates(ends.where("not dropped"), cfg), "candidates")
    parts = components(pairs, ["video_id"], "src", "dst").withColumnRenamed("node", "dst")
    begins = ends.select("video_id", F.col("track_id").alias("dst"), "start_frame")
    rows = parts.join(begins, ["video_id", "dst"]).join(pairs, ["video_id", "dst"], "left")
    rows = rows.repartition("video_id", "component").sortWithinPartitions("video_id", "component", "start_frame", "dst", "src")
    chained = rows.select("video_id", "component", "start_frame", "dst", "src", "score").mapInArrow(_chain_parts, "video_id long, track_id long, new_id long")
    known = ends.select("video_id", "track_id", "dropped").join(chained, ["video_id", "track_id"], "left")
    return known.select("video_id", "track_id", F.when(F.col("dropped"), F.lit(-1)).otherwise(F.coalesce("new_id", "track_id")).cast("long").alias("new_id"))


def apply_id_map(tracks: DataFrame, id_map: DataFrame) -> DataFrame:
    """Observations under their new ids; false tracks are gone."""
    new = tracks.join(id_map, ["video_id", "track_id"], "left").withColumn("new_id", F.coalesce("new_id", "track_id"))
    return new.where("new_id <> -1").withColumn("track_id", F.col("new_id")).drop("new_id")

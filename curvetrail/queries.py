"""Registered queries of the engine over the test tables; oracle.py has SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from curvetrail import fixtures as fx
from curvetrail.config import Chunks, Gate, Spans
from curvetrail.functions import geometry as g
from curvetrail.functions import parse, prompts, signals
from curvetrail.operators import calibrate, gate, grid, keyframes, metrics, motion, peaks, scene, spans, tables, tracks, windows
from curvetrail.plans import pipeline
from curvetrail.sources import sinks, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles to six places; the nudge keeps engines from rounding ties apart, and there is no negative zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + 1e-9, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = fx.tracks(spark, sf)
    return t, fx.frames(t)


def curve(spark: SparkSession, sf: str) -> DataFrame:
    t, f = base(spark, sf)
    return fx.scores(t, f)


def joined(c: Column) -> Column:
    """An array of numbers as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def spans_view(frames: DataFrame) -> DataFrame:
    """Spans of three to seven sampled frames, every eight frames."""
    s = frames.where((F.col("idx") % 8 == 0)).withColumn("k", F.col("idx") / 8)
    last = F.col("idx") + 3 + (F.col("video_id") + F.col("idx")) % 5
    s = s.select("video_id", F.col("frame_id").alias("start_frame"), last.alias("j"))
    end = frames.select("video_id", F.col("idx").alias("j"), F.col("frame_id").alias("end_frame"))
    return s.join(end, ["video_id", "j"]).drop("j")


def answers_view(spark: SparkSession, sf: str, spans: DataFrame) -> DataFrame:
    """Every answer belongs to a span of its own video, by its number; every fifth span gets none. Of a span's answers
    the first counts."""
    n = spans.groupBy("video_id").agg(F.count("*").alias("n"))
    r = fx.responses(spark, sf).join(n, "video_id").withColumn("slot", F.col("event_id") % F.col("n"))
    r = r.withColumn("span_no", F.col("slot") + 1 + F.floor(F.col("slot") / 4))
    return r.groupBy("video_id", "span_no").agg(F.min_by("raw", "event_id").alias("raw"))


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    s = curve(spark, sf)
    return spans.span_prior(spans.span_gaps(spans_view(s.select("video_id", "idx", "frame_id"))), s)


def fused(spark: SparkSession, sf: str) -> DataFrame:
    p = proposals(spark, sf)
    return spans.fuse_scores(p.join(answers_view(spark, sf, p), ["video_id", "span_no"], "left"))


def gate_features(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up window features with spikes, for the gate alone."""
    s = curve(spark, sf)
    cols = {}
    for i, (name, _) in enumerate(Gate().weights):
        noise = F.col("score") * ((F.col("idx") * 7 + i * 13 + F.col("video_id") * 5) % 11) / 10.0
        spike = F.when((F.col("idx") + F.col("video_id") * 3 + i * 7) % 41 == 0, g.num(2)).otherwise(g.num(0))
        cols[name] = noise + spike
    return s.select("video_id", F.col("idx").alias("window_id"), *[c.alias(n) for n, c in cols.items()])


def motion_rows(spark: SparkSession, sf: str) -> DataFrame:
    t, f = base(spark, sf)
    return motion.last_frame_motion(t, f)


# ---------------------------------------------------------------- sources and sinks


@query
def q_sample_frames(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.tracks(spark, sf).groupBy("video_id").agg(F.max("frame_id").alias("m"))
    raw = t.select("video_id", (F.col("video_id") % 3 * 5 + 25.0).alias("source_fps"), F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("frame_id"))
    return tidy(windows.sample_frames(raw, 12.0))


def results_view(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.tracks(spark, sf)
    b = F.struct(
        F.when(F.col("track_id") % 11 != 0, F.col("track_id")).alias("track_id"), F.col("cls_id"), F.least(g.num(1), F.col("value") / 200.0).alias("score"),
        "x1", "y1", "x2", "y2",
    )
    return t.groupBy("video_id", "frame_id").agg(F.max("frame_w").alias("frame_w"), F.max("frame_h").alias("frame_h"), F.collect_list(b).alias("boxes"))


@query
def q_parse_tracks(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([(0, "car"), (1, "person")], "cls_id long, cls_name string")
    return tidy(tracks.parse_tracks(results_view(spark, sf), names).select("video_id", "frame_id", "track_id", "cls_id", "cls_name", "score", "cx", "cy", "w", "h", "area"))


@query
def q_detection_filter(spark: SparkSession, sf: str) -> DataFrame:
    parsed = tracks.parse_tracks(results_view(spark, sf))
    return tidy(tracks.detection_filter(parsed, 0.2, (0, 1)).select("video_id", "frame_id", "track_id", "cls_id", "score"))


def manifest_view(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    k, kind = F.col("k").cast("string"), F.col("k") % 5
    line = (
        F.when(kind == 0, F.lit("  ")).when(kind == 1, F.concat(F.lit("# "), "c_name")).when(kind == 2, F.concat(F.lit(" clips/v"), k, F.lit("  30 1")))
        .when(kind == 3, F.concat(F.lit("clips/w"), k, F.lit(".mp4"))).otherwise(F.concat(F.lit("/abs/x"), k))
    )
    path = (
        F.when(kind == 2, F.concat(F.lit("/data/clips/v"), k, F.when(F.col("k") % 2 == 0, ".mov").otherwise("")))
        .when(kind == 3, F.concat(F.lit("/data/clips/w"), k, F.lit(".mp4"))).when(kind == 4, F.concat(F.lit("/abs/x"), k, F.lit(".webm")))
    )
    return c.select((F.col("k") + 1).alias("line_no"), line.alias("line")), c.where("k % 7 <> 0").select(path.alias("path")).where("path is not null")


@query
def q_manifest_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines, files = manifest_view(spark, sf)
    return tidy(text.manifest_items(lines, files, "/data"))


def gt_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.gt(fx.tracks(spark, sf))
    s = lambda c: F.col(c).cast("string")
    one = F.concat_ws(" ", F.concat(F.lit("v"), s("video_id")), s("total_frames"), s("e"), s("s"), F.lit("7 3"))
    two = F.concat(F.lit("path/v"), s("video_id"), F.lit(".mp4\t"), F.when(F.col("s") < 0, "[[-1,-1]]").otherwise(F.concat(s("e"), F.lit(" - "), s("s"), F.lit(",5-9"))))
    three = F.concat(F.lit('{"frame_dir": "d/v'), s("video_id"), F.lit('", "gt_intervals": [['), s("s"), F.lit(","), s("e"), F.lit('],[4]], "total_frames": '), s("total_frames"), F.lit("}"))
    kind = F.col("video_id") % 3
    return v.select((F.col("video_id") + 1).alias("line_no"), F.when(kind == 0, one).when(kind == 1, two).otherwise(three).alias("line"))


@query
def q_gt_parse(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(text.intervals_long(text.gt_manifest(gt_lines(spark, sf)), "frame_source", "total_frames"))


@query
def q_gt_lookup(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.gt(fx.tracks(spark, sf))
    line = F.concat_ws(" ", F.concat(F.lit("v"), F.col("video_id").cast("string")), F.col("total_frames").cast("string"), F.col("s").cast("string"), F.lit("x"), F.col("e").cast("string"), F.lit("4"))
    again = F.concat_ws(" ", F.concat(F.lit("v"), F.col("video_id").cast("string")), F.lit("1 2 3"))
    lines = v.select((F.col("video_id") * 2).alias("line_no"), line.alias("line")).unionAll(v.select((F.col("video_id") * 2 + 1).alias("line_no"), again.alias("line")))
    return tidy(text.intervals_long(text.gt_lookup(lines)))


@query
def q_labels_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k").cast("string")
    name = F.concat(F.lit("vid"), k)
    first = F.concat_ws(" ", name, F.lit("100 1 2"))
    last = F.when(F.col("k") % 4 == 0, F.concat_ws(" ", name, F.lit("90 x 2"))).when(F.col("k") % 4 == 1, F.concat_ws(" ", name, F.lit("90 5"))).when(F.col("k") % 4 == 2, F.concat_ws(" ", name, F.lit("80"))).otherwise(F.concat_ws(" ", name, F.lit("90 9 3 20"), (F.col("k") + 20).cast("string")))
    lines = s.select((F.col("k") * 2).alias("line_no"), first.alias("line")).unionAll(s.select((F.col("k") * 2 + 1).alias("line_no"), last.alias("line")))
    return text.label_lines(text.read_labels(lines))


@query
def q_sanitize_name(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", text.sanitize_name(F.concat(F.lit("__"), "p_name", F.lit(" @"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")))).alias("safe"))


def files_view(spark: SparkSession, sf: str) -> DataFrame:
    """Picture folders: numbered ones, and ones where some names have no number."""
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    folder = F.concat(F.lit("seq"), (F.col("k") % 10).cast("string"))
    name = F.when((F.col("k") % 10 >= 7) & (F.col("k") % 30 < 10), F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("_"), F.col("k").cast("string"), F.lit("b"))).otherwise(F.concat(F.lit("img_"), F.col("k").cast("string")))
    end = F.when(F.col("k") % 13 == 0, ".txt").when(F.col("k") % 2 == 0, ".JPG").otherwise(".png")
    return p.select(F.concat(folder, F.lit("/"), name, end).alias("path"))


@query
def q_list_pictures(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(text.list_pictures(files_view(spark, sf)))


@query
def q_listed_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Folders whose files a list names: every other file, with a comment and an empty line between."""
    named = files_view(spark, sf).where(F.length("path") % 2 == 0).select(F.col("path").alias("line"))
    notes = spark.createDataFrame([("# a note",), ("  ",), ("seq0/missing_1.png",)], "line string")
    files = files_view(spark, sf).select(F.concat(F.lit("root/"), "path").alias("path"))
    return tidy(text.listed_pictures(named.unionAll(notes), "root/", files))


@query
def q_path_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return tidy(files_view(spark, sf).select("path", text.digits_frame_id(p).alias("digits_id"), text.natural_key(p).alias("natural"), text.source_kind(p).alias("kind"), text.file_stem(p).alias("stem")))


@query
def q_resize_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 37 + 5).alias("w"), (F.col("p_partkey") % 53 * 21 + 7).alias("h"))
    w, h = g.resize_plan(F.col("w"), F.col("h"), 896)
    return tidy(p.select("p_partkey", "w", "h", w.alias("new_w"), h.alias("new_h")))


@query
def q_resume(spark: SparkSession, sf: str) -> DataFrame:
    items = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"))
    return text.resume(items, items.where("video_id % 3 = 0"), 25)


@query
def q_tracks_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON text and back."""
    t, f = base(spark, sf)
    from curvetrail.schema import TRACK_JSON

    nested = sinks.tracks_by_frame(t, f).select(F.to_json(F.struct("video_id", "frame_ids", "tracks_per_frame")).alias("j"))
    back = nested.select(F.from_json("j", TRACK_JSON).alias("r")).select("r.*")
    return tidy(sinks.flat_tracks(back))


@query
def q_tracks_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks nested by id, as JSON text and back."""
    nested = sinks.tracks_by_id(fx.tracks(spark, sf))
    back = nested.select(F.from_json(F.to_json(F.struct("video_id", "tracks")), nested.schema).alias("r")).select("r.*")
    flat = back.select("video_id", F.explode("tracks").alias("t")).select("video_id", "t.track_id", "t.cls_id", F.posexplode("t.seen").alias("pos", "o"))
    return tidy(flat.select("video_id", "track_id", "cls_id", "pos", "o.*"))


@query
def q_subscore_table(spark: SparkSession, sf: str) -> DataFrame:
    """The dense per-frame table that the CSV sink writes."""
    s = curve(spark, sf)
    w = gate_features(spark, sf).where("window_id >= 7").withColumn("window_id", F.col("window_id") - 7)
    return tidy(windows.dense_curve(s.select("video_id", "idx", "frame_id"), w.withColumnRenamed("turn_active_ratio", "score")))


# ---------------------------------------------------------------- geometry


@query
def q_track_point(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(fx.tracks(spark, sf).select("video_id", "frame_id", "track_id", g.point_x().alias("px"), g.point_y().alias("py"), g.foot_y().alias("foot_y"), g.scale(F.col("area")).alias("scale")))


def stepped(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("video_id", "track_id").orderBy("frame_id")
    names = ["x1", "y1", "x2", "y2", "area"]
    return fx.tracks(spark, sf).withColumns({f"p_{c}": F.lag(c).over(w) for c in names}).where("p_x1 is not null")


@query
def q_box_iou(spark: SparkSession, sf: str) -> DataFrame:
    s = stepped(spark, sf)
    return tidy(s.select("video_id", "frame_id", "track_id", g.box_iou(g.box("p_"), g.box()).alias("iou"), g.box_iou(g.box("p_"), g.box(), floor=True).alias("iou_floor"), g.area_ratio(F.col("p_area"), F.col("area")).alias("area_ratio")))


@query
def q_interval_iou(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.gt(fx.tracks(spark, sf)).where("e >= 0")
    s = spans_view(base(spark, sf)[1])
    j = s.join(v, "video_id")
    return tidy(j.select("video_id", "start_frame", "end_frame", g.interval_iou(F.col("s"), F.col("e"), F.col("start_frame"), F.col("end_frame")).alias("iou")))


@query
def q_edge_unstable(spark: SparkSession, sf: str) -> DataFrame:
    fw, fh = F.col("frame_w"), F.col("frame_h")
    t = fx.tracks(spark, sf).withColumns({"px": g.point_x(), "py": g.point_y()})
    return tidy(t.select("video_id", "frame_id", "track_id", g.edge_unstable("", fw, fh).alias("unstable"), g.edge_distance(F.col("px"), F.col("py"), fw, fh).alias("edge"), g.far_score(F.col("px"), F.col("py"), fw, fh).alias("far")))


@query
def q_stable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion.stable_pairs(fx.tracks(spark, sf)))


@query
def q_scalars(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.tracks(spark, sf)
    b = g.box_at(g.point_x(), g.point_y(), F.col("w"), F.col("h"))
    odd = F.when(F.col("frame_id") % 3 == 0, g.num(float("nan"))).when(F.col("frame_id") % 3 == 1, g.num(float("inf"))).otherwise(F.col("value") / 100.0)
    return tidy(t.select(
        "video_id", "frame_id", "track_id", g.sigmoid((F.col("value") - 60.0) / 7.0).alias("sigmoid"), g.clip01(F.col("value") / 90.0 - 0.2).alias("clip01"), g.finite(odd).alias("finite"),
        b[1].alias("top"), b[3].alias("bottom"), g.color_channel(F.col("track_id"), 37).alias("color"),
    ))


@query
def q_crop_box(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(keyframes.crop_boxes(fx.tracks(spark, sf), ["video_id", "track_id"]))


# ---------------------------------------------------------------- tracks


@query
def q_tracks_by_id(spark: SparkSession, sf: str) -> DataFrame:
    t = tracks.tracks_by_id(fx.tracks(spark, sf))
    return tidy(t.select("video_id", "track_id", F.size("obs").alias("n_obs"), joined(F.transform("obs", lambda o: o["frame_id"])).alias("frames")))


@query
def q_track_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = tracks.track_segments(fx.tracks(spark, sf))
    return tidy(s.select("video_id", "track_id", "cls_id", "start_frame", "end_frame", "n_obs", F.col("start.x1").alias("start_x1"), F.col("end.y2").alias("end_y2")))


@query
def q_short_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(tracks.short_tracks(fx.tracks(spark, sf)))


@query
def q_tail_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(tracks.tail_velocity(fx.tracks(spark, sf)))


@query
def q_stitch_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(tracks.stitch_candidates(fx.tracks(spark, sf)))


@query
def q_refine_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.refine_ids(fx.tracks(spark, sf))


@query
def q_box_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping boxes of a frame, met by cells of a grid."""
    t = fx.tracks(spark, sf).withColumnsRenamed({"frame_w": "fw", "frame_h": "fh"})
    return tidy(grid.overlapping_pairs(t, ["video_id", "frame_id"], "track_id"))


@query
def q_chain_components(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.chain_components(fx.tracks(spark, sf))


@query
def q_apply_id_map(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.tracks(spark, sf)
    ids = tracks.short_tracks(t).select("video_id", "track_id", F.when(F.col("dropped"), F.lit(-1)).when(F.col("track_id") % 4 == 1, F.col("track_id") - 1).otherwise(F.col("track_id")).alias("new_id"))
    out = tracks.apply_id_map(t, ids.where("track_id % 5 <> 0"))
    return tidy(out.select("video_id", "frame_id", "track_id", "cx"))


# ---------------------------------------------------------------- windows and motion


@query
def q_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    f = base(spark, sf)[1]
    one = windows.sliding_windows(f).withColumn("step", F.lit(1))
    return tidy(one.unionAll(windows.sliding_windows(f, 8, 3).withColumn("step", F.lit(3))))


@query
def q_static_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion.static_tracks(*base(spark, sf)))


@query
def q_disappeared(spark: SparkSession, sf: str) -> DataFrame:
    gone = motion.vanished(*base(spark, sf))
    return tidy(gone.select("video_id", "window_id", "track_id", "idx", "far"))


@query
def q_near_replacement(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion.near_replacements(*base(spark, sf)))


@query
def q_disappear_far(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion.disappear_far(*base(spark, sf)))


@query
def q_poly_fit(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion_rows(spark, sf).select("video_id", "window_id", "track_id", "n", "x0", "y0", "vx", "vy"))


@query
def q_pred_error(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion_rows(spark, sf).where("judged").select("video_id", "window_id", "track_id", "center_err", "iou_err"))


@query
def q_turn_rates(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion_rows(spark, sf).where("judged").select("video_id", "window_id", "track_id", "speed_turn", "dir_turn", "turned"))


@query
def q_speeds_mean(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion_rows(spark, sf).groupBy("video_id", "window_id").agg(F.avg("speed").alias("speeds_mean")))


@query
def q_collision_warning(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion.collision_warning(motion_rows(spark, sf)))


@query
def q_topk_mean(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.tracks(spark, sf).groupBy("video_id", "frame_id").agg(F.collect_list("value").alias("v"))
    return tidy(t.select("video_id", "frame_id", g.top_mean(F.col("v"), 3).alias("top3"), g.upper_median(F.col("v")).alias("upper")))


@query
def q_track_features(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(motion.track_features(*base(spark, sf)))


@query
def q_raw_trigger(spark: SparkSession, sf: str) -> DataFrame:
    f = gate_features(spark, sf)
    return tidy(f.select("video_id", "window_id", g.weighted_sum(dict(Gate().weights) | {"absent": 1.0, "collision_warning": 0.0}, f.columns).alias("raw_trigger")))


# ---------------------------------------------------------------- scene and embeddings


@query
def q_scene_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scene.scene_counts(*base(spark, sf)))


@query
def q_layout_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scene.layout_cells(*base(spark, sf)))


def embedding_errors(spark: SparkSession, sf: str) -> DataFrame:
    return scene.pair_errors(fx.table(spark, sf, "embeddings"), ["label"], "vec_id")


@query
def q_pair_errors(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(embedding_errors(spark, sf))


@query
def q_pair_signal(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "embeddings").select("label", "vec_id")
    return tidy(scene.pair_signal(e, embedding_errors(spark, sf), ["label"], order="vec_id"))


@query
def q_eventness(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "embeddings").select("label", "vec_id")
    return tidy(scene.eventness(scene.pair_signal(e, embedding_errors(spark, sf), ["label"], order="vec_id"), ["label"]))


@query
def q_layout_change(spark: SparkSession, sf: str) -> DataFrame:
    """Change of the layout between neighbouring frames, by the pair errors of dense layout vectors."""
    t, f = base(spark, sf)
    return tidy(scene.pair_errors(scene.layout_vectors(scene.layout_cells(t, f), f), ["video_id"], "idx"))


@query
def q_random_projection(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "embeddings").select("vec_id", signals.project(F.col("embedding").cast("array<double>"), signals.orthogonal_rows(64, 4)).alias("p"))
    return tidy(e.select("vec_id", *[F.col("p")[i].alias(f"p{i}") for i in range(4)]))


# ---------------------------------------------------------------- curves


def filtered(spark: SparkSession, sf: str, value: Callable[[Column, object], Column]) -> DataFrame:
    s = curve(spark, sf)
    return tidy(s.select("video_id", "idx", value(F.col("score"), signals.series("video_id")).alias("value")))


QUERIES["median_filter"] = partial(filtered, value=signals.median_filter)
QUERIES["smooth_edge"] = partial(filtered, value=signals.smooth_edge)
QUERIES["smooth_zero"] = partial(filtered, value=signals.smooth_zero)


@query
def q_savgol(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(signals.savgol(curve(spark, sf), "score", "value", ["video_id"]).select("video_id", "idx", "value"))


@query
def q_dense_curve(spark: SparkSession, sf: str) -> DataFrame:
    s = curve(spark, sf)
    w = s.where("idx >= 7").select("video_id", (F.col("idx") - 7).alias("window_id"), (F.col("score") * 2).alias("score"))
    return tidy(windows.dense_curve(s.select("video_id", "idx", "frame_id"), w))


@query
def q_robust_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(signals.robust_stats(curve(spark, sf), "score", ["video_id"]))


@query
def q_robust_unit(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(signals.robust_unit(curve(spark, sf), "score", "unit", ["video_id"]).select("video_id", "idx", "unit"))


@query
def q_video_topk(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(signals.top_share_mean(curve(spark, sf), "score", "topk", ["video_id"], 0.1))


# ---------------------------------------------------------------- gate


@query
def q_evidence_curves(spark: SparkSession, sf: str) -> DataFrame:
    e = gate.evidence_curves(gate.long_form(gate_features(spark, sf)))
    return tidy(e.select("video_id", "expert", "window_id", "z", "z_persist"))


def gate_salience(spark: SparkSession, sf: str) -> DataFrame:
    return gate.salience(gate.evidence_curves(gate.long_form(gate_features(spark, sf))))


@query
def q_expert_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(gate.expert_confidence(gate_salience(spark, sf)).select("video_id", "expert", "sparse", "confidence"))


@query
def q_gate_experts(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(gate.gate_experts(gate.expert_confidence(gate_salience(spark, sf))).select("video_id", "expert", "rank"))


@query
def q_gate_curves(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(gate.trigger_curve(gate_features(spark, sf)))


@query
def q_trigger_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks to the trigger of every window."""
    return tidy(gate.trigger_curve(motion.track_features(*base(spark, sf))).select("video_id", "window_id", "trigger", "active_experts"))


# ---------------------------------------------------------------- boundaries


@query
def q_boundary_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(peaks.boundary_thresholds(curve(spark, sf)))


@query
def q_local_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(peaks.local_peaks(curve(spark, sf)))


@query
def q_nms_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(peaks.nms_peaks(peaks.high_peaks(curve(spark, sf))))


@query
def q_peak_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = curve(spark, sf)
    return tidy(peaks.peak_spans(peaks.high_peaks(s), s.select("video_id", "idx", "frame_id")))


@query
def q_greedy_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = curve(spark, sf)
    return tidy(peaks.greedy_spans(peaks.peak_spans(peaks.nms_peaks(peaks.high_peaks(s)), s.select("video_id", "idx", "frame_id"))))


@query
def q_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(peaks.anchors(base(spark, sf)[1]))


@query
def q_boundary_spans(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(peaks.boundary_spans(curve(spark, sf)))


# ---------------------------------------------------------------- spans


@query
def q_span_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(spans.span_gaps(spans_view(base(spark, sf)[1])))


@query
def q_mask_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(spans.mask_intervals(curve(spark, sf), F.col("score") > 0.25, ["video_id"], gap=1, least=3))


@query
def q_span_prior(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(proposals(spark, sf))


@query
def q_fuse_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(fused(spark, sf).select("video_id", "span_no", "vlm_confidence", "vlm_score", "fused_score", "is_positive"))


MERGED = ["video_id", "merged_id", "start_frame", "end_frame", "peak_frame", "n_spans", "eventness_mean", "fused_score"]


@query
def q_merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = proposals(spark, sf)
    f = s.withColumns({"vlm_score": F.col("prior_score"), "vlm_confidence": g.num(0.5), "fused_score": F.col("prior_score"), "is_positive": F.col("prior_score") >= 0.3})
    near = spans.merge_spans(f, 10).withColumn("gap", F.lit(10))
    return tidy(near.unionByName(spans.merge_spans(f, 0).withColumn("gap", F.lit(0))).select("gap", *MERGED))


@query
def q_run_results(spark: SparkSession, sf: str) -> DataFrame:
    """The result row of each video, spans as text."""
    p = proposals(spark, sf)
    f = p.withColumns({"vlm_score": F.col("prior_score"), "vlm_confidence": g.num(0.5), "fused_score": F.col("prior_score"), "is_positive": F.col("prior_score") >= 0.3})
    out = sinks.run_results(base(spark, sf)[1], p, spans.merge_spans(f, 10))
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", *[x[k].cast("string") for k in ("start_frame", "end_frame", "peak_frame")])), ",").alias(c)
    return tidy(out.select("video_id", "num_sampled_frames", "num_windows", "num_pred_spans", "num_final_spans", named("pred_spans"), named("final_spans")))


@query
def q_refine_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = curve(spark, sf)
    v = spans_view(s.select("video_id", "idx", "frame_id"))
    return tidy(spans.refine_spans(v, s, answers_view(spark, sf, v), Spans(positive_from=0.3)).select(*MERGED))


@query
def q_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    k = keyframes.nearest_to_middle(proposals(spark, sf).select("video_id", "start_frame", "end_frame", "peak_frame"), base(spark, sf)[1])
    c = keyframes.span_keyframes(F.col("start_frame"), F.col("middle_frame"), F.col("peak_frame"), F.col("end_frame"))
    return tidy(k.select("video_id", "start_frame", joined(c).alias("frames")))


def keyed_spans(spark: SparkSession, sf: str) -> DataFrame:
    return keyframes.nearest_to_middle(proposals(spark, sf).select("video_id", "start_frame", "end_frame", "peak_frame"), base(spark, sf)[1])


@query
def q_keyframe_table(spark: SparkSession, sf: str) -> DataFrame:
    """Key frames by a table function that SQL calls for each span."""
    tables.register(spark)
    sql = "SELECT s.video_id, s.start_frame, k.pos, k.frame_id FROM {spans} s, LATERAL key_frames(s.start_frame, s.middle_frame, s.peak_frame, s.end_frame) k"
    return tidy(spark.sql(sql, spans=keyed_spans(spark, sf)))


@query
def q_keyframe_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Key frames of whole videos by a table function with partitions and an order; a frame counts for its first span."""
    tables.register(spark)
    spans_of = keyed_spans(spark, sf).select("video_id", "start_frame", "middle_frame", "peak_frame", "end_frame")
    sql = "SELECT * FROM numbered_key_frames(TABLE({spans}) PARTITION BY video_id ORDER BY (start_frame, end_frame))"
    return tidy(spark.sql(sql, spans=spans_of))


@query
def q_select_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    p = proposals(spark, sf)
    return tidy(p.select("video_id", "start_frame", joined(keyframes.select_keyframes(F.col("start_frame"), F.col("end_frame"), F.col("peak_frame"))).alias("frames")))


@query
def q_evidence_frames(spark: SparkSession, sf: str) -> DataFrame:
    t, f = base(spark, sf)
    return tidy(keyframes.evidence_frames(proposals(spark, sf).select("video_id", "start_frame", "end_frame", "peak_frame"), f, t))


@query
def q_event_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = proposals(spark, sf).withColumn("span_id", F.concat(F.lit("span."), F.col("span_no").cast("string")))
    return tidy(p.select("video_id", keyframes.event_summary().alias("s")).select("video_id", "s.*"))


@query
def q_prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    p = proposals(spark, sf)
    s = F.struct("start_frame", "end_frame", "peak_frame")
    return p.select("video_id", "span_no", prompts.span_prompt(s, "frames").alias("prompt"))


@query
def q_prompt_stages(spark: SparkSession, sf: str) -> DataFrame:
    s, note = F.struct("start_frame", "end_frame", "peak_frame"), F.concat(F.lit("note "), F.col("span_no").cast("string"))
    return proposals(spark, sf).select(
        "video_id", "span_no", prompts.span_stage1_prompt(s).alias("stage1"), prompts.span_stage2_prompt(note, s, "enhanced").alias("stage2"),
        F.lit(prompts.clip_stage1_prompt()).alias("clip1"), prompts.clip_stage2_prompt(note).alias("clip2"),
    )


@query
def q_uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 90 + 1).alias("n"))
    return tidy(c.select("k", "n", joined(spans.uniform_sample(F.col("n"), 4)).alias("four"), joined(spans.uniform_sample(F.col("n"), 7)).alias("seven")))


# ---------------------------------------------------------------- windows of chunks


SMALL = Chunks(window=20, stride=15, chunks=3)


def chunk_answers(spark: SparkSession, sf: str) -> DataFrame:
    c = spans.chunk_windows(base(spark, sf)[1], SMALL)
    return c.withColumn("score", ((F.col("video_id") * 7 + F.col("window_no") * 5 + F.col("chunk") * 3) % 11) / 10.0)


@query
def q_chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    f = base(spark, sf)[1]
    a = spans.chunk_windows(f, Chunks()).withColumn("size", F.lit(60))
    return tidy(a.unionAll(spans.chunk_windows(f, SMALL).withColumn("size", F.lit(20))))


@query
def q_chunk_projection(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(spans.chunk_projection(base(spark, sf)[1], chunk_answers(spark, sf)))


@query
def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(spans.coverage(base(spark, sf)[1], SMALL))


@query
def q_pred_intervals(spark: SparkSession, sf: str) -> DataFrame:
    f = base(spark, sf)[1]
    p = spans.chunk_projection(f, chunk_answers(spark, sf))
    s = p.withColumn("score", g.clip01(signals.smooth_zero(F.col("score"), signals.series("video_id"), 9)))
    found = spans.mask_intervals(s, F.col("score") > 0.5, ["video_id"], 3, 4)
    return tidy(spans.to_frames(found, f).select("video_id", "start_frame", "end_frame"))


# ---------------------------------------------------------------- evaluation


@query
def q_frame_labels(spark: SparkSession, sf: str) -> DataFrame:
    t, f = base(spark, sf)
    v = fx.gt(t)
    a = spans.frame_labels(f, v).withColumn("dropped", F.lit(True))
    return tidy(a.unionAll(spans.frame_labels(f, v, drop_negative=False).withColumn("dropped", F.lit(False))))


def ranking(spark: SparkSession, sf: str) -> DataFrame:
    return fx.binary(spark, sf).withColumn("part", F.col("ord") % 3)


QUERIES["roc_auc"] = lambda spark, sf: tidy(metrics.roc_auc(ranking(spark, sf), ["part"]))
QUERIES["avg_precision"] = lambda spark, sf: tidy(metrics.avg_precision(ranking(spark, sf), ["part"]))
QUERIES["eer"] = lambda spark, sf: tidy(metrics.eer(ranking(spark, sf), ["part"]))
QUERIES["accuracy_at"] = lambda spark, sf: tidy(metrics.accuracy_at(ranking(spark, sf), ["part"]))


@query
def q_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.roc_curve(ranking(spark, sf), ["part"])
    return tidy(c.withColumn("threshold", F.when(F.col("threshold") > 1e9, g.num(-1)).otherwise(F.col("threshold"))))


@query
def q_prf1(spark: SparkSession, sf: str) -> DataFrame:
    r = ranking(spark, sf).withColumn("hit", F.col("score") >= 0.3).groupBy("part", (F.col("ord") % 17).alias("sub")).agg(
        F.count_if(F.col("hit") & (F.col("y") == 1)).alias("tp"), F.count_if(F.col("hit") & (F.col("y") == 0)).alias("fp"), F.count_if(~F.col("hit") & (F.col("y") == 1)).alias("fn")
    )
    return tidy(r.select("*", *[c.alias(n) for n, c in metrics.prf1(F.col("tp"), F.col("fp"), F.col("fn")).items()]))


def labelled_spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t, f = base(spark, sf)
    return fx.gt(t).where("e >= 0"), spans_view(f)


QUERIES["gt_span_metrics"] = lambda spark, sf: tidy(metrics.gt_span_metrics(*labelled_spans(spark, sf)))
QUERIES["gt_overlap"] = lambda spark, sf: tidy(metrics.gt_overlap(*labelled_spans(spark, sf)))


@query
def q_eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    t, f = base(spark, sf)
    s = fx.scores(t, f).withColumn("score", F.round("score", 9))
    return tidy(pipeline.evaluate(s, spans.frame_labels(f, fx.gt(t)), threshold=0.3))


@query
def q_frame_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    t, f = base(spark, sf)
    n = f.groupBy("video_id").agg((F.max("frame_id") + 1).alias("actual"))
    d = fx.gt(t).select("video_id", (F.col("total_frames") + F.when(F.col("video_id") % 2 == 0, 1).otherwise(0)).alias("declared"))
    return tidy(d.join(n, "video_id").where("declared <> actual"))


@query
def q_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = curve(spark, sf)
    per = s.groupBy("video_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    return tidy(per.agg(F.count("*").alias("videos"), F.count_if(F.col("top") >= 0.5).alias("high"), F.avg("n").alias("mean_frames"), (F.count_if(F.col("n") >= 60) / F.count("*")).alias("long_share")))


# ---------------------------------------------------------------- answers


@query
def q_json_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.event_numbers(spark, sf)
    k = F.col("k").cast("string")
    raw = F.when(F.col("k") % 4 == 0, F.lit("no json")).when(F.col("k") % 4 == 1, F.concat(F.lit('x {"a": '), k, F.lit('} y'))).when(F.col("k") % 4 == 2, F.concat(F.lit("{broken "), k, F.lit("}"))).otherwise(F.concat(F.lit('pre\n{"a": {"b": '), k, F.lit("}}")))
    return e.select("event_id", parse.json_object(raw).alias("body"))


@query
def q_parse_span_score(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.event_numbers(spark, sf)
    k = F.col("k").cast("string")
    raw = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit('a {"anomaly_score": '), (F.col("k") / 80.0).cast("string"), F.lit(', "confidence": 0.5, "reason": "r'), k, F.lit('"}')))
        .when(F.col("k") % 5 == 1, F.concat(F.lit('{"score": "0.'), k, F.lit('"}'))).when(F.col("k") % 5 == 2, F.lit('{"overall_score": 0.75, "confidence": "high"}'))
        .when(F.col("k") % 5 == 3, F.lit("nothing")).otherwise(F.lit('{"anomaly_score": "bad", "confidence": -3}'))
    )
    return tidy(parse.with_answer(e.select("event_id", raw.alias("raw")), "raw", "span_score", "p").select("event_id", "p.*"))


@query
def q_parse_chunk_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.event_numbers(spark, sf)
    d = F.col("k") % 10
    raw = F.concat(
        F.lit('{"is_anomaly": '), F.when(F.col("k") % 2 == 0, "true").otherwise("false"), F.lit(', "overall_score": 0.'), d.cast("string"), F.lit(', "chunk_scores": [0.'), d.cast("string"),
        F.lit(', 2, "x"'), F.when(F.col("k") % 3 == 0, ", 0.25, 0.5").otherwise(""), F.lit('], "anomaly_type": "'), F.when(F.col("k") % 5 == 0, "normal").when(F.col("k") % 5 == 1, "odd").otherwise("abnormal_stop"),
        F.lit('", "abnormal_chunks": [3, "1", 9, 3, 2.0], "confidence": 1.5}'),
    )
    p = parse.with_answer(e.select("event_id", raw.alias("raw")), "raw", "chunk_scores", "p")
    return tidy(p.select("event_id", "p.is_anomaly", "p.overall_score", F.array_join(F.transform("p.chunk_scores", lambda x: F.round(x * 100, 0).cast("long").cast("string")), ",").alias("chunks"), "p.anomaly_type", joined(F.col("p.abnormal_chunks")).alias("abnormal"), "p.confidence"))


@query
def q_parse_clip_stage1(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.event_numbers(spark, sf)
    k = F.col("k").cast("string")
    raw = F.concat(F.lit('text {"scene_summary": "s'), k, F.lit('", "chunk_descriptions": ["a", "b'), k, F.lit('"], "likely_abnormal_chunks": ["2", 7, "x", 1], "noticeable_change": true, "risk_hint": "'), F.when(F.col("k") % 2 == 0, "clearly_risky").otherwise("none"), F.lit('"} end'))
    p = parse.with_answer(e.select("event_id", raw.alias("raw")), "raw", "clip_stage1", "p")
    return p.select("event_id", "p.scene_summary", F.array_join("p.chunk_descriptions", "|").alias("chunks"), joined(F.col("p.likely_abnormal_chunks")).alias("likely"), "p.noticeable_change", "p.risk_hint")


@query
def q_parse_span_stage1(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.event_numbers(spark, sf)
    k = F.col("k").cast("string")
    hint = F.when(F.col("k") % 2 == 0, "clearly_abnormal").otherwise("odd")
    full = F.concat(F.lit('{"scene_summary": "s'), k, F.lit('", "main_objects": ["car", "'), k, F.lit('"], "motion_summary": "fast", "anomaly_hint": "'), hint, F.lit('", "evidence_tags": ["near", ""]}'))
    raw = F.when(F.col("k") % 3 == 0, full).when(F.col("k") % 3 == 1, F.lit("{}")).otherwise(F.lit("none"))
    p = parse.with_answer(e.select("event_id", raw.alias("raw")), "raw", "span_stage1", "p")
    return p.select("event_id", "p.scene_summary", F.array_join("p.main_objects", "|").alias("objects"), "p.motion_summary", "p.anomaly_hint", F.array_join("p.evidence_tags", "|").alias("tags"))


@query
def q_parse_span_stage2(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.event_numbers(spark, sf)
    k = F.col("k").cast("string")
    raw = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"score": '), (F.col("k") / 50.0).cast("string"), F.lit(', "evidence_tags": ["a", "b"]}')))
        .when(F.col("k") % 3 == 1, F.concat(F.lit('ok {"anomaly_score": 0.25, "confidence": 7, "reason": "why '), k, F.lit('", "evidence_tags": "none"}'))).otherwise(F.lit("[]"))
    )
    p = parse.with_answer(e.select("event_id", raw.alias("raw")), "raw", "span_stage2", "p")
    return tidy(p.select("event_id", "p.anomaly_score", "p.confidence", "p.reason", F.array_join("p.evidence_tags", "|").alias("tags")))


# ---------------------------------------------------------------- calibration


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    t, f = base(spark, sf)
    return calibrate.calib_stats(t, f, fx.gt(t))


@query
def q_calib_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(calibration(spark, sf).groupBy("video_id", "stat").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")))


@query
def q_calib_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(calibrate.calib_percentiles(calibration(spark, sf)))


@query
def q_calib_recommend(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(calibrate.calib_recommend(calibration(spark, sf)))


# ---------------------------------------------------------------- whole analyses


@query
def q_analyze(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks to boundary spans of the gated curve."""
    t, f = base(spark, sf)
    return tidy(pipeline.analyze(t, f)["spans"])


@query
def q_window_baseline(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    from curvetrail.config import EngineConfig

    f = base(spark, sf)[1]
    c = chunk_answers(spark, sf).select("video_id", "window_no", "chunk", "score")
    cfg = replace(EngineConfig(), chunks=replace(SMALL, min_len=4, merge_gap=3))
    return tidy(pipeline.window_baseline(f, c, cfg)["intervals"].select("video_id", "start_frame", "end_frame"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed score curve to peak spans and anchors."""
    s = curve(spark, sf)
    smooth = s.withColumn("score", signals.smooth_edge(F.col("score"), signals.series("video_id")))
    return tidy(peaks.boundary_spans(smooth))

"""Micro cases with hand-worked results, edge cases, and plain-Python versions of the sequential operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvetrail import fixtures
from curvetrail.config import Boundary, Chunks, EngineConfig, Motion, Refinement, build, load_config
from curvetrail.functions import geometry as g
from curvetrail.functions import parse, signals
from curvetrail.operators import gate, keyframes, metrics, motion, peaks, spans, tracks, windows
from curvetrail.sources import sinks, text

COLS = "video_id long, idx long, frame_id long, score double"
TRACKS = "video_id long, frame_id long, track_id long, cls_id long, x1 double, y1 double, x2 double, y2 double, area double, frame_w double, frame_h double"


def curve(spark, values, video=1, step=2):
    return spark.createDataFrame([(video, i, i * step, float(v)) for i, v in enumerate(values)], COLS)


def value(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values()) or (0,)], list(cols) or ["zero"])
    return row.select(column.alias("v")).first()[0]


def values(df, name="value"):
    return [r[name] for r in df.orderBy("idx").collect()]


def tracked(spark, rows):
    """rows: video, frame, track, class, x1, y1, x2, y2."""
    return spark.createDataFrame([(*r, (r[6] - r[4]) * (r[7] - r[5]), 640.0, 480.0) for r in rows], TRACKS)


def test_config():
    cfg = load_config({"boundary": {"peak_gap": 9}, "gate": {"weights": [["a", 1.0]]}})
    assert cfg.boundary.peak_gap == 9 and cfg.boundary.merge_gap == 12 and cfg.gate.weights == (("a", 1.0),)
    two = build(EngineConfig, {"boundary": {"peak_gap": 9, "merge_gap": 5}, "motion": {"top_k": 1}}, {"boundary": {"peak_gap": 7}})
    assert (two.boundary.peak_gap, two.boundary.merge_gap, two.boundary.anchors, two.motion.top_k) == (7, 5, 4, 1)
    with pytest.raises(KeyError):
        load_config({"nothing": 1})
    assert Chunks().step == 45 and Chunks(max_stride_ratio=0.5).step == 30
    assert EngineConfig().to_dict()["sampling"]["window"] == 8


def test_stride(spark):
    rows = spark.createDataFrame([(f, s) for s in (25.0, 30.0, 5.0) for f in range(6)], "frame_id long, source_fps double")
    out = windows.sample_frames(rows, 12.0).groupBy("source_fps").agg(F.max("stride").alias("s")).collect()
    assert {r[0]: r[1] for r in out} == {25.0: 2, 30.0: 2, 5.0: 1}


def test_boxes(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert value(spark, g.box_iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / (175 + 1e-6))
    assert value(spark, g.interval_iou(F.lit(0), F.lit(9), F.lit(5), F.lit(14))) == pytest.approx(5 / 15)
    p = spark.createDataFrame([(0.0, 0.0, 10.0, 20.0)], "x1 double, y1 double, x2 double, y2 double")
    assert tuple(p.select(g.point_x(), g.point_y(), g.foot_y()).first()) == (5, 12, 20)
    assert value(spark, g.far_score(F.lit(84.0), F.lit(240.0), F.lit(640.0), F.lit(480.0))) == pytest.approx(0.5)
    assert value(spark, g.clip01(F.lit(None).cast("double"))) is None


def test_arrays(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    assert value(spark, g.upper_median(a(1, 2, 3, 4))) == 3
    assert [value(spark, g.top_mean(x, 3)) for x in (a(5, 1, 4, 3), a(2), a())] == [4, 2, 0]


def test_filters(spark):
    w = signals.series("video_id")
    get = lambda vals, f: values(curve(spark, vals).withColumn("value", f))
    s = F.col("score")
    assert get([0, 9, 0, 4, 4], signals.median_filter(s, w)) == [0, 0, 4, 4, 4]
    assert get([3, 0, 0, 6], signals.smooth_edge(s, w)) == [2, 1, 2, 4]
    assert get([3, 0, 0, 6], signals.smooth_zero(s, w, 3)) == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        signals.smooth_edge(s, w, 4)


def test_savgol(spark):
    assert signals.savgol_weights(11, 2)[5] == pytest.approx([x / 429 for x in (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)])
    for n in (2, 5, 12, 30):  # a quadratic within [0, 1] stays as it is, ends included
        vals = [0.3 + 0.02 * i - 0.0006 * i * i for i in range(n)]
        got = values(signals.savgol(curve(spark, vals), "score", "value", ["video_id"]))
        if n >= 5:
            assert got == pytest.approx(vals)
        else:
            assert len(got) == n


def test_dense_curve(spark):
    frames = spark.createDataFrame([(1, i, i) for i in range(5)] + [(2, i, i) for i in range(2)], "video_id long, idx long, frame_id long")
    w = spark.createDataFrame([(1, i, float(i + 1)) for i in range(3)], "video_id long, window_id long, score double")
    out = windows.dense_curve(frames, w, size=3)
    assert values(out.where("video_id = 1"), "score") == [1, 1, 1, 2, 3]
    assert values(out.where("video_id = 2"), "score") == [0, 0]
    with pytest.raises(ValueError):
        windows.dense_curve(frames, w, step=2)


def test_peaks(spark):
    assert [r.idx for r in peaks.local_peaks(curve(spark, [1, 1, 0, 2])).orderBy("idx").collect()] == [0, 1, 3]
    p = spark.createDataFrame([(1, 0, 10, 0.9), (1, 1, 14, 0.8), (1, 2, 15, 0.7)], COLS)
    assert sorted(r.frame_id for r in peaks.nms_peaks(p).collect()) == [10, 15]
    frames = curve(spark, [0.0] * 11)
    assert [r.idx for r in peaks.anchors(frames).orderBy("k").collect()] == [0, 3, 7, 10]
    row = peaks.frame_spans(frames).where("frame_id = 10").first()
    assert (row.start_frame, row.end_frame, row.start_idx, row.end_idx) == (6, 18, 3, 9)
    quiet = peaks.boundary_spans(curve(spark, [0.1] * 40)).collect()
    assert quiet and all(r.is_anchor for r in quiet)
    odd = curve(spark, [float("nan"), float("inf"), 0.5, 0.0])
    assert [r.idx for r in peaks.high_peaks(odd).collect()] == [2]
    with pytest.raises(Exception, match="ascend"):
        peaks.check_frames(spark.createDataFrame([(1, 0, 5, 0.1), (1, 1, 3, 0.1)], COLS)).collect()


def boundary_plain(vals, frames, cfg=Boundary()):
    n = len(vals)
    med = lambda x: (sorted(x)[(len(x) - 1) // 2] + sorted(x)[len(x) // 2]) / 2
    m = med(vals)
    high = m + cfg.high_z * max(1e-6, 1.4826 * med([abs(v - m) for v in vals]))
    reach = lambda i: (min(k for k in range(n) if frames[k] >= frames[i] - cfg.expand[0]), max(k for k in range(n) if frames[k] <= frames[i] + cfg.expand[1]))
    near = lambda a, b: frames[a[0]] <= frames[b[1]] + cfg.merge_gap and frames[b[0]] <= frames[a[1]] + cfg.merge_gap
    kept = []
    if max(vals) >= cfg.min_peak:
        top = [i for i in range(n) if (i == 0 or vals[i] >= vals[i - 1]) and (i == n - 1 or vals[i] >= vals[i + 1]) and vals[i] >= max(high, cfg.min_peak)]
        far = []
        for i in sorted(top, key=lambda i: (-vals[i], i)):
            if all(abs(frames[i] - frames[j]) > cfg.peak_gap for j in far):
                far.append(i)
        for i in far:
            if not any(near(reach(i), k) for k in kept):
                kept.append(reach(i))
    out = list(kept)
    spots = []
    for k in range(4):
        t = frames[0] + (frames[-1] - frames[0]) * k / 3
        i = min(range(n), key=lambda i: (abs(frames[i] - t), i))
        if reach(i) not in spots:
            spots.append(reach(i))
    for s in spots:
        if max(vals) < cfg.min_peak or not any(near(s, k) for k in out):
            out.append(s)
    return sorted(out)


def test_boundary_against_plain(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for v in range(12):
        n = rng.choice([1, 2, 5, 30, 60])
        vals = [round(rng.random() ** 3, 2) for _ in range(n)]
        frames = sorted(rng.sample(range(4 * n), n))
        rows += [(v, i, f, x) for i, (f, x) in enumerate(zip(frames, vals))]
        want[v] = boundary_plain(vals, frames)
    got = peaks.boundary_spans(spark.createDataFrame(rows, COLS)).collect()
    for v in want:
        assert sorted((r.start_idx, r.end_idx) for r in got if r.video_id == v) == want[v]


def test_islands(spark):
    rows = curve(spark, [1, 1, 0, 1, 1, 0, 0, 0, 1])
    out = spans.mask_intervals(rows, F.col("score") > 0.5, ["video_id"], gap=1, least=2).collect()
    assert [(r.s, r.e) for r in out] == [(0, 4)]


def observed(spark, *frames):
    """The curve of a video whose objects have these values on its frames, in this order of rows."""
    t = spark.createDataFrame([(1, 2 * i, float(v)) for i, f in enumerate(frames) for v in f], "video_id long, frame_id long, value double").coalesce(1)
    return fixtures.scores(t, fixtures.frames(t))


def test_equal_means_tie_in_any_order(spark):
    v = [64.86, 78.29, 10.2]
    assert v[0] + v[1] + v[2] < v[2] + v[1] + v[0]
    assert sorted(r.idx for r in peaks.local_peaks(observed(spark, v, v[::-1])).collect()) == [0, 1]
    odd = [r.score for r in observed(spark, [5.0, math.inf], [1e15, 2.0]).orderBy("idx").collect()]
    assert odd == [1.0, 1.0]


def test_mean_at_the_threshold_is_not_over_it(spark):
    v = [59.45, 68.89, 57.7, 13.96]
    assert (v[0] + v[1] + v[2] + v[3]) / 4 > 50 and math.isclose(sum(v), 200)
    assert spans.mask_intervals(observed(spark, v, v, v), F.col("score") > 0.25, ["video_id"], gap=1, least=3).count() == 0


def test_smoothed_stretches_of_the_same_values_tie(spark):
    got = values(curve(spark, [1, 0.17, 0.26, 1]).withColumn("value", signals.smooth_edge(F.col("score"), signals.series("video_id"))))
    assert (1 + 0.17) + 0.26 != (0.17 + 0.26) + 1 and got[1] == got[2]


SPANS = "video_id long, start_frame long, end_frame long, is_positive boolean, score double"


def merged_spans(spark, rows, gap):
    s = spans.span_gaps(spark.createDataFrame([(1, a, b, p, 0.5) for a, b, p in rows], SPANS))
    names = ["eventness_peak", "eventness_mean", "prior_score", "vlm_score", "vlm_confidence", "fused_score"]
    s = s.withColumns({c: F.col("score") for c in names}).withColumn("peak_frame", F.col("start_frame"))
    return sorted((r.start_frame, r.end_frame) for r in spans.merge_spans(s, gap).collect())


def test_merge(spark):
    assert merged_spans(spark, [(10, 20, True), (25, 30, True), (50, 60, False), (62, 70, True)], 10) == [(10, 30), (61, 70)]
    assert merged_spans(spark, [(0, 1, True), (100, 101, True)], 0) == [(0, 101)]
    assert merged_spans(spark, [(0, 1, False)], 10) == []


def test_prior_and_fusion(spark):
    s = spark.createDataFrame([(1, 0, 4)], "video_id long, start_frame long, end_frame long")
    p = spans.span_prior(spans.span_gaps(s), curve(spark, [0.2, 0.8, 0.5])).first()
    assert (p.eventness_peak, p.eventness_mean, p.prior_score, p.peak_idx) == (0.8, pytest.approx(0.5), pytest.approx(0.71), 1)
    with pytest.raises(Exception, match="sampled"):
        spans.span_prior(spans.span_gaps(s.withColumn("end_frame", F.lit(3).cast("long"))), curve(spark, [0.2, 0.8, 0.5])).collect()
    f = spark.createDataFrame([(0.4, '{"score": 0.9, "confidence": 0.5}'), (0.6, '{"score": 0, "confidence": 0.9}'), (0.7, '{"score": 0.1, "confidence": 0.2}'), (0.3, None)], "prior_score double, raw string")
    got = sorted((r.prior_score, round(r.fused_score, 6), round(r.vlm_score, 6)) for r in spans.fuse_scores(f).collect())
    assert got == [(0.3, 0.3, 0.3), (0.4, 0.65, 0.9), (0.6, 0.6, 0.0), (0.7, 0.7, 0.7)]


def test_keyframes(spark):
    c = keyframes.span_keyframes(F.lit(2), F.lit(6), F.lit(9), F.lit(10))
    assert value(spark, c) == [2, 6, 9, 10]
    assert value(spark, keyframes.select_keyframes(F.lit(5), F.lit(5), F.lit(5))) == [5]
    assert value(spark, keyframes.select_keyframes(F.lit(0), F.lit(30), F.lit(13))) == [0, 10, 13, 30]
    assert value(spark, spans.uniform_sample(F.lit(15), 4)) == [0, 5, 9, 14]
    assert value(spark, spans.uniform_sample(F.lit(1), 3)) == [0, 0, 0] and value(spark, spans.uniform_sample(F.lit(9), 1)) == [0]


def test_answers(spark):
    say = lambda raw: tuple(parse.with_answer(spark.createDataFrame([(raw,)], "raw string"), "raw", "span_score", "p").select("p.*").first())
    assert say('x {"anomaly_score": 1.7} y') == (1.0, 1.0, "")
    assert say("no json") == (0.0, 0.0, "") and say(None) == (0.0, 0.0, "") and say("{broken}") == (0.0, 0.0, "")
    raw = '{"is_anomaly": false, "overall_score": 0.9, "chunk_scores": [0.9, 0.8, 0.1, 0]}'
    p = parse.with_answer(spark.createDataFrame([(raw,)], "raw string"), "raw", "chunk_scores", "p").first().p
    assert p.overall_score == pytest.approx(0.1) and p.chunk_scores == pytest.approx([0.1, 0.2, 0.9, 1.0])
    q = parse.with_answer(spark.createDataFrame([('{"is_anomaly": "false"}',), ("{}",)], "raw string"), "raw", "clip_stage1", "p").collect()
    assert all(len(r.p.chunk_descriptions) == 4 for r in q)


def ranked(spark, ys, scores):
    return spark.createDataFrame([(1, i, y, float(s)) for i, (y, s) in enumerate(zip(ys, scores))], "k long, ord long, y long, score double")


def test_rankings(spark):
    r = ranked(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    assert metrics.roc_auc(r, ["k"]).first().auc == pytest.approx(0.75)
    assert metrics.avg_precision(r, ["k"]).first().ap == pytest.approx(0.833333, abs=1e-6)
    e = metrics.eer(r, ["k"]).first()
    assert (e.eer, e.edr, e.threshold_at_eer) == (0.5, 0.5, 0.8)
    assert metrics.roc_auc(ranked(spark, [0, 1], [0.5, 0.5]), ["k"]).first().auc == 0.0
    assert metrics.roc_auc(ranked(spark, [1, 0], [0.5, 0.5]), ["k"]).first().auc == 1.0
    assert metrics.roc_auc(ranked(spark, [1, 1], [0.5, 0.4]), ["k"]).first().auc is None
    p = metrics.prf1(F.lit(0), F.lit(0), F.lit(0))
    assert [value(spark, c) for c in p.values()] == [0, 0, 0]


def test_covers(spark):
    gt = spark.createDataFrame([(1, 10, 19)], "video_id long, s long, e long")
    sp = spark.createDataFrame([(1, 0, 12), (1, 15, 40)], "video_id long, start_frame long, end_frame long")
    m = metrics.gt_span_metrics(gt, sp).first()
    assert (m.mean_best_cover, m.mean_best_iou, m.hit_ratio, m.full80_ratio) == (0.5, pytest.approx(5 / 31), 1.0, 0.0)
    none = metrics.gt_span_metrics(gt, sp.where("false")).first()
    assert (none.hit_ratio, none.mean_best_iou) == (0.0, 0.0)
    f = spark.createDataFrame([(1, i, i) for i in range(5)], "video_id long, idx long, frame_id long")
    lab = lambda s, e, **k: [r.y for r in spans.frame_labels(f, spark.createDataFrame([(1, s, e)], "video_id long, s long, e long"), **k).orderBy("idx").collect()]
    assert lab(-1, -1) == [0] * 5 and lab(3, 9) == [0, 0, 0, 1, 1]


def test_static_and_fit(spark):
    rows = [(1, 2 * i, 7, 0, 300.0 + (2 * i) ** 2 / 4, 200.0, 340.0 + (2 * i) ** 2 / 4, 240.0) for i in range(8)]
    rows += [(1, 2 * i, 8, 1, 100.0, 100.0, 140.0, 140.0) for i in range(8)]
    t = tracked(spark, rows)
    f = spark.createDataFrame([(1, i, 2 * i) for i in range(8)], "video_id long, idx long, frame_id long")
    assert [r.track_id for r in motion.static_tracks(t, f).collect()] == [8]
    m = motion.last_frame_motion(t, f).collect()
    assert [r.track_id for r in m] == [7]
    assert m[0].x0 - 320 == pytest.approx(49) and m[0].vx == pytest.approx(7)
    assert (m[0].next_x1 + m[0].next_x2) / 2 - 320 == pytest.approx(64)
    feats = motion.track_features(t, f).first()
    assert feats.track_count == 1 and feats.collision_warning == 0
    few = f.where("idx < 5")
    assert motion.track_features(t, few).count() == 0


@pytest.mark.parametrize("degree", [1, 2, 3, 4, 6])
def test_fits_of_any_degree(spark, degree):
    """Orthogonal fits against the library's least squares, with times that repeat and fewer points than terms."""
    import numpy as np

    from curvetrail.functions.fits import fit_slope, fit_value, orthogonal_fit

    rng = random.Random(degree)
    rows = []
    for i in range(60):
        n = rng.randrange(1, 12)
        t = sorted(float(-rng.randrange(0, 40)) for _ in range(n)) if i % 2 else [float(-2 * k) for k in range(n)][::-1]
        rows.append((i, t, [rng.uniform(-50, 50) for _ in t]))
    df = spark.createDataFrame(rows, "i long, t array<double>, x array<double>")
    fit = F.col("fit")
    got = df.withColumn("fit", orthogonal_fit(F.col("t"), {"x": F.col("x")}, F.lit(degree))).select("i", fit_value(fit, "x", F.lit(0.0)).alias("v"), fit_slope(fit, "x", F.lit(0.0)).alias("s"), fit_value(fit, "x", F.lit(3.0)).alias("ahead"))
    for r in got.collect():
        _, t, x = rows[r.i]
        if len(set(t)) == 1:
            assert (r.v, r.s, r.ahead) == pytest.approx((np.mean(x), 0.0, np.mean(x)), abs=1e-9)
            continue
        p = np.polynomial.Polynomial.fit(t, x, min(degree, len(set(t)) - 1))
        assert (r.v, r.s, r.ahead) == pytest.approx((p(0), p.deriv()(0), p(3)), rel=1e-6, abs=1e-6)


def test_motion_with_cubic_fits(spark):
    """A cubic path is followed exactly: no error of prediction, and the velocity of its derivative."""
    x, y = lambda f: 20.0 + 3 * f + 0.05 * f * f - 0.001 * f**3, lambda f: 300.0 - 2 * f + 0.02 * f * f
    rows = [(1, 2 * i, 7, 0, x(2 * i) - 15, y(2 * i) - 15, x(2 * i) + 15, y(2 * i) + 15) for i in range(20)]
    f = spark.createDataFrame([(1, i, 2 * i) for i in range(20)], "video_id long, idx long, frame_id long")
    cfg = Motion(fit_degree=3, history=6)
    got = motion.last_frame_motion(tracked(spark, rows), f, 8, cfg).where("judged").collect()
    assert len(got) == 13
    for r in got:
        at = 2 * (r.window_id + 7)
        assert r.vx == pytest.approx(3 + 0.1 * at - 0.003 * at * at, abs=1e-6) and r.center_err == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        motion.last_frame_motion(tracked(spark, rows), f, 8, Motion(fit_degree=0))


def test_gate_without_signal(spark):
    f = spark.createDataFrame([(1, i, 0.5) for i in range(10)], "video_id long, window_id long, turn_active_ratio double")
    for r in gate.trigger_curve(f).collect():
        assert (r.trigger, r.null_weight, r.evidence, r.active_experts) == (0, 1, 0, 0)


def refine_plain(obs, cfg=Refinement()):
    by = {}
    for v, fr, t, c, x1, y1, x2, y2 in obs:
        by.setdefault(t, []).append((fr, c, x1, y1, x2, y2))
    by = {t: sorted(s) for t, s in by.items()}
    area = lambda o: (o[4] - o[2]) * (o[5] - o[3])
    point = lambda o: ((o[2] + o[4]) / 2, o[5])
    out = {}
    for t, s in by.items():
        m = sorted(map(area, s))[len(s) // 2]
        fine = len(s) >= cfg.min_len and s[-1][0] - s[0][0] + 1 >= cfg.min_span
        out[t] = t if fine or not (m < cfg.min_area or m / 307200 < cfg.min_area_ratio) else -1
    def speed(s):
        p = s[-4:]
        if len(p) < 2:
            return 0.0, 0.0
        d = [((point(b)[0] - point(a)[0]) / max(1, b[0] - a[0]), (point(b)[1] - point(a)[1]) / max(1, b[0] - a[0])) for a, b in zip(p, p[1:])]
        return sorted(x for x, _ in d)[len(d) // 2], sorted(y for _, y in d)[len(d) // 2]
    live = sorted((t for t in by if out[t] != -1), key=lambda t: (by[t][0][0], t))
    tails = {t: t for t in live}
    for d in live:
        best = None
        for root, s in tails.items():
            a, b = by[s][-1], by[d][0]
            gap = b[0] - a[0]
            if s == d or a[1] != b[1] or not 1 <= gap <= cfg.max_gap:
                continue
            ra, rb = math.sqrt(max(area(a), 1)), math.sqrt(max(area(b), 1))
            ratio = max(ra / rb, rb / ra)
            vx, vy = speed(by[s])
            dx, dy = point(b)[0] - point(a)[0], point(b)[1] - point(a)[1]
            sn, dn = math.hypot(vx, vy), math.hypot(dx, dy)
            if ratio > cfg.max_scale_ratio:
                continue
            if sn > 1e-4 and dn > 1e-4 and ((vx * dx + vy * dy) / max(1e-6, sn * dn) < cfg.min_cos or max(dn / gap / sn, sn / (dn / gap)) > cfg.max_speed_ratio):
                continue
            diag = max(1, math.hypot(max(640, a[4], b[4]), max(480, a[5], b[5])))
            score = math.hypot(point(a)[0] + vx * gap - point(b)[0], point(a)[1] + vy * gap - point(b)[1]) / diag + 0.2 * abs(math.log(ratio))
            if score <= cfg.max_dist * (1 + max(0, gap - 1) * cfg.gap_relax) and (best is None or score < best[0]):
                best = (score, root)
        if best:
            out[d] = best[1]
            tails[best[1]] = d
            del tails[d]
    return out


def test_refinement_against_plain(spark):
    rng = random.Random(11)
    rows = []
    for v in range(3):
        for lane in range(4):
            x, y, frame, size = rng.uniform(50, 400), rng.uniform(50, 300), 0, rng.choice([3, 30, 40])
            for piece in range(5):
                for _ in range(rng.choice([2, 4, 9])):
                    rows.append((v, frame, v * 1000 + lane * 10 + piece, lane % 2, x, y, x + size, y + size))
                    x, y, frame = x + rng.uniform(0, 3), y + rng.uniform(-1, 2), frame + 2
                frame += rng.choice([0, 2, 4, 8])
    got = {(r.video_id, r.track_id): r.new_id for r in tracks.refine_ids(tracked(spark, rows)).collect()}
    for v in range(3):
        want = refine_plain([r for r in rows if r[0] == v])
        assert {t: got[v, t] for t in want} == want
    assert any(new != old for (_, old), new in got.items())


def test_isolation(spark):
    """A video's spans do not change when others are added."""
    a = curve(spark, [0.1, 0.9, 0.2, 0.1, 0.8, 0.1] * 5, video=1)
    b = curve(spark, [0.3, 0.2, 0.7] * 9, video=2)
    alone = sorted(map(tuple, peaks.boundary_spans(a).collect()))
    both = sorted(map(tuple, peaks.boundary_spans(a.unionAll(b)).where("video_id = 1").collect()))
    assert alone == both


def test_manifests(spark, tmp_path):
    lines = ["# c", "", "clip_1 600 480 410", "01_X.mp4", "path/to/frames\t10-20,55-40", 'x/y\t[[10,20],[40,55]]', '{"video_id":"v9","frame_dir":"d/v9","gt_intervals":[[3,9]],"total_frames":20}', "vid_a 65 -1 -1"]
    p = tmp_path / "m.txt"
    p.write_text("\n".join(lines))
    df = text.read_lines(spark, str(p))
    got = {r.video_id: (r.total_frames, [(i.s, i.e) for i in r.intervals]) for r in text.gt_manifest(df).collect()}
    assert got == {"clip_1": (600, [(410, 480)]), "01_X": (0, []), "frames": (0, [(10, 20), (40, 55)]), "y": (0, [(10, 20), (40, 55)]), "v9": (20, [(3, 9)]), "vid_a": (65, [(-1, -1)])}
    bad = spark.createDataFrame([(1, "v 10 1 2 3")], "line_no long, line string")
    with pytest.raises(Exception, match="odd count"):
        text.gt_manifest(bad).collect()
    files = spark.createDataFrame([("/r/a.mov",), ("/r/b.mp4",)], "path string")
    items = text.manifest_items(spark.createDataFrame([(1, "a 1"), (2, "b.mp4"), (3, "c")], "line_no long, line string"), files, "/r")
    assert {r.line_no: (r.path, r.exists) for r in items.collect()} == {1: ("/r/a.mov", True), 2: ("/r/b.mp4", True), 3: ("/r/c", False)}
    with pytest.raises(Exception, match="no such source"):
        text.require_existing(items).collect()
    assert value(spark, text.sanitize_name(F.lit("__ä b__"))) == "b" and value(spark, text.sanitize_name(F.lit("##"))) == "video"


def test_long_lines_and_numbers(spark):
    line = "clip 9 " + " ".join(f"{i} {i + 1}" for i in range(6000))
    got = text.gt_lookup(spark.createDataFrame([(1, line)], "line_no long, line string")).first()
    assert [tuple(p) for p in got.intervals] == [(i, i + 1) for i in range(6000)]
    names = ["a7", "a" + "0" * 25 + "8", "a" + "9" * 20, "a1" + "0" * 20, "a1" + "0" * 19 + "1", "a2" + "0" * 20, "a1" + "0" * 21]
    rows = spark.createDataFrame([(n,) for n in names], "path string").withColumn("key", text.natural_key(F.col("path"))).collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.key)] == sorted(names, key=lambda n: int(n[1:]))
    assert len({r.key for r in rows}) == len(names)


def test_sinks(spark, tmp_path):
    t = tracked(spark, [(1, 0, 5, 0, 1.0, 2.0, 3.0, 4.0), (1, 4, 5, 0, 1.0, 2.0, 3.0, 4.0)])
    f = spark.createDataFrame([(1, i, 2 * i) for i in range(3)], "video_id long, idx long, frame_id long")
    sinks.write_tracks(t, f, str(tmp_path / "j"))
    assert sorted((r.frame_id, r.track_id) for r in sinks.read_tracks(spark, str(tmp_path / "j")).collect()) == [(0, 5), (4, 5)]
    text.write_labels(text.read_labels(spark.createDataFrame([(1, "v 9 3 1")], "line_no long, line string")), spark.createDataFrame([("v", 0)], "video_id string, ord long"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "v 9 1 3"
    sinks.write_curves(curve(spark, [0.1, 0.2]), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_streaming(spark, tmp_path):
    from curvetrail.streaming.online import event_counts, sliding_scores

    vals = [0.1 * i for i in range(12)]
    src = tmp_path / "in"
    for part, (a, b) in enumerate(((0, 5), (5, 12))):
        curve(spark, vals).where(f"idx >= {a} and idx < {b}").coalesce(1).write.parquet(str(src / f"p{part}"))
    stream = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = sliding_scores(stream).writeStream.format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.window_id, round(r.max_score, 6)) for r in spark.table("win").collect())
    assert got == [(i, round(0.1 * (i + 7), 6)) for i in range(5)]
    ev = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02"]), "event_type": ["a", "a"], "value": [1.0, 3.0]}))
    assert sorted((r.n, r.mean_value) for r in event_counts(ev).collect()) == [(2, 2.0), (2, 2.0)]


def random_tracks(rng, videos=2, n=30):
    rows = []
    for v in range(videos):
        for t in range(6):
            x, y = rng.uniform(40, 500), rng.uniform(40, 350)
            for f in range(rng.randrange(0, 8), n):
                if rng.random() < 0.85:
                    rows.append((v, 2 * f, t, t % 2, x + f * (t - 2), y + f, x + f * (t - 2) + 40, y + f + 30))
    return rows


def test_streamed_motion_equals_batch(spark, tmp_path):
    from curvetrail.streaming.online import OBJECTS, motion_stream

    t = tracked(spark, random_tracks(random.Random(4)))
    f = spark.createDataFrame([(v, i, 2 * i) for v in range(2) for i in range(30)], "video_id long, idx long, frame_id long")
    obj = F.struct("track_id", "cls_id", "x1", "y1", "x2", "y2", "area", "frame_w", "frame_h")
    per = t.groupBy("video_id", "frame_id").agg(F.collect_list(obj).alias("objects"))
    rows = f.join(per, ["video_id", "frame_id"], "left").select("video_id", "idx", "frame_id", F.timestamp_seconds(F.col("idx") + 1_700_000_000).alias("ts"), F.coalesce("objects", F.array().cast(OBJECTS)).alias("objects"))
    for part, (a, b) in enumerate(((0, 11), (11, 13), (13, 30))):
        rows.where(f"idx >= {a} and idx < {b}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = []
    q = motion_stream(stream, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"), availableNow=True)
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    key = lambda r: (r.video_id, r.window_id)
    want = sorted(motion.track_features(t, f).collect(), key=key)
    got = sorted(got, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want):
        assert [a[c] for c in motion.FEATURES] == pytest.approx([b[c] for c in motion.FEATURES], abs=1e-9)


def test_scorer_slot(spark):
    from curvetrail.operators.scorer import answers_of, with_answers

    asked = []

    def model(rows, budget):
        asked.append((len(rows), budget))
        if len(rows) > 2 or (rows[0]["n"] == 5 and budget > 50):
            raise RuntimeError("CUDA out of memory")
        return [f" answer {r['n']} " for r in rows]

    assert answers_of(model, [{"n": i} for i in range(7)], 100) == [f"answer {i}" for i in range(7)]
    assert (1, 50) in asked and max(n for n, _ in asked) == 7
    with pytest.raises(ValueError):
        answers_of(lambda rows, budget: int("x"), [{"n": 1}], 10)

    def load():
        return lambda rows, budget: [f'{{"anomaly_score": 0.{r["n"]}}}' for r in rows]

    df = spark.createDataFrame([(i, "x") for i in range(10)], "n long, other string").repartition(3)
    got = parse.with_answer(with_answers(df, load, ["n"], batch=2), "raw", "span_score", "p").select("n", "p.anomaly_score").collect()
    assert sorted((r.n, r.anomaly_score) for r in got) == [(i, i / 10) for i in range(10)]
    assert with_answers(df.where("false"), load, ["n"]).count() == 0


def test_plugged_in_feature(spark):
    from curvetrail.operators.plugins import FeatureSet
    from curvetrail.plans.pipeline import analyze

    extra = FeatureSet()

    @extra.register("many_objects", weight=2.0)
    def many_objects(tracks, frames, size):
        at = tracks.join(frames, ["video_id", "frame_id"]).groupBy("video_id", "idx").agg(F.count("*").alias("many_objects"))
        return at.where(f"idx >= {size - 1}").select("video_id", (F.col("idx") - (size - 1)).alias("window_id"), "many_objects")

    t = tracked(spark, random_tracks(random.Random(6), videos=1))
    f = spark.createDataFrame([(0, i, 2 * i) for i in range(30)], "video_id long, idx long, frame_id long")
    out = analyze(t, f, plugins=extra)
    assert "many_objects" in out["features"].columns and ("many_objects", 2.0) in extra.gate().weights
    assert out["features"].count() == 23 and out["curves"].count() == 23
    with pytest.raises(ValueError):
        extra.register("many_objects")(many_objects)


def test_running_sums_and_percentiles(spark):
    from curvetrail.operators.ranking import exact_percentiles, running_sums

    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([0.0, 0.0, rng.random()]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, ord long")
    got = {(r.k, r.ord): (r.upto, r.all_upto) for r in running_sums(df, ["k"], [F.desc("v"), F.col("ord")], {"upto": F.col("ord")}).collect()}
    for k in "ab":
        own, total = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 0
        for r in own:
            total += r[2]
            assert got[k, r[2]] == (total, sum(x[2] for x in own))
    p = {r.k: (r.n, r.p) for r in exact_percentiles(df, ["k"], "v", [0.0, 0.35, 0.9, 1.0]).collect()}
    for k in "ab":
        v = pd.Series([r[1] for r in rows if r[0] == k])
        assert p[k][0] == len(v) and p[k][1] == pytest.approx([v.quantile(q) for q in (0.0, 0.35, 0.9, 1.0)])


def test_chains_part_at_pauses(spark):
    """A video with long pauses is repaired part by part, with the same result."""
    rng = random.Random(3)
    rows = [(1, 400 * part + 2 * f, 10 * part + t, 0, 50.0 + t * 90 + f, 60.0, 90.0 + t * 90 + f, 100.0) for part in range(4) for t in range(3) for f in range(10) if rng.random() < 0.9]
    df = tracked(spark, rows)
    got = {r.track_id: r.new_id for r in tracks.refine_ids(df).collect()}
    for part in range(4):
        alone = tracked(spark, [r for r in rows if r[1] // 400 == part])
        assert {r.track_id: r.new_id for r in tracks.refine_ids(alone).collect()} == {t: n for t, n in got.items() if t // 10 == part}


def test_components(spark):
    """Random graphs and a long path, dealt over tasks so that several rounds are needed, against a plain union-find."""
    from curvetrail.operators.components import components

    rng = random.Random(4)
    edges = [(v, rng.randrange(120), rng.randrange(120)) for v in (1, 2) for _ in range(100)] + [(3, i, i + 1) for i in range(60)] + [(4, 5, 5)] * 2
    rng.shuffle(edges)
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for v, a, b in edges:
        a, b = root((v, a)), root((v, b))
        if a != b:
            up[max(a, b)] = min(a, b)
    want = {(v, x): root((v, x))[1] for v, a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "video_id long, a long, b long").repartition(7)
    got = components(df, ["video_id"]).collect()
    assert {(r.video_id, r.node): r.component for r in got} == want and len(got) == len(want)
    assert components(df.where("false"), ["video_id"]).count() == 0


def test_a_camera_without_pauses_falls_into_parts(spark):
    """Tracks that overlap all day long: the lanes and gaps leave them in many components, and the repair is that of the
    plain fold over the whole video."""
    rng = random.Random(6)
    rows = []
    for lane in range(5):
        frame, size = 0, rng.choice([25, 40])
        for piece in range(12):
            x, y = 60.0 + 100 * lane + rng.uniform(-3, 3), 100.0 + 8 * piece
            for _ in range(rng.choice([7, 9, 14])):
                rows.append((1, frame, lane * 100 + piece, lane % 2, x, y, x + size, y + size))
                x, y, frame = x + rng.uniform(0, 2), y + rng.uniform(0, 2), frame + 2
            frame += rng.choice([0, 2, 4])
    df = tracked(spark, rows)
    parts = {r.track_id: r.component for r in tracks.chain_components(df).collect()}
    got = {r.track_id: r.new_id for r in tracks.refine_ids(df).collect()}
    assert got == refine_plain(rows) and len(set(parts.values())) >= 5
    assert all(parts[t] == parts[n] for t, n in got.items() if n != -1) and len(set(got.values())) < len(got)


def test_box_grid(spark):
    """Boxes of all sizes, on and off the frame, against all pairs; boxes that are spread out meet few others."""
    from curvetrail.operators import grid

    rng = random.Random(8)
    rows = []
    for i in range(160):
        x, y, w, h = rng.uniform(-200, 900), rng.uniform(-200, 700), rng.choice([0.0, 5.0, 40.0, 900.0]), rng.choice([3.0, 40.0, 700.0])
        rows.append((i % 2, i, x, y, x + w, y + h, 640.0, 480.0))
    df = spark.createDataFrame(rows, "video_id long, k long, x1 double, y1 double, x2 double, y2 double, fw double, fh double")

    def overlap(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return w * h if w > 0 and h > 0 else 0

    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    want = {(a[0], a[1], b[1]): overlap(a, b) / (area(a) + area(b) - overlap(a, b)) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and overlap(a, b) > 0}
    got = grid.overlapping_pairs(df, ["video_id"], "k").collect()
    assert len(got) == len(want) and all(r.iou == pytest.approx(want[r.video_id, r.a, r.b], abs=1e-6) for r in got)
    apart = spark.range(400).selectExpr("0L AS v", "id AS k", "id % 20 * 32.0D AS x1", "floor(id / 20) * 24.0D AS y1", "640.0D AS fw", "480.0D AS fh").selectExpr("*", "x1 + 10 AS x2", "y1 + 10 AS y2")
    held = apart.select(F.explode(grid.cells(*map(F.col, ("x1", "y1", "x2", "y2", "fw", "fh")))).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert held <= 6 and grid.overlapping_pairs(apart, ["v"], "k").count() == 0


def test_percentiles_of_odd_values(spark, monkeypatch):
    """Values of all magnitudes, infinities and NaN, narrowed in several passes."""
    from curvetrail.operators import ranking

    rng = random.Random(5)
    rows = [("wide", rng.choice([1, -1]) * math.exp(rng.uniform(-600, 600))) for _ in range(900)] + [("same", 7.5)] * 300 + [("one", 1.0)]
    rows += [("odd", v) for v in (float("nan"), float("inf"), 1.0, 2.0, float("-inf"))] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    monkeypatch.setattr(ranking, "PICK_ROWS", 3)
    got = {r.k: (r.n, r.p) for r in ranking.exact_percentiles(df, ["k"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    wide = pd.Series([v for k, v in rows if k == "wide"])
    assert got["wide"][0] == 900 and got["wide"][1] == pytest.approx([wide.quantile(q, interpolation="linear") for q in (0.0, 0.25, 0.5, 1.0)], rel=1e-9)
    assert got["same"] == (300, [7.5] * 4) and got["one"] == (1, [1.0] * 4) and "none" not in got
    assert got["odd"][1][:3] == [float("-inf"), 1.0, 2.0] and math.isnan(got["odd"][1][3])


def test_write_result(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 0.5) for i in range(20)], "video_id long, score double")
    for kind in ("parquet", "json"):
        sinks.write_result(df, str(tmp_path / kind), kind)
        back = spark.read.format(kind).load(str(tmp_path / kind))
        assert sorted((r.video_id, r.score) for r in back.collect()) == [(i, i * 0.5) for i in range(20)] and "video_bucket" in back.columns


def test_empty_inputs(spark):
    none = curve(spark, [0.0]).where("false")
    assert peaks.boundary_spans(none).count() == 0
    t = tracked(spark, [(1, 0, 1, 0, 0.0, 0.0, 1.0, 1.0)])
    assert tracks.refine_ids(t.where("false")).count() == 0
    assert motion.track_features(t.where("false"), none.select("video_id", "idx", "frame_id")).count() == 0


def test_closed_fits_of_a_batch(spark):
    from curvetrail.functions.fits import closed_fits

    frames = [[0, 2, 6, 8, 10], [4, 4, 4], [0, 2, 4]]
    xs = [[1.0, 4.0, 2.0, 8.0, 5.0], [1.0, 2.0, 3.0], [1.0, None, 3.0]]
    rows = spark.createDataFrame([(i, f, x, [2.0 * t for t in f]) for i, (f, x) in enumerate(zip(frames, xs))], "i int, f array<long>, x array<double>, y array<double>").coalesce(1)
    whole, repeated, gap = (r.fit for r in rows.select("i", closed_fits(2, 4)("f", "x", "y").alias("fit")).orderBy("i").collect())
    for p, lo, hi in (("", 1, 5), ("p", 0, 4)):
        want = np.polyfit(np.array(frames[0][lo:hi]) - frames[0][hi - 1], xs[0][lo:hi], 2)
        assert np.allclose([whole[f"{p}qx"], whole[f"{p}vx"], whole[f"{p}x0"]], want)
    assert math.isclose(whole.vy, 2) and whole.next_dt == 2
    assert repeated.x0 is None and repeated.pvy is None and repeated.next_dt == 1
    assert gap.x0 is None and gap.px0 is None and math.isclose(gap.y0, 8) and gap.qy == 0


def test_a_track_that_stays_on_one_frame_has_no_fit(spark):
    t = spark.createDataFrame([(1, 14, 5, 0, 10.0, 10.0 + i, 50.0, 60.0) for i in range(3)], "video_id long, frame_id long, track_id long, cls_id long, x1 double, y1 double, x2 double, y2 double")
    t = t.selectExpr("*", "40d * 50d AS area", "640d AS frame_w", "480d AS frame_h")
    f = spark.range(8).selectExpr("1L AS video_id", "id AS idx", "id * 2 AS frame_id")
    assert {r.x0 for r in motion.last_frame_motion(t, f).collect()} == {None}
    assert motion.track_features(t, f).first().speeds_mean == 0


def test_features_where_frames_hold_few_boxes(spark, monkeypatch):
    """A frame of few boxes is one cell, a crowded one a grid, with the same features; tracks pause within and beyond a
    window, and each window counts those it sees. What is written once holds no lists of whole observations."""
    from curvetrail.operators import grid

    rnd, rows, seen = random.Random(3), [], {}
    for k in range(24):
        x, y, at = rnd.uniform(0, 600), rnd.uniform(0, 440), rnd.randrange(6)
        while at < 60:
            seen.setdefault(k, []).append(at)
            px, py = x + at * (k % 5 - 2) * 1.5 + rnd.uniform(0, 3), y + at * (k % 3 - 1) + rnd.uniform(0, 3)
            rows.append((1, at * 2, k, k % 2, px, py, px + 45, py + 40))
            at += rnd.choice([1] * 12 + [2, 7, 8, 9, 10, 15])
    t = tracked(spark, rows)
    f = spark.range(60).selectExpr("1L AS video_id", "id AS idx", "id * 2 AS frame_id")
    written, usual = {}, motion.staged
    monkeypatch.setattr(motion, "staged", lambda df, name: written.setdefault(name, usual(df, name)))
    few = {r.window_id: r for r in motion.track_features(t, f).collect()}
    assert written["frame-facts"].where("few").count() == 60 and "seq" not in written["observations"].columns
    boxes = written["observations"].selectExpr("x1", "y1", "x2", "y2", "fw", "fh", "few")
    assert boxes.select(F.explode(grid.cells(*map(F.col, boxes.columns)))).count() == len(rows) < boxes.select(F.explode(grid.cells(*map(F.col, boxes.columns[:6])))).count()
    monkeypatch.setattr(motion, "staged", usual)
    monkeypatch.setattr(motion, "FEW", 1)
    assert few == {r.window_id: r for r in motion.track_features(t, f).collect()}
    still = {}
    for r in motion.static_tracks(t, f).collect():
        still[r.window_id] = still.get(r.window_id, 0) + 1
    assert len(few) == 53
    for w, r in few.items():
        assert r.track_count == sum(any(w <= i < w + 8 for i in places) for places in seen.values()) - still.get(w, 0)
    assert max(r.collision_warning for r in few.values()) > 0 and max(r.disappear_far_sum for r in few.values()) > 0

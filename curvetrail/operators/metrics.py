"""Ranking and interval measures.

Rankings follow a given order among equal scores (column ord). Cumulative counts go by ranges of the ranking (see
ranking.py), so neither a key as large as the table nor a score that most rows share is ranked in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.functions.geometry import interval_iou, num
from curvetrail.operators.ranking import running_sums

#: Frames of a bin of the overlap join.
BIN = 512


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), num(0))


def prf1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(p * r * 2, p + r)}


def _classes() -> dict[str, Column]:
    return {"tp": (F.col("y") == 1).cast("long"), "fp": (F.col("y") == 0).cast("long")}


def ranked_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the positives (tp) and negatives (fp) down to it, highest score first and equal ones by ord, and
    those of all its key (pos, neg)."""
    c = running_sums(rows, keys, [F.desc("score"), F.col("ord")], _classes())
    return c.select(*keys, "ord", "score", "y", "tp", "fp", F.col("all_tp").alias("pos"), F.col("all_fp").alias("neg"))


def by_threshold(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of ranked counts what holds at each distinct score: all rows with it are in."""
    return counts.groupBy(*keys, "score").agg(*[F.max(c).alias(c) for c in ("tp", "fp", "pos", "neg")])


def threshold_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives from the highest score down, at each distinct score; equal scores are counted first."""
    per = rows.groupBy(*keys, "score").agg(*[F.sum(e).alias(f"own_{n}") for n, e in _classes().items()])
    c = running_sums(per, keys, [F.desc("score")], {"tp": F.col("own_tp"), "fp": F.col("own_fp")})
    return c.select(*keys, "score", "tp", "fp", F.col("all_tp").alias("pos"), F.col("all_fp").alias("neg"))


def auc_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    area = F.sum(F.when(F.col("y") == 0, F.col("tp").cast("double")).otherwise(num(0)))
    a = counts.groupBy(*keys).agg(area.alias("a"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return a.select(*keys, F.try_divide(F.col("a"), (F.col("pos") * F.col("neg")).cast("double")).alias("auc"))


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area by trapezoids from row to row: each negative adds the share of positives before it. Null for one class."""
    return auc_of(ranked_counts(rows, keys), keys)


def precision_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    s = F.sum(F.when(F.col("y") == 1, F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).otherwise(num(0)))
    a = counts.groupBy(*keys).agg(s.alias("s"), F.max("pos").alias("pos"))
    return a.select(*keys, F.try_divide(F.col("s"), F.col("pos").cast("double")).alias("ap"))


def avg_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean precision at the positives; null without any."""
    return precision_of(ranked_counts(rows, keys), keys)


def curve_of(thresholds: DataFrame, keys: list[str]) -> DataFrame:
    t = thresholds.where("pos > 0 and neg > 0")
    body = t.select(*keys, (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"), F.col("score").alias("threshold"))
    head = t.select(*keys).distinct().select(*keys, num(0).alias("fpr"), num(0).alias("tpr"), num(float("inf")).alias("threshold"))
    return body.unionAll(head)


def roc_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """fpr, tpr, threshold at each distinct score, with a head at plus infinity; nothing for one class."""
    return curve_of(threshold_counts(rows, keys), keys)


def eer_of(curve: DataFrame, keys: list[str]) -> DataFrame:
    fnr = num(1) - F.col("tpr")
    best = F.min_by(F.struct("fpr", "tpr", "threshold"), F.struct(F.abs(F.col("fpr") - fnr), -F.col("threshold")))
    b = curve.groupBy(*keys).agg(best.alias("b"))
    return b.select(*keys, ((F.col("b.fpr") + num(1) - F.col("b.tpr")) / 2.0).alias("eer"), F.col("b.tpr").alias("edr"), F.col("b.threshold").alias("threshold_at_eer"))


def eer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Where false alarms and misses are nearest (the highest threshold of equals): their mean, tpr, threshold."""
    return eer_of(roc_curve(rows, keys), keys)


def accuracy_at(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    hit = ((F.col("score") >= threshold).cast("long") == F.col("y")).cast("double")
    return rows.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def best_covers(gt: DataFrame, spans: DataFrame) -> DataFrame:
    """For each labelled interval the span that covers most of it, of equal cover that of best overlap, then the
    first; cover 0 and no span where none meets it. gt: video_id, s, e; spans: video_id, start_frame, end_frame."""
    g = gt.select("video_id", "s", "e").distinct()
    # an equi join on bins of frames; a pair counts in the bin where its overlap begins
    bins = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(z) / BIN)))
    on = spans.select("video_id", "start_frame", "end_frame").where("start_frame <= end_frame").withColumn("bin", bins("start_frame", "end_frame"))
    met = g.where("s <= e").withColumn("bin", bins("s", "e")).join(on, ["video_id", "bin"]).where("start_frame <= e and end_frame >= s")
    met = met.where(F.col("bin") == F.floor(F.greatest("s", "start_frame") / BIN)).drop("bin")
    inter = F.least("e", "end_frame") - F.greatest("s", "start_frame") + 1
    cover = inter / F.greatest(F.lit(1), F.col("e") - F.col("s") + 1)
    iou = interval_iou(F.col("s"), F.col("e"), F.col("start_frame"), F.col("end_frame"))
    m = met.withColumns({"cover": cover, "iou": iou})
    rank = F.struct(F.round("cover", 6), F.round("iou", 9), -F.col("start_frame"), -F.col("end_frame"))
    best = m.groupBy("video_id", "s", "e").agg(F.max_by(F.struct("cover", "iou", "start_frame", "end_frame"), rank).alias("b"), F.max("iou").alias("best_any_iou"))
    out = g.join(best, ["video_id", "s", "e"], "left")
    zero = lambda c: F.coalesce(F.col(c), num(0))
    return out.select("video_id", "s", "e", zero("b.cover").alias("best_cover"), zero("b.iou").alias("best_iou"), F.col("b.start_frame").alias("best_start"), F.col("b.end_frame").alias("best_end"), zero("best_any_iou").alias("best_any_iou"))


def gt_span_metrics(gt: DataFrame, spans: DataFrame) -> DataFrame:
    """By video: intervals, share hit, share covered to 80 %, mean best cover and overlap."""
    b = best_covers(gt, spans)
    return b.groupBy("video_id").agg(
        F.count("*").alias("num_gt_intervals"), F.avg((F.col("best_cover") > 0).cast("double")).alias("hit_ratio"),
        F.avg((F.col("best_cover") >= 0.8).cast("double")).alias("full80_ratio"), F.avg("best_cover").alias("mean_best_cover"), F.avg("best_iou").alias("mean_best_iou"),
    )


def gt_overlap(gt: DataFrame, spans: DataFrame) -> DataFrame:
    """By labelled interval: best overlap with any span, and whether there is one."""
    b = best_covers(gt, spans)
    return b.select("video_id", "s", "e", F.col("best_any_iou").alias("best_iou"), (F.col("best_any_iou") > 0).alias("covered"))

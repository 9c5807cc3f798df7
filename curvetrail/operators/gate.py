"""From window features to one trigger curve: robust evidence of each expert, a choice of experts for the whole video,
and a gate that stays shut without support. Works on long rows (video, expert, window), so experts cost no columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curvetrail.config import Gate
from curvetrail.functions.geometry import clip, num, sigmoid
from curvetrail.functions.signals import median_filter

KEYS = ["video_id", "expert_idx"]


def long_form(features: DataFrame, cfg: Gate = Gate()) -> DataFrame:
    """video_id, window_id, expert_idx, expert, weight, value for every expert of positive weight."""
    live = [(i, n, w) for i, (n, w) in enumerate(cfg.weights) if w > 0]
    entries = [F.struct(F.lit(i).alias("expert_idx"), F.lit(n).alias("expert"), num(w).alias("weight"), F.coalesce(F.col(n).cast("double") if n in features.columns else num(0), num(0)).alias("value")) for i, n, w in live]
    return features.select("video_id", "window_id", F.explode(F.array(*entries)).alias("e")).select("video_id", "window_id", "e.*")


def evidence_curves(long: DataFrame, cfg: Gate = Gate()) -> DataFrame:
    """Adds z (how far over the median, past the dead zone, capped) and z_persist (its median over three windows)."""
    whole = W.partitionBy(*KEYS)
    x = long.withColumn("p", F.percentile("value", F.array(num(0.5), num(0.98))).over(whole)).withColumn("med", F.col("p")[0])
    x = x.withColumn("sigma", F.percentile(F.abs(F.col("value") - F.col("med")), F.lit(0.5)).over(whole) * 1.4826)
    sigma = F.when(F.col("sigma") < 1e-6, F.greatest((F.col("p")[1] - F.col("med")) / 3.0, num(1e-6))).otherwise(F.col("sigma"))
    x = x.withColumn("z", clip((F.col("value") - F.col("med")) / sigma - cfg.dead_zone, 0.0, cfg.cap))
    return x.withColumn("z_persist", median_filter(F.col("z"), whole.orderBy("window_id"))).drop("p", "med", "sigma")


def _peak_stats(df: DataFrame, value: str) -> DataFrame:
    """Adds peak, background, prominence and dominance of an expert's curve."""
    x = df.withColumn("_p", F.percentile(value, F.array(num(0.98), num(0.5), num(0.8))).over(W.partitionBy(*KEYS)))
    x = x.withColumns({"peak": F.col("_p")[0], "background": F.col("_p")[1], "prominence": F.greatest(num(0), F.col("_p")[0] - F.col("_p")[1])})
    shoulder = F.greatest(num(0), F.col("_p")[2] - F.col("background"))
    return x.withColumn("dominance", F.col("prominence") / F.greatest(shoulder, num(1e-6))).drop("_p")


def salience(curves: DataFrame, cfg: Gate = Gate()) -> DataFrame:
    """Adds sparse (the expert peaks rarely and high), s, the curve that it is judged by (raw if sparse), and
    confidence, how much the expert stands for its video. All of it within one shuffle by expert."""
    x = _peak_stats(curves, "z").withColumn("sparse", (F.col("prominence") > cfg.prominence) & (F.col("dominance") >= cfg.dominance))
    x = _peak_stats(x.withColumn("s", F.when(F.col("sparse"), F.col("z")).otherwise(F.col("z_persist"))), "s")
    active = F.col("s") > F.greatest(num(cfg.active_from), F.col("background") + F.col("prominence") * 0.5)
    whole = W.partitionBy(*KEYS)
    x = x.withColumns({"_n": F.count("*").over(whole), "_on": F.count_if(active).over(whole), "_mean": F.avg(F.when(active, F.col("s"))).over(whole)})
    ratio = F.col("_on") / F.greatest(F.lit(1), F.col("_n"))
    cover = F.when(F.col("sparse"), F.greatest(num(0.2), num(1) - ratio * 0.5)).otherwise(F.greatest(num(0.1), num(1) - ratio / max(1e-6, cfg.max_active_ratio)))
    bonus = F.when(F.col("sparse"), F.least(num(2), F.col("dominance") / cfg.dominance)).otherwise(num(1))
    prom = F.col("prominence")
    full = F.col("weight") * prom * (prom * 0.5 + F.col("_mean") * 0.5) * cover * clip(prom / F.greatest(F.col("peak"), num(1e-6)), 0.0, 1.0) * bonus
    x = x.withColumn("confidence", F.when((prom > cfg.prominence) & (F.col("_on") > 0), full).otherwise(num(0)))
    return x.drop("_n", "_on", "_mean", "peak", "background", "prominence", "dominance")


def expert_confidence(sal: DataFrame) -> DataFrame:
    """One row an expert."""
    return sal.groupBy(*KEYS, "expert", "weight").agg(F.first("sparse").alias("sparse"), F.first("confidence").alias("confidence"))


def gate_experts(confidence: DataFrame, cfg: Gate = Gate()) -> DataFrame:
    """The experts that the gate listens to; of equal confidence the later one first."""
    rank = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("confidence"), F.desc("expert_idx")))
    kept = confidence.where(F.col("confidence") >= cfg.min_confidence).withColumn("rank", rank)
    return kept.where(F.col("rank") <= cfg.top_k) if cfg.top_k > 0 else kept


def gate_curves(sal: DataFrame, cfg: Gate = Gate()) -> DataFrame:
    """trigger, evidence, null_weight and active experts of every window. The experts' rank is the same in every
    window of a video, so it is taken within the window. A video without chosen experts has trigger 0, null weight 1,
    and as evidence the largest salience of all experts."""
    keys = ["video_id", "window_id"]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("expert_idx")))
    chosen = F.col("confidence") >= cfg.min_confidence
    picked = sal.withColumn("rank", rank).withColumn("picked", chosen & (F.col("rank") <= cfg.top_k) if cfg.top_k > 0 else chosen)
    p = F.col("picked")
    act = F.when(p, F.greatest(num(0), F.col("s") - cfg.active_from) * F.col("weight")).otherwise(num(0))
    a = picked.withColumn("act", act).groupBy(*keys).agg(
        F.bool_or("picked").alias("any"), F.max("s").alias("all_max"), F.max(F.when(p, F.col("s"))).alias("own_max"),
        F.sum("act").alias("sum"), F.sum(F.col("act") * F.col("s") / cfg.cap).alias("dot"), F.count_if(F.col("act") > 0).alias("on"),
        F.coalesce(F.bool_or(p & F.col("sparse") & (F.col("act") > 0)), F.lit(False)).alias("sparse_on"),
    )
    e, has = F.col("own_max"), F.col("any")
    rho = F.when(e >= cfg.active_from, sigmoid((e - cfg.evidence_mid) * cfg.steepness)).otherwise(num(0))
    weak = (F.col("on") < cfg.min_active) & (e < cfg.strong) & ~(F.col("sparse_on") & (e >= cfg.strong))
    a = a.withColumn("rho", F.when(has, F.when(weak, rho * cfg.lone_scale).otherwise(rho)).otherwise(num(0)))
    return a.select(
        *keys, (F.col("rho") * F.when(has, F.col("dot") / F.greatest(F.col("sum"), num(1e-6))).otherwise(num(0))).alias("trigger"),
        F.when(has, e).otherwise(F.col("all_max")).alias("evidence"), (num(1) - F.col("rho")).alias("null_weight"),
        F.when(has, F.col("on")).otherwise(F.lit(0)).cast("long").alias("active_experts"),
    )


def trigger_curve(features: DataFrame, cfg: Gate = Gate()) -> DataFrame:
    """Window features to gate curves."""
    return gate_curves(salience(evidence_curves(long_form(features, cfg), cfg), cfg), cfg)

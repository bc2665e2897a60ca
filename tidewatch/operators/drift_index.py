"""Per-feature attribution drift index and the composite scores built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import clip, ratio
from tidewatch.functions.runtime import by_shuffle
from tidewatch.operators.quality import detection_counts, detection_scores

# Default weights of (divergence, rank shift, direction flip).
ALPHA, BETA, GAMMA = 0.5, 0.3, 0.2

# Weight settings of the ablation study.
ABLATION = [
    (1.0, 0.0, 0.0, "KL only"),
    (0.0, 1.0, 0.0, "Rank shift only"),
    (0.0, 0.0, 1.0, "Direction flip only"),
    (0.33, 0.33, 0.34, "Equal weights"),
    (0.5, 0.3, 0.2, "Default weights"),
]


def index_components(fp_ref: DataFrame, fp_cur: DataFrame, kl: DataFrame, keys: list[str], ref_keys: list[str] = ()) -> DataFrame:
    """KL, normalised rank shift and strict sign flip per window and feature; unmatched features drop out.

    The reference has one fingerprint, or one for each value of ``ref_keys``.
    """
    ref = fp_ref.select(
        *ref_keys,
        "feature",
        F.col("rank").alias("ref_rank"),
        F.col("mean").alias("ref_mean"),
        F.col("mean_abs").alias("ref_abs"),
    )
    if not ref_keys:
        ref = F.broadcast(ref)  # one row per feature
    n = F.count("*").over(Window.partitionBy(*keys))  # features of one window
    cur = fp_cur.select(
        *keys,
        "feature",
        F.col("rank").alias("new_rank"),
        F.col("mean").alias("new_mean"),
        F.col("mean_abs").alias("new_abs"),
        n.alias("_n"),
    )
    flip = ((F.col("ref_mean") > 0) & (F.col("new_mean") < 0)) | ((F.col("ref_mean") < 0) & (F.col("new_mean") > 0))
    return cur.join(ref, [*ref_keys, "feature"]).join(by_shuffle(kl), [*keys, "feature"], "left").select(
        *keys,
        "feature",
        F.coalesce("kl", F.lit(0.0)).alias("kl"),
        (F.abs(F.col("new_rank") - F.col("ref_rank")) / F.col("_n")).alias("rank_shift"),
        F.when(flip, 1.0).otherwise(0.0).alias("direction_flip"),
        "ref_rank",
        "new_rank",
        "ref_mean",
        "new_mean",
        "ref_abs",
        "new_abs",
    )


def weighted(a=ALPHA, b=BETA, g=GAMMA) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    return lit(a) * F.col("kl") + lit(b) * F.col("rank_shift") + lit(g) * F.col("direction_flip")


def sadi(components: DataFrame, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    return components.withColumn("sadi", weighted(alpha, beta, gamma))


def sadi_batch(fp_ref: DataFrame, fp_cur: DataFrame, keys: list[str]) -> DataFrame:
    """Single-pass approximation for batch reports: relative importance change instead of KL, capped at 2."""
    none = fp_cur.select(*keys, "feature", F.lit(0.0).alias("kl"))
    c = index_components(fp_ref, fp_cur, none, keys)
    kl = F.least(F.abs(F.col("new_abs") - F.col("ref_abs")) / F.greatest(F.col("ref_abs"), F.lit(1e-3)), F.lit(2.0))
    flip = ((F.col("ref_mean") > 0) != (F.col("new_mean") > 0)) & (F.abs("ref_mean") > 1e-3)
    c = c.withColumn("kl", kl).withColumn("direction_flip", F.when(flip, 1.0).otherwise(0.0))
    return c.withColumn("sadi", weighted())


def top_mean(scores: DataFrame, score: str, keys: list[str], k: int = 10, by: Column | None = None) -> DataFrame:
    """Mean score of the k first features of each window (by score, or by ``by`` ascending)."""
    order = [F.col(score).desc(), F.col("feature")] if by is None else [by, F.col("feature")]
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        scores.withColumn("_rk", rk).filter(F.col("_rk") <= k).groupBy(*keys).agg(F.avg(score).alias("d_shap"))
    )


def d_total(sadi_scores: DataFrame, psi_scores: DataFrame, w1: DataFrame, keys: list[str]) -> DataFrame:
    """0.5 mean of the top 10 index values + 0.3 mean PSI + 0.2 prediction distance; empty parts are 0."""
    shap = top_mean(sadi_scores, "sadi", keys)
    feat = psi_scores.groupBy(*keys).agg(F.avg("psi").alias("d_feature"))
    conf = w1.select(*keys, F.col("w1").alias("d_confidence"))
    out = feat.join(by_shuffle(shap), keys, "left").join(by_shuffle(conf), keys, "left")
    parts = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ["d_shap", "d_feature", "d_confidence"]}
    total = ALPHA * parts["d_shap"] + BETA * parts["d_feature"] + GAMMA * parts["d_confidence"]
    return out.select(*keys, *[e.alias(c) for c, e in parts.items()], total.alias("d_total"))


def batch_total(d_shap: Column, d_feature: Column, d_conf: Column) -> Column:
    """Composite of a batch report."""
    return F.lit(0.60) * F.least(d_shap, F.lit(1.5)) + F.lit(0.15) * d_feature + F.lit(0.25) * F.least(d_conf, F.lit(1.0))


def fallback_total(share_high: Column, share_significant: Column) -> Column:
    """Composite of a batch report without a model."""
    return F.lit(0.6) * share_high + F.lit(0.4) * share_significant


def d_total_batch(scores: DataFrame, share: DataFrame, w1: DataFrame, keys: list[str]) -> DataFrame:
    """Batch composite: the index over the 10 features most important in the reference."""
    shap = top_mean(scores, "sadi", keys, by=F.col("ref_rank"))
    conf = w1.select(*keys, F.col("w1").alias("d_confidence"))
    out = share.join(shap, keys, "left").join(conf, keys, "left")
    s, c = F.coalesce("d_shap", F.lit(0.0)), F.coalesce("d_confidence", F.lit(0.0))
    return out.select(
        *keys,
        s.alias("d_shap"),
        F.col("share_high").alias("d_feature"),
        F.least(c, F.lit(1.0)).alias("d_confidence"),
        batch_total(s, F.col("share_high"), c).alias("d_total"),
    )


def belief(d: Column, adv: Column, sadi_weight: float = 0.6, adv_weight: float = 0.4) -> Column:
    """Weighted mean of both drift signals on [0, 1]."""
    if sadi_weight < 0 or adv_weight < 0:
        raise ValueError("weights must be non-negative")
    total = sadi_weight + adv_weight
    if total == 0:
        raise ValueError("at least one weight must be positive")
    a = clip((adv - F.lit(0.5)) / F.lit(0.5), 0.0, 1.0)
    return (F.lit(float(sadi_weight)) * clip(d, 0.0, 1.0) + F.lit(float(adv_weight)) * a) / F.lit(float(total))


def risk(baseline: Column, estimate: Column) -> Column:
    """Estimated loss of average precision."""
    return clip(baseline - estimate, 0.0, 1.0)


def ablation_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, a, b, g) for a, b, g, n in ABLATION], "config string, alpha double, beta double, gamma double"
    )


def ablation(
    components: DataFrame, parts: DataFrame, phases: DataFrame, keys: list[str], threshold: float = 0.3
) -> DataFrame:
    """Detector quality under each weight setting, recomputed from the index components.

    ``parts`` holds d_feature and d_confidence per window.
    """
    configs = F.broadcast(ablation_configs(components.sparkSession))  # five rows
    per = components.crossJoin(configs).withColumn(
        "sadi", weighted(F.col("alpha"), F.col("beta"), F.col("gamma"))
    )
    shap = top_mean(per, "sadi", ["config", "alpha", "beta", "gamma", *keys])
    total = shap.join(parts.select(*keys, "d_feature", "d_confidence"), keys).withColumn(
        "_d", ALPHA * F.col("d_shap") + BETA * F.col("d_feature") + GAMMA * F.col("d_confidence")
    )
    flagged = total.join(phases.select(*keys, "true_phase"), keys).select(
        "config", "alpha", "beta", "gamma", "true_phase", (F.col("_d") > threshold).alias("fired")
    )
    counts = flagged.groupBy("config", "alpha", "beta", "gamma").agg(*detection_counts("fired", "true_phase"))
    return detection_scores(counts, ["config", "alpha", "beta", "gamma"])


def mean_or_zero(num: Column, den: Column) -> Column:
    return ratio(num, den)

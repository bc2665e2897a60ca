"""Severity, direction, recommendation and structured alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import ladder
from tidewatch.functions.runtime import by_shuffle

# Severity ladders (edges, labels) of alerts, run review and batch reports.
LADDERS = {
    "alert": ([0.3, 0.5, 0.8], ["LOW", "MODERATE", "HIGH", "SEVERE"]),
    "review": ([0.3, 0.6, 1.0], ["NOMINAL", "MODERATE", "HIGH", "CRITICAL"]),
    "batch": ([0.21, 0.25, 0.30], ["NOMINAL", "MODERATE", "HIGH", "SEVERE"]),
}

# Wording of attribution changes.
DIRECTIONS = ["⇅ FLIPPED", "↑ SHIFTED UP", "↓ SHIFTED DOWN", "⟷ STABLE"]

# Recommendation text by intervention level; {} is the feature list.
RECOMMENDATIONS = [
    "No action required. The model is performing within expected parameters. Continue routine monitoring.",
    "Minor distributional shift detected in: {}. No immediate model changes needed. Increase monitoring "
    "frequency and verify that data ingestion pipelines are functioning normally. Notify the clinical "
    "informatics team.",
    "Moderate drift detected in: {}. Recommend Platt-scaling recalibration of the model using the most "
    "recent labelled data. Review whether changes in clinical protocols or lab assay methods may explain the "
    "shift. Schedule a model performance review within 48 hours.",
    "Significant drift detected in: {}. Recommend partial retraining — update the model using recent data "
    "while retaining the current architecture. Prioritise retraining on the most-shifted features. Validate "
    "retrained model on a held-out set before deployment. Escalate to the ML operations team.",
    "Severe drift detected across multiple features including: {}. Full model retraining is required with "
    "updated feature engineering and data pipelines. Consider whether the target population or clinical "
    "workflows have changed fundamentally. Revert to a validated fallback model or clinical decision rule "
    "until the retrained model is validated and approved for deployment.",
]

# Fixed values: (title, priority, action) by severity step of run review and batch reports.
REVIEW_ADVICE = {
    "review": [
        ("No Action Required", "LOW", "Continue routine monitoring on the next data batch."),
        (
            "Recalibration Recommended",
            "MEDIUM",
            "Recalibrate the model using the last 30 days of ICU records within 1-2 weeks.",
        ),
        (
            "Partial Retrain Required",
            "HIGH",
            "Retrain the model on affected features using the last 60 days of data within 1 week.",
        ),
        (
            "Full Retrain Urgent",
            "CRITICAL",
            "Immediately flag for clinical review. Full model retrain required before continued use.",
        ),
    ],
    "batch": [
        ("No Action Required", "LOW", "Continue routine monitoring on the next data batch."),
        ("Recalibration Recommended", "MEDIUM", "Recalibrate the calibration layer."),
        ("Significant Drift Warning", "HIGH", "Retrain Calibration."),
        ("Severe Pipeline Drift", "URGENT", "Urgent Retrain"),
    ],
}


def severity(d: Column, kind: str = "alert") -> Column:
    return ladder(d, *LADDERS[kind])


def direction(ref: Column, cur: Column) -> Column:
    """Change of a mean attribution: sign flip, magnitude up or down by more than 20 %, or stable."""
    change = (F.abs(cur) - F.abs(ref)) / F.greatest(F.abs(ref), F.lit(1e-10))
    flipped = (ref != 0) & (cur != 0) & ((ref > 0) != (cur > 0))
    return (
        F.when(flipped, DIRECTIONS[0])
        .when(change > 0.20, DIRECTIONS[1])
        .when(change < -0.20, DIRECTIONS[2])
        .otherwise(DIRECTIONS[3])
    )


def feature_list(features: Column, n: int) -> Column:
    return F.when(F.size(features) > 0, F.array_join(F.slice(features, 1, n), ", ")).otherwise("N/A")


def recommendation(level: Column, features: Column) -> Column:
    """Recommendation paragraph of an intervention level with the first five features."""
    names = feature_list(features, 5)

    def text(template):
        parts = template.split("{}")
        return F.lit(template) if len(parts) == 1 else F.concat(F.lit(parts[0]), names, F.lit(parts[1]))

    out = F.when(level == 0, text(RECOMMENDATIONS[0]))
    for i in (1, 2, 3):
        out = out.when(level == i, text(RECOMMENDATIONS[i]))
    return out.otherwise(text(RECOMMENDATIONS[4]))


def advice(d: Column, features: Column, kind: str) -> dict[str, Column]:
    """Title, priority, action and the first three features by severity step."""
    edges, _ = LADDERS[kind]
    rows = REVIEW_ADVICE[kind]
    return {
        "title": ladder(d, edges, [r[0] for r in rows]),
        "priority": ladder(d, edges, [r[1] for r in rows]),
        "next_action": ladder(d, edges, [r[2] for r in rows]),
        "n_features": F.size(features),
        "feature_note": feature_list(features, 3),
    }


def build_alerts(results: DataFrame, top: DataFrame, keys: list[str], min_level: int = 2) -> DataFrame:
    """One structured alert per window at or above ``min_level``.

    ``top`` holds (keys, feature, sadi, ref_mean, new_mean, rank) of the top features of each window.
    """
    from tidewatch.operators.fairness import check

    due = results.filter(F.col("intervention_level") >= min_level)
    moves = (
        top.withColumn("direction", direction(F.col("ref_mean"), F.col("new_mean")))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "sadi", "direction"))).alias("top_features"))
    )
    drop = F.col("baseline_auprc") - F.col("est_auprc")
    names = F.transform("top_features", lambda t: t["feature"])
    fair = check(F.col("dpd"), F.col("eod"))
    base = due.join(by_shuffle(moves), keys, "left").select(
        *keys,
        "true_phase",
        F.col("intervention_level").alias("level"),
        F.col("intervention_action").alias("action"),
        severity(F.col("D_total")).alias("severity"),
        "D_total",
        "risk_score",
        "baseline_auprc",
        "est_auprc",
        drop.alias("auprc_drop"),
        F.when(F.col("baseline_auprc") > 0, drop / F.col("baseline_auprc") * 100).otherwise(0.0).alias("auprc_drop_pct"),
        "top_features",
        fair["alert_message"].alias("fairness_note"),
        recommendation(F.col("intervention_level"), names).alias("recommendation"),
    )
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("Drift Severity: "), F.col("severity")),
        F.concat(F.lit("Intervention: Level "), F.col("level").cast("string"), F.lit(" "), F.col("action")),
        F.when(F.col("fairness_note") != "", F.col("fairness_note")),
        F.col("recommendation"),
    )
    return base.withColumn("alert_text", line)

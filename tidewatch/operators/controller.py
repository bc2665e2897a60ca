"""Graded intervention from drift score and estimated risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Actions and messages by level.
ACTIONS = ["NO_ACTION", "ALERT", "RECALIBRATE", "PARTIAL_RETRAIN", "FULL_RETRAIN"]
MESSAGES = [
    "System operating within normal parameters. No action required.",
    "Minor drift detected. Clinical team notified for awareness.",
    "Moderate drift detected. Model recalibration recommended.",
    "Significant drift detected. Partial model retraining on recent data recommended.",
    "Severe drift detected. Full model retraining with updated feature pipeline required.",
]


def intervention_level(
    d: Column, risk: Column, threshold: float = 0.3, moderate: float = 0.05, high: float = 0.10
) -> Column:
    """0 needs both signals low; 1 and 2 need one of them low; 3 and 4 depend on the drift score."""
    return (
        F.when((d < threshold) & (risk < moderate), 0)
        .when((d < threshold * 1.3) | (risk < moderate), 1)
        .when((d < threshold * 1.7) | (risk < high), 2)
        .when(d < threshold * 2.2, 3)
        .otherwise(4)
    )


def level_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, a, m) for i, (a, m) in enumerate(zip(ACTIONS, MESSAGES))], "level int, action string, message string"
    )


def decide(df: DataFrame, d: str, risk: str, **thresholds) -> DataFrame:
    """Add level, action and message."""
    leveled = df.withColumn("level", intervention_level(F.col(d), F.col(risk), **thresholds))
    return leveled.join(F.broadcast(level_labels(df.sparkSession)), "level")  # five rows

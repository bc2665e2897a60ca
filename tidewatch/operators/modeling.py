"""Splits, training, calibration and scoring on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import hash_bits, sanitized
from tidewatch.operators.cohort import require_positives
from tidewatch.operators.ordered import grouped_index


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` (train / val): exactly the share of each class, chosen by a keyed hash."""
    hashed = df.withColumn("_h", hash_bits(F.col(key), seed))
    ranked = grouped_index(hashed, [label], ["_h", key], "_rn", totals=True)
    val = F.col("_rn") <= F.floor(F.col("_rn_total") * F.lit(float(share)))
    return ranked.withColumn("split", F.when(val, "val").otherwise("train")).drop("_h", "_rn", "_rn_total")


def clean_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*[sanitized(F.col(c)).alias(c) if c in features else F.col(c) for c in df.columns])


def balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (2 n_class) per row."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count("*").alias("_n"))
    of = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return df.crossJoin(F.broadcast(counts)).withColumn(name, F.col("_n") / (2.0 * of)).drop("_p", "_n")  # one row


def train_gbt(
    df: DataFrame,
    features: list[str],
    label: str,
    split: str = "split",
    trees: int = 100,
    depth: int = 5,
    step: float = 0.1,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees with imbalance weights; the ``val`` rows stop the boosting early."""
    require_positives(df.filter(F.col(split) == "train"), label)
    counts = df.filter(F.col(split) == "train").agg(
        (F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("_r")
    )
    rows = clean_features(df, features).crossJoin(F.broadcast(counts))  # one row
    rows = rows.withColumn("weight", F.when(F.col(label) == 1, F.col("_r")).otherwise(1.0)).withColumn(
        "is_val", F.col(split) == "val"
    )
    stages = [
        VectorAssembler(inputCols=features, outputCol="features"),
        GBTClassifier(
            labelCol=label,
            weightCol="weight",
            validationIndicatorCol="is_val",
            maxIter=trees,
            maxDepth=depth,
            stepSize=step,
            subsamplingRate=0.8,
            seed=seed,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def train_lr(df: DataFrame, features: list[str], label: str, max_iter: int = 1000) -> PipelineModel:
    """Class-balanced logistic regression with unit L2 penalty on the coefficients as they are (scale the features first)."""
    require_positives(df, label)
    rows = balanced_weight(clean_features(df, features), label)
    n = rows.count()
    stages = [
        VectorAssembler(inputCols=features, outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter, regParam=1.0 / max(n, 1), standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """P(y = 1) and the margin of every row."""
    scored = model.transform(clean_features(df, features))
    raw = vector_to_array("rawPrediction")[1]
    return scored.select(*keep, vector_to_array("probability")[1].alias("p"), raw.alias("margin"))


def calibrate(scored: DataFrame, label: str, method: str = "sigmoid"):
    """Function that sets ``p`` of rows with a ``margin`` to the calibrated probability, fitted on held-out rows."""
    if method == "sigmoid":
        rows = VectorAssembler(inputCols=["margin"], outputCol="m").transform(scored)
        fit = LogisticRegression(featuresCol="m", labelCol=label, maxIter=200).fit(rows)
        a, b = float(fit.coefficients[0]), float(fit.intercept)
        return lambda df: df.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("margin") + F.lit(b)))))
    if method == "isotonic":
        fit = IsotonicRegression(featuresCol="margin", labelCol=label, predictionCol="p").fit(scored.drop("p"))
        return lambda df: fit.transform(df.drop("p"))
    raise ValueError(f"method must be 'sigmoid' or 'isotonic', got {method!r}")

"""Projections and cleaning: alignment, sanitizing, missingness, fills, scaling, table perturbation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.columns import finite, hash_normal, hash_uniform, sanitized
from tidewatch.operators.ordered import exact_quantiles, last_known

# Columns that are never treated as features and never dropped.
PROTECTED = ("patient_id", "phase", "SepsisLabel", "window_id", "label")


def align_columns(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Model columns in model order; a column absent from the upload is NULL."""
    have = set(df.columns)
    return df.select(
        *keep, *[F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in features]
    )


def numeric_features(df: DataFrame, protected=PROTECTED) -> list[str]:
    """Numeric columns minus the protected names, from the schema alone."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in protected]


def with_columns(df: DataFrame, exprs: dict) -> DataFrame:
    """One projection that replaces the named columns in place."""
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def null_non_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    return with_columns(df, {c: finite(F.col(c)) for c in cols if c in df.columns})


def sanitize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-finite and missing values become 0."""
    return with_columns(df, {c: sanitized(F.col(c)) for c in cols if c in df.columns})


def missingness(df: DataFrame, threshold: float = 0.6, protected=PROTECTED) -> DataFrame:
    """(column, missing_frac, dropped) for every column, by one map-side-combined aggregate."""
    cols = df.columns
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "missing_frac").select(
        "column",
        "missing_frac",
        ((F.col("missing_frac") > threshold) & ~F.col("column").isin(*protected)).alias("dropped"),
    )


def drop_high_missing(df: DataFrame, threshold: float = 0.6, protected=PROTECTED) -> tuple[DataFrame, list[str]]:
    """Drop columns whose NULL share exceeds the threshold. One action: the schema depends on the data."""
    bad = {r["column"] for r in missingness(df, threshold, protected).filter("dropped").collect()}
    dropped = [c for c in df.columns if c in bad]
    return df.drop(*dropped), dropped


def forward_fill(df: DataFrame, cols: list[str], entity: str | None = "patient_id", hour: str = "ICULOS") -> DataFrame:
    """Last observation carried forward inside each entity (over everything when there is no entity)."""
    keys = [entity] if entity and entity in df.columns else []
    return last_known(df, keys, [hour], cols)


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, median): exact, one row per feature."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "feature", "value")
    return exact_quantiles(long, ["feature"], "value", {"median": 0.5})


def median_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """Medians as one row, a column per feature."""
    return medians(df, cols).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_med_{c}") for c in cols]
    )


def median_fill(df: DataFrame, reference: DataFrame, cols: list[str], fallback: float | None = None) -> DataFrame:
    """Fill NULLs with the reference medians (one broadcast row); ``fallback`` where no median exists."""
    meds = median_row(reference, cols)
    joined = df.crossJoin(F.broadcast(meds))  # exactly one row on the right
    alt = [] if fallback is None else [F.lit(float(fallback))]
    exprs = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"), *alt) for c in cols}
    return joined.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, scale): population std, zero variance scales by 1; missing counts as 0."""
    clean = df.select(*[sanitized(F.col(c)).alias(c) for c in cols])
    aggs = []
    for c in cols:
        aggs.append(F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")))
    wide = clean.agg(F.array(*aggs).alias("params"))
    return wide.select(F.inline("params")).select(
        "feature", "mean", F.when(F.coalesce("std", F.lit(0.0)) > 0, F.col("std")).otherwise(1.0).alias("scale")
    )


def scale(df: DataFrame, cols: list[str], scaler: DataFrame) -> DataFrame:
    """z-scores with an already fitted scaler (one broadcast row)."""
    row = scaler.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_mu_{c}") for c in cols],
        *[F.max(F.when(F.col("feature") == c, F.col("scale"))).alias(f"_sd_{c}") for c in cols],
    )
    joined = df.crossJoin(F.broadcast(row))  # exactly one row on the right
    exprs = {c: (sanitized(F.col(c)) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}") for c in cols}
    return joined.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def preprocess(
    df: DataFrame,
    reference_filter=None,
    missing_threshold: float = 0.6,
    entity: str = "patient_id",
    hour: str = "ICULOS",
    protected=PROTECTED,
    impute=None,
    scaler: DataFrame | None = None,
) -> tuple[DataFrame, dict]:
    """Forward fill, drop sparse columns, impute, scale. The scaler is fitted on the reference rows only."""
    keep = tuple(protected) + (entity, hour)
    cols = [c for c in numeric_features(df, keep)]
    filled = forward_fill(df, cols, entity, hour) if hour in df.columns else df
    kept, dropped = drop_high_missing(filled, missing_threshold, keep)
    features = [c for c in cols if c not in dropped]
    if impute is not None:
        kept = impute(kept, features)
    fit_on = kept.filter(reference_filter) if reference_filter is not None else kept
    fitted = scaler if scaler is not None else fit_scaler(fit_on, features)
    return scale(kept, features, fitted), {"scaler": fitted, "dropped_features": dropped, "feature_cols": features}


@dataclass(frozen=True)
class Shift:
    """One perturbation of the columns that are, or start with, ``base``, in one phase."""

    phase: str
    base: str
    multiply: float = 1.0
    add: float = 0.0
    noise_std: float = 0.0
    component: str = "shift"

    def columns(self, available: list[str]) -> list[str]:
        return [c for c in available if c == self.base or c.startswith(self.base + "_")]


@dataclass(frozen=True)
class LabelFlip:
    phase: str
    rate: float


def apply_shift_spec(
    df: DataFrame,
    shifts: list[Shift],
    features: list[str],
    key: str = "row_idx",
    phase: str = "phase",
    label: str | None = None,
    flip: LabelFlip | None = None,
    decimals: int = 6,
) -> DataFrame:
    """Perturb a table for back-testing a monitor. Noise comes from a keyed hash, so reruns agree.

    NULLs stay NULL. One projection, no shuffle.
    """
    exprs = {}
    for i, s in enumerate(shifts):
        for c in s.columns(features):
            cur = exprs.get(c, F.col(c).cast("double"))
            moved = cur * F.lit(float(s.multiply)) + F.lit(float(s.add))
            if s.noise_std:
                moved = moved + hash_normal(F.col(key), 10 * (i + 1)) * F.lit(float(s.noise_std))
            exprs[c] = F.when(F.col(phase) == s.phase, moved).otherwise(cur)
    exprs = {c: F.round(e, decimals) for c, e in exprs.items()}
    if flip and label:
        hit = (F.col(phase) == flip.phase) & (hash_uniform(F.col(key), 7) <= flip.rate)
        exprs[label] = F.when(hit, 1 - F.col(label)).otherwise(F.col(label)).cast("int")
    return with_columns(df, exprs)


def drift_truth(spark: SparkSession, shifts: list[Shift], features: list[str]) -> DataFrame:
    """(column, base_feature, phase, component) implied by a shift specification."""
    rows = [(c, s.base, s.phase, s.component) for s in shifts for c in s.columns(features)]
    return spark.createDataFrame(rows, "column string, base_feature string, phase string, component string")

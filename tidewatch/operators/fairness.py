"""Group fairness of thresholded predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import ratio, right_closed_bins
from tidewatch.operators.quality import average_precision

# Default age bands.
AGE_EDGES = [0.0, 40.0, 65.0, 200.0]
AGE_LABELS = ["young_0-40", "middle_40-65", "elderly_65+"]


def age_group(age: Column, edges: list[float] | None = None) -> Column:
    """Right-closed bands, lowest edge included; custom edges are named group_i; others are 'unknown'."""
    if edges is None:
        return right_closed_bins(age, AGE_EDGES, AGE_LABELS)
    return right_closed_bins(age, edges, [f"group_{i}" for i in range(len(edges) - 1)])


def group_rates(df: DataFrame, keys: list[str], group: str, predicted: Column, label: str) -> DataFrame:
    """Selection, true-positive and false-positive rate per group; empty denominators give 0."""
    y, p = F.col(label) == 1, predicted == 1
    return (
        df.groupBy(*keys, group)
        .agg(
            F.count("*").alias("n"),
            F.count_if(p).alias("_sel"),
            F.count_if(y & p).alias("_tp"),
            F.count_if(y).alias("_pos"),
            F.count_if(~y & p).alias("_fp"),
            F.count_if(~y).alias("_neg"),
        )
        .select(
            *keys,
            group,
            "n",
            ratio(F.col("_sel"), F.col("n")).alias("selection_rate"),
            ratio(F.col("_tp"), F.col("_pos")).alias("tpr"),
            ratio(F.col("_fp"), F.col("_neg")).alias("fpr"),
        )
    )


def fairness(df: DataFrame, keys: list[str], group: str, predicted: Column, label: str, digits: int = 4) -> DataFrame:
    """Demographic parity and equalized odds differences; fewer than two groups give 0."""

    def spread(c):
        return F.max(c) - F.min(c)

    rates = group_rates(df, keys, group, predicted, label)
    return rates.groupBy(*keys).agg(
        F.count("*").alias("n_groups"),
        F.round(spread("selection_rate"), digits).alias("dpd"),
        F.round(F.greatest(spread("tpr"), spread("fpr")), digits).alias("eod"),
    )


def binary_parity(df: DataFrame, keys: list[str], flag: str, predicted: Column) -> DataFrame:
    """|rate0 - rate1| of a 0/1 attribute; 0 when either side is empty."""
    r0 = F.avg(F.when(F.col(flag) == 0, predicted.cast("double")))
    r1 = F.avg(F.when(F.col(flag) == 1, predicted.cast("double")))
    return df.groupBy(*keys).agg(F.coalesce(F.abs(r0 - r1), F.lit(0.0)).alias("dpd"))


def check(dpd: Column, eod: Column, dpd_threshold: float = 0.10, eod_threshold: float = 0.10) -> dict[str, Column]:
    """Exceedance flags and the alert message."""
    d, e = F.abs(dpd) > dpd_threshold, F.abs(eod) > eod_threshold
    text = "%s ({}) exceeds threshold (%.2f)."

    def part(flag, name, value, limit):
        head, tail = (text % (name, limit)).split("{}")
        return F.when(flag, F.concat(F.lit(head), F.format_string("%.4f", value), F.lit(tail)))

    message = F.concat_ws(
        " ",
        part(d, "Demographic Parity Difference", dpd, dpd_threshold),
        part(e, "Equalized Odds Difference", eod, eod_threshold),
    )
    return {"dpd_exceeded": d, "eod_exceeded": e, "alert_message": message}


def subgroup_metrics(df: DataFrame, keys: list[str], group: str, predicted: Column, label: str, score: str) -> DataFrame:
    """n, prevalence, precision, recall, F1 and average precision per subgroup, 4 digits."""
    y, p = F.col(label) == 1, predicted == 1
    counts = df.groupBy(*keys, group).agg(
        F.count("*").alias("n"),
        F.avg(F.col(label).cast("double")).alias("_prev"),
        F.count_if(y & p).alias("_tp"),
        F.count_if(p).alias("_pred"),
        F.count_if(y).alias("_pos"),
    )
    precision, recall = ratio(F.col("_tp"), F.col("_pred")), ratio(F.col("_tp"), F.col("_pos"))
    ap = average_precision(df, [*keys, group], score, label).drop("n")
    return counts.join(ap, [*keys, group], "left").select(
        *keys,
        group,
        "n",
        F.round("_prev", 4).alias("prevalence"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
        F.round(F.coalesce("auprc", F.lit(0.0)), 4).alias("auprc"),
    )

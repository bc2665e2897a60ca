"""Model quality from scored rows, with and without labels. Everything is grouped, no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import clip, ratio, right_closed_bins  # noqa: F401
from tidewatch.operators.ordered import running_totals


def threshold_curve(df: DataFrame, keys: list[str], score: str, label: str, bounded: bool = False) -> DataFrame:
    """Counts at or above each distinct score: the ROC and precision-recall curves as a table.

    Equal scores collapse first, map-side. ``label`` may be fractional (expected counts).
    """
    y = F.col(label).cast("double")
    cells = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(score).alias("threshold"))
        .agg(F.count("*").alias("_n"), F.sum(y).alias("_pos"))
    )
    run = running_totals(
        cells,
        keys,
        [F.col("threshold").desc()],
        {"n_pred": F.col("_n"), "tp": F.col("_pos")},
        totals=True,
        bounded=bounded,
    )
    return run.select(
        *keys,
        "threshold",
        F.col("_n").alias("n_at"),
        F.col("_pos").alias("pos_at"),
        "n_pred",
        "tp",
        F.col("n_pred_total").alias("n"),
        F.col("tp_total").alias("n_pos"),
    )


def ap_expr() -> Column:
    """Average precision over a threshold curve: sum of precision times recall step."""
    return F.coalesce(
        F.sum((F.col("pos_at") / F.nullif(F.col("n_pos"), F.lit(0.0))) * (F.col("tp") / F.col("n_pred"))), F.lit(0.0)
    )


def auroc_expr() -> Column:
    """Rank-sum area under ROC with half credit for ties; 0.5 when one class is missing."""
    neg_at = F.col("n_at") - F.col("pos_at")
    neg_below = (F.col("n") - F.col("n_pos")) - (F.col("n_pred") - F.col("tp"))
    wins = F.sum(F.col("pos_at") * (neg_below + neg_at / 2))
    pairs = F.max(F.col("n_pos") * (F.col("n") - F.col("n_pos")))
    return ratio(wins, pairs, 0.5)


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, one_class: float = 0.0,
                      min_rows: int = 0, too_few: float = 0.5) -> DataFrame:
    """Average precision; one class gives ``one_class``, fewer than ``min_rows`` rows give ``too_few``."""
    curve = threshold_curve(df, keys, score, label)
    out = curve.groupBy(*keys).agg(ap_expr().alias("_ap"), F.max("n").alias("n"), F.max("n_pos").alias("_p"))
    value = (
        F.when(F.col("n") < min_rows, F.lit(too_few))
        .when((F.col("_p") == 0) | (F.col("_p") == F.col("n")), F.lit(one_class))
        .otherwise(F.col("_ap"))
    )
    return out.select(*keys, "n", value.alias("auprc"))


def area_under_roc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    return threshold_curve(df, keys, score, label).groupBy(*keys).agg(auroc_expr().alias("auroc"))


def brier(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    gap = F.col(label).cast("double") - F.col(score)
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier_score"))


def best_threshold(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Threshold with the largest F1 on the curve; the lowest one on ties."""
    curve = threshold_curve(df, keys, score, label)
    precision, recall = F.col("tp") / F.col("n_pred"), ratio(F.col("tp"), F.col("n_pos"))
    f1 = F.round(ratio(2 * precision * recall, precision + recall), 12)
    return curve.groupBy(*keys).agg(
        F.coalesce(F.max_by("threshold", F.struct(f1, -F.col("threshold"))), F.lit(0.5)).alias("threshold"),
        F.max(f1).alias("f1"),
    )


def confusion(df: DataFrame, keys: list[str], predicted: Column, label: str) -> DataFrame:
    y, p = F.col(label) == 1, predicted == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def class_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted means, accuracy."""

    def per_class(tp, fp, fn):
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        return p, r, ratio(2 * p * r, p + r), (tp + fn)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    zero, one = per_class(tn, fn, fp), per_class(tp, fp, fn)
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [ratio(a * zero[3] + b * one[3], n) for a, b in zip(zero[:3], one[:3])]
    acc = ratio(tp + tn, n)
    lines = [("0", *zero), ("1", *one), ("macro avg", *macro, n), ("weighted avg", *weighted, n), ("accuracy", acc, acc, acc, n)]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                s.cast("long").alias("support"),
            )
            for name, p, r, f, s in lines
        ]
    )
    return counts.select(*keys, F.inline(rows))


def evaluate_model(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """All quality metrics of scored tables, one row per group.

    The curve is scanned once; Brier comes from the same collapsed cells.
    """
    curve = threshold_curve(df, keys, score, label)
    precision, recall = F.col("tp") / F.col("n_pred"), ratio(F.col("tp"), F.col("n_pos"))
    f1 = F.round(ratio(2 * precision * recall, precision + recall), 12)
    t = F.col("threshold")
    sq = F.col("pos_at") * (1 - t) * (1 - t) + (F.col("n_at") - F.col("pos_at")) * t * t
    best = F.max_by(
        F.struct(t.alias("t"), F.col("tp").alias("tp"), F.col("n_pred").alias("n_pred")), F.struct(f1, -t)
    )
    out = curve.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("n_pos").alias("n_pos"),
        ap_expr().alias("auprc"),
        auroc_expr().alias("auroc"),
        (F.sum(sq) / F.max("n")).alias("brier_score"),
        best.alias("_b"),
        F.max(f1).alias("f1_at_threshold"),
    )
    tp, pred = F.col("_b.tp"), F.col("_b.n_pred")
    fp, fn = pred - tp, F.col("n_pos") - tp
    return out.select(
        *keys,
        "n",
        F.col("n_pos").cast("long").alias("n_pos"),
        "auprc",
        "auroc",
        "brier_score",
        F.col("_b.t").alias("optimal_threshold"),
        "f1_at_threshold",
        tp.cast("long").alias("tp"),
        fp.cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        (F.col("n") - tp - fp - fn).cast("long").alias("tn"),
    )


def calibration_bins(df: DataFrame, keys: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Fraction of positives and mean prediction per uniform bin; empty bins are absent."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(F.col(label).cast("double")).alias("fraction_positive"),
        F.avg(score).alias("mean_predicted"),
    )


def expected_performance(df: DataFrame, chunk: str, score: str, reference_chunks: DataFrame | None = None) -> DataFrame:
    """Label-free average precision and AUROC per chunk, taking calibrated scores as fractional labels.

    ``reference_chunks`` (chunk, auprc) gives the mean +- 3 sigma band; chunks are of bounded size.
    """
    curve = threshold_curve(df, [chunk], score, score, bounded=True)
    # a score cell of n rows at p holds n p expected positives; ties inside a cell count one half
    neg_at = F.col("n_at") - F.col("pos_at")
    neg_below = (F.col("n") - F.col("n_pos")) - (F.col("n_pred") - F.col("tp"))
    wins = F.sum(F.col("pos_at") * (neg_below + neg_at / 2))
    pairs = F.max(F.col("n_pos") * (F.col("n") - F.col("n_pos")))
    est = curve.groupBy(chunk).agg(
        F.max("n").alias("n"),
        clip(ap_expr(), 0.0, 1.0).alias("estimated_auprc"),
        clip(ratio(wins, pairs, 0.5), 0.0, 1.0).alias("estimated_auroc"),
    )
    if reference_chunks is None:
        return est
    band = reference_chunks.agg(F.stddev_samp("auprc").alias("_sd"))
    width = F.lit(3.0) * F.coalesce("_sd", F.lit(0.0))
    return est.crossJoin(F.broadcast(band)).select(  # one row
        chunk,
        "n",
        "estimated_auprc",
        "estimated_auroc",
        clip(F.col("estimated_auprc") - width, 0.0, 1.0).alias("lower_bound"),
        clip(F.col("estimated_auprc") + width, 0.0, 1.0).alias("upper_bound"),
    )


def estimate_from_distance(w1: Column, baseline: Column) -> dict[str, Column]:
    """Average precision expected after a prediction shift of size ``w1``, with a 5 % margin."""
    est = clip(baseline * (1 - F.least(w1, F.lit(1.0))), 0.0, 1.0)
    return {
        "est_auprc": est,
        "lower_bound": clip(est - 0.05 * est, 0.0, 1.0),
        "upper_bound": clip(est + 0.05 * est, 0.0, 1.0),
    }


def detection_counts(fired: str, phase: str) -> list[Column]:
    drift, hit = F.col(phase) != "phase1", F.col(fired)
    return [
        F.count_if(hit & drift).alias("tp"),
        F.count_if(hit & ~drift).alias("fp"),
        F.count_if(~hit & drift).alias("fn"),
    ]


def detection_scores(counts: DataFrame, keep: list[str], digits: int = 4) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        *keep,
        F.round(p, digits).alias("precision"),
        F.round(r, digits).alias("recall"),
        F.round(ratio(2 * p * r, p + r), digits).alias("f1"),
    )

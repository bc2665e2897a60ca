"""Review queries over the per-window result tables of one or many runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import ratio
from tidewatch.operators.alerts import severity
from tidewatch.operators.ordered import exact_quantiles

SCORES = ["D_total", "D_shap", "adv_score", "drift_belief", "risk_score", "est_auprc"]


def results_filter(results: DataFrame, low: int, high: int, phases: list[str]) -> DataFrame:
    return results.filter(F.col("window_num").between(low, high) & F.col("true_phase").isin(*phases))


def phase_summary(results: DataFrame, keys: list[str] = (), digits: int = 4) -> DataFrame:
    return results.groupBy(*keys, "true_phase").agg(
        F.count("*").alias("windows"),
        F.round(F.avg("D_total"), digits).alias("d_total_mean"),
        F.round(F.max("D_total"), digits).alias("d_total_max"),
        F.round(F.avg("D_shap"), digits).alias("d_shap_mean"),
        F.round(F.avg("adv_score"), digits).alias("adv_mean"),
        F.round(F.avg("risk_score"), digits).alias("risk_mean"),
        F.round(F.avg("est_auprc"), digits).alias("est_auprc_mean"),
        F.max("intervention_level").alias("max_level"),
    )


def phase_fairness(results: DataFrame, keys: list[str] = (), digits: int = 4) -> DataFrame:
    return results.groupBy(*keys, "true_phase").agg(
        F.round(F.avg("dpd"), digits).alias("mean_dpd"),
        F.round(F.max("dpd"), digits).alias("max_dpd"),
        F.round(F.avg("eod"), digits).alias("mean_eod"),
        F.round(F.max("eod"), digits).alias("max_eod"),
    )


def run_kpis(results: DataFrame, threshold: float = 0.3, keys: list[str] = ()) -> DataFrame:
    """Headline numbers: overall means and maxima, windows over the threshold, the latest window."""
    latest = F.max_by(F.struct("D_total", "intervention_level", "est_auprc", "baseline_auprc"), "window_num")
    out = results.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.avg("D_total").alias("mean_d_total"),
        F.max("D_total").alias("max_d_total"),
        F.count_if(F.col("D_total") > threshold).alias("over_threshold"),
        F.avg("adv_score").alias("mean_adv"),
        F.avg("dpd").alias("mean_dpd"),
        F.max("dpd").alias("max_dpd"),
        F.avg("eod").alias("mean_eod"),
        F.max("eod").alias("max_eod"),
        latest.alias("_l"),
    )
    base, est = F.col("_l.baseline_auprc"), F.col("_l.est_auprc")
    return out.select(
        *[c for c in out.columns if c != "_l"],
        F.col("_l.D_total").alias("latest_d_total"),
        severity(F.col("_l.D_total"), "review").alias("latest_severity"),
        F.col("_l.intervention_level").alias("latest_level"),
        F.when(base > 0, base - est).otherwise(0.0).alias("perf_drop"),
    )


def describe(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, as rows. Quartiles are exact and distributed."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), cols, "column", "value")
    by = [*keys, "column"]
    q = exact_quantiles(long, by, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    stats = long.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return stats.join(q, by, "left")


def score_corr(results: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of scores, long, from one aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = results.groupBy(*keys).agg(
        *[
            # NULL for a constant score, where the built-in corr divides by zero under ANSI mode
            F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return wide.select(*keys, F.inline(cells))


def value_counts(df: DataFrame, col: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, col).agg(F.count("*").alias("n"))


def phase_ranges(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    return results.groupBy(*keys, "true_phase").agg(
        (F.min("window_num") - 0.5).alias("x0"), (F.max("window_num") + 0.5).alias("x1")
    )


def flag_counts(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    return results.select(
        *keys,
        "window_num",
        F.size("ks_flagged_features").alias("ks_flagged"),
        F.size("psi_flagged_features").alias("psi_flagged"),
        "ks_detected",
        "psi_detected",
    )


def feature_events(results: DataFrame, col: str = "top_sadi_features", keys: list[str] = ()) -> DataFrame:
    """One row per listed feature: (window_num, feature, rank from 1, phase)."""
    return results.select(*keys, "window_num", "true_phase", F.posexplode(col).alias("_pos", "feature")).select(
        *keys, "window_num", "feature", (F.col("_pos") + 1).alias("rank"), F.col("true_phase").alias("phase")
    )


def feature_freq(events: DataFrame, n: int = 15) -> DataFrame:
    return events.groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "feature").limit(n)


def rank_heatmap(events: DataFrame, n: int = 10) -> DataFrame:
    """Best rank of each of the n most frequent features in every window, 0 where it is not listed."""
    top = feature_freq(events, n).select("feature")
    windows = events.select("window_num").distinct()
    grid = windows.crossJoin(F.broadcast(top))  # n features of a top-n report
    best = events.groupBy("window_num", "feature").agg(F.min("rank").alias("rank"))
    return grid.join(best, ["window_num", "feature"], "left").fillna(0, ["rank"])


def truth_comparison(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Listed columns against truly shifted columns: outcome per column (tp, fp, fn)."""
    found = events.select("feature").distinct().withColumn("_found", F.lit(True))
    known = truth.select(F.col("column").alias("feature")).distinct().withColumn("_known", F.lit(True))
    both = F.col("_found").isNotNull() & F.col("_known").isNotNull()
    return found.join(known, "feature", "full_outer").select(
        "feature", F.when(both, "tp").when(F.col("_found").isNotNull(), "fp").otherwise("fn").alias("outcome")
    )


def truth_scores(compared: DataFrame) -> DataFrame:
    tp, fp, fn = (F.count_if(F.col("outcome") == o) for o in ("tp", "fp", "fn"))
    out = compared.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def alerts_min_level(alerts: DataFrame, level: int, n: int, order: str = "window_num") -> DataFrame:
    """The latest n alerts at or above a level."""
    return alerts.filter(F.col("level") >= level).orderBy(F.col(order).desc()).limit(n)


def histogram(df: DataFrame, cols: list[str], by: list[str], bins: int = 30) -> DataFrame:
    """Per group and feature, counts and densities over equal-width bins of the group's own range."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "feature", "value")
    long = long.filter(F.col("value").isNotNull()).groupBy(*by, "feature", "value").agg(F.count("*").alias("_n"))
    span = long.groupBy(*by, "feature").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.sum("_n").alias("_total")
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    slot = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    joined = long.join(span, [*by, "feature"])
    out = joined.groupBy(*by, "feature", slot.cast("int").alias("bin")).agg(
        F.sum("_n").alias("n"), F.first(width).alias("_w"), F.first("_total").alias("_t")
    )
    return out.select(
        *by, "feature", "bin", "n", F.when(F.col("_w") > 0, F.col("n") / (F.col("_t") * F.col("_w"))).alias("density")
    )


def score_histogram(df: DataFrame, keys: list[str], score: str, bins: int = 50) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate by name; a column missing from one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flag_union(index: DataFrame, ks: DataFrame, psi: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Distinct features among the top n of the index, the KS flags and the PSI flags."""
    from pyspark.sql import Window

    def best(df, score):
        order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "feature")  # rows are features
        return df.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= n).select(*keys, "feature")

    parts = [best(index, "sadi"), best(ks.filter("flagged"), "statistic"), best(psi.filter("flagged"), "psi")]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def model_metrics(metrics: DataFrame) -> DataFrame:
    """(model, metrics map) flattened to one row per model and metric, 4 digits."""
    return metrics.select("model", F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 4))

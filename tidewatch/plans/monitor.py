"""The two composite jobs: all windows of a stream, and all batches of an upload table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import by_shuffle, materialize, materialize_all
from tidewatch.operators import attribution as A
from tidewatch.operators import divergence as D
from tidewatch.operators import drift_index as I
from tidewatch.operators.alerts import severity
from tidewatch.operators.controller import ACTIONS, intervention_level
from tidewatch.operators.fairness import age_group, binary_parity, fairness
from tidewatch.operators.quality import average_precision, estimate_from_distance
from tidewatch.operators.reports import flag_union
from tidewatch.operators.windows import window_phase
from tidewatch.plans import model as M
from tidewatch.plans.tables import to_long

FINGERPRINT = {"weight": M.WEIGHT, "center": M.CENTER, "scale": M.SCALE}


def attributions(df: DataFrame, keys: list[str], linear: dict = FINGERPRINT) -> DataFrame:
    return A.linear_attributions(df, keys, M.FEATURES, **linear)


def components(
    reference: DataFrame, rows: DataFrame, keys: list[str], linear: dict = FINGERPRINT, cut: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Index components of every window against the reference rows; ``linear`` is the explained model.

    ``rows`` are window rows, or, with ``cut``, stream rows (``row_idx``, features) that ``cut`` makes into window rows:
    they are then explained before the windows multiply them. The size of a window is bounded.
    """
    made = materialize_all(
        rows.sparkSession,
        {
            "explained-reference": lambda: A.wide_attributions(reference, [], M.FEATURES, **linear),
            "explained": lambda: A.wide_attributions(rows, ["row_idx"] if cut else keys, M.FEATURES, **linear),
        },
    )
    wide = cut(made["explained"]) if cut else made["explained"]
    ref, cur = (df.select(*k, *M.FEATURES).unpivot(k, M.FEATURES, "feature", "phi") for df, k in ((made["explained-reference"], []), (wide, keys)))
    kl = D.kl_windows(wide, ref.withColumnRenamed("phi", "value"), keys, M.FEATURES)
    return I.index_components(A.fingerprint(ref), A.fingerprint(cur, keys), kl, keys)


def components_previous(windowed: DataFrame, window: str) -> DataFrame:
    """Index components of every window against the window before it (``window`` less 1)."""
    cur = attributions(windowed, [window])
    fp = materialize(A.fingerprint(cur, [window]), "fingerprints")  # one row per window and feature
    before = fp.withColumn(window, F.col(window) + 1)
    return I.index_components(before, fp, D.kl_previous(cur.withColumnRenamed("phi", "value"), window), [window], [window])


def window_results(
    reference: DataFrame,
    windowed: DataFrame,
    profile: DataFrame,
    comps: DataFrame,
    adversarial: DataFrame | None = None,
    bounded: bool = True,
    flag_order: str = "score",
) -> DataFrame:
    """One row per window with every score, flag and decision, for all windows in one job.

    ``adversarial`` is an optional (window_id, adv_score) table; without it the neutral 0.5 is used. ``flag_order``
    lists the first five flagged features by ``score`` or by ``column``.
    """
    keys = ["window_id"]
    feats = to_long(windowed, keys, M.FEATURES)
    # one small row per window and feature; written because each table is used more than once below
    made = materialize_all(
        windowed.sparkSession,
        {
            "ks": lambda: D.ks_test(feats, profile, keys, bounded=bounded),
            "psi": lambda: D.psi_both(D.psi_cells(feats, profile, keys), keys),
            "w1": lambda: D.wasserstein(to_long(windowed, keys, ["p"]), profile, keys, bounded=bounded),
        },
    )
    ks, psi, w1 = made["ks"], made["psi"], made["w1"]
    scores = I.sadi(comps)
    total = I.d_total(scores, psi.select(*keys, "feature", F.col("psi_index").alias("psi")), w1, keys)
    base = average_precision(reference, [], "p", "y", min_rows=10).select(F.col("auprc").alias("baseline_auprc"))
    fair = fairness(
        windowed.withColumn("_age", age_group(F.col("age"))), keys, "_age", (F.col("p") >= 0.5).cast("int"), "y"
    ).drop("n_groups")
    sizes = windowed.groupBy("window_id").agg(F.count("*").alias("n_samples"))

    def flagged(df, score, name):
        if flag_order == "column":
            return A.first_features(df.filter("flagged"), M.FEATURES, 5, keys, name)
        return A.top_features(df.filter("flagged"), score, 5, keys, name)

    out = (
        sizes.join(by_shuffle(window_phase(windowed)), "window_id")
        .join(by_shuffle(total), "window_id")
        .join(by_shuffle(fair), "window_id")
        .join(by_shuffle(A.top_features(scores, "sadi", 5, keys, "top_sadi_features")), "window_id", "left")
        .join(by_shuffle(flagged(ks, "statistic", "ks_flagged_features")), "window_id", "left")
        .join(by_shuffle(flagged(psi, "psi", "psi_flagged_features")), "window_id", "left")
        .crossJoin(F.broadcast(base))  # one row
    )
    if adversarial is None:
        out = out.withColumn("adv_score", F.lit(0.5))
    else:
        out = out.join(by_shuffle(adversarial), "window_id", "left").withColumn("adv_score", F.coalesce("adv_score", F.lit(0.5)))
    est = estimate_from_distance(F.col("d_confidence"), F.col("baseline_auprc"))["est_auprc"]
    out = out.withColumn("est_auprc", est).withColumn("risk_score", I.risk(F.col("baseline_auprc"), F.col("est_auprc")))
    level = intervention_level(F.col("d_total"), F.col("risk_score"))
    out = out.withColumn("intervention_level", level)
    none = F.array().cast("array<string>")
    rounded = {
        "D_total": "d_total",
        "D_shap": "d_shap",
        "adv_score": "adv_score",
    }
    return out.select(
        F.col("window_id").alias("window_idx"),
        F.col("window_id").alias("window_num"),
        "true_phase",
        *[F.round(c, 6).alias(n) for n, c in rounded.items()],
        F.round(I.belief(F.col("d_total"), F.col("adv_score")), 6).alias("drift_belief"),
        F.round("risk_score", 6).alias("risk_score"),
        F.round("est_auprc", 6).alias("est_auprc"),
        F.round("baseline_auprc", 6).alias("baseline_auprc"),
        "intervention_level",
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("intervention_level") + 1).alias("intervention_action"),
        F.coalesce("top_sadi_features", none).alias("top_sadi_features"),
        F.col("ks_flagged_features").isNotNull().alias("ks_detected"),
        F.col("psi_flagged_features").isNotNull().alias("psi_detected"),
        F.coalesce("ks_flagged_features", none).alias("ks_flagged_features"),
        F.coalesce("psi_flagged_features", none).alias("psi_flagged_features"),
        "dpd",
        "eod",
        "n_samples",
    )


def batch_report(reference: DataFrame, batches: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """One report row per uploaded batch, all batches in one job; batch sizes are not bounded."""
    feats = to_long(batches, keys, M.FEATURES)
    fp_ref, fp_cur = A.fingerprint(attributions(reference, [])), A.fingerprint(attributions(batches, keys), keys)
    # small tables, one row per batch and feature, each used more than once below
    made = materialize_all(
        batches.sparkSession,
        {
            "ks": lambda: D.ks_test(feats, profile, keys),
            "psi": lambda: D.psi(feats, profile, keys, variant="additive", min_rows=6),
            "w1": lambda: D.wasserstein(to_long(batches, keys, ["p"]), profile, keys),
            "index": lambda: I.sadi_batch(fp_ref, fp_cur, keys),
        },
    )
    ks, psi, w1, scores = made["ks"], made["psi"], made["w1"], made["index"]
    share = D.ks_share(ks, keys)
    total = I.d_total_batch(scores, share, w1, keys)
    dpd = binary_parity(batches, keys, "gender", (F.col("p") >= 0.42).cast("int"))
    head = batches.groupBy(*keys).agg(F.count("*").alias("n_entities"), F.avg("p").alias("mean_pred"))
    ref_mean = reference.agg(F.avg("p").alias("ref_mean_pred"))
    flags = flag_union(scores, ks, psi, keys).groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("flagged_features")  # at most all features
    )
    ks_n = ks.groupBy(*keys).agg(F.count_if("flagged").alias("ks_n_flagged"))
    psi_n = psi.groupBy(*keys).agg(F.count_if("flagged").alias("psi_n_flagged"), F.avg("psi").alias("d_feature_raw_psi"))
    out = head
    for part in (ks_n, psi_n, total, dpd, flags):
        out = out.join(part, keys, "left")
    return out.crossJoin(F.broadcast(ref_mean)).select(  # one row
        *keys,
        "n_entities",
        F.lit(len(M.FEATURES)).alias("n_features"),
        "ks_n_flagged",
        "psi_n_flagged",
        *[
            F.round(c, 6).alias(c)
            for c in ("d_feature_raw_psi", "mean_pred", "ref_mean_pred", "d_shap", "d_feature", "d_confidence", "d_total", "dpd")
        ],
        severity(F.col("d_total"), "batch").alias("severity"),
        F.coalesce("flagged_features", F.lit("")).alias("flagged_features"),
    )

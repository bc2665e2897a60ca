"""Registered queries: name -> Spark plan over the given tables, and the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.runtime import by_shuffle, materialize, scratch_dir, stage
from tidewatch.operators import adversarial as AD
from tidewatch.operators import adwin as AW
from tidewatch.operators import alerts as AL
from tidewatch.operators import attribution as A
from tidewatch.operators import cleaning as C
from tidewatch.operators import cohort as CO
from tidewatch.operators import controller as CT
from tidewatch.operators import divergence as D
from tidewatch.operators import drift_index as I
from tidewatch.operators import evaluation as E
from tidewatch.operators import fairness as FR
from tidewatch.operators import impute as IM
from tidewatch.operators import modeling as ML
from tidewatch.operators import quality as Q
from tidewatch.operators import reports as R
from tidewatch.operators import tree_attribution as TA
from tidewatch.operators import windows as W
from tidewatch.plans import fitted as FM
from tidewatch.plans import model as M
from tidewatch.plans import monitor
from tidewatch.plans import oracles as O
from tidewatch.plans import tables as T
from tidewatch.sources import bundles as B
from tidewatch.sources import readings as SR
from tidewatch.streaming import monitor as SM
from tidewatch.streaming import stateful as SS
from tidewatch.streaming import windows as SW
from tidewatch.streaming.runner import END_OF_STREAM, file_stream, run_closed, run_to_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W_KEY = ["window_id"]
FEATS = M.FEATURES


def query(name: str, oracle: str | None = None, instead: dict[str, str] | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = O.sql(oracle, instead)
        return fn

    return register


def r6(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def rs(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


# ---- stage tables shared by the queries -------------------------------------------------------------


def profile(s: SparkSession, sf: str) -> DataFrame:
    return stage(s, ("profile", sf), lambda: D.distribution_profile(T.to_long(T.reference_rows(s, sf), [], FEATS + ["p"])))


def window_long(s, sf, feats=FEATS) -> DataFrame:
    return T.to_long(T.window_rows(s, sf), W_KEY, feats)


def index_parts(s, sf) -> DataFrame:
    return stage(s, ("components", sf), lambda: monitor.components(T.reference_rows(s, sf), T.scored_stream(s, sf), W_KEY, cut=T.cut_windows))


def split_rows(s, sf) -> DataFrame:
    return stage(s, ("split", sf), lambda: ML.stratified_split(T.reference_rows(s, sf), "y", "row_idx"))


def held_out(s, sf) -> DataFrame:
    return split_rows(s, sf).filter("split = 'val'")


def reference_fit(s, sf) -> DataFrame:
    """What the domain classifiers see of the reference."""
    return held_out(s, sf).select("row_idx", *FEATS)


def domain_scores(s, sf) -> DataFrame:
    """Every window told apart from the held-out reference rows, over all features."""
    return stage(s, ("domain", sf), lambda: AD.adversarial_scores(held_out(s, sf), T.window_rows(s, sf), "window_id", "row_idx", FEATS, 3))


def results(s, sf) -> DataFrame:
    return stage(
        s,
        ("results", sf),
        lambda: monitor.window_results(T.reference_rows(s, sf), T.window_rows(s, sf), profile(s, sf), index_parts(s, sf), domain_scores(s, sf).select("window_id", "adv_score")),
    )


def batches(s, sf) -> DataFrame:
    return T.scored_stream(s, sf).filter("phase <> 'phase1'").withColumn("batch_id", F.col("prio"))


def batch_long(s, sf, feats=FEATS) -> DataFrame:
    return T.to_long(batches(s, sf), ["batch_id"], feats)


# ---- projections, filters, cleaning -----------------------------------------------------------------


@query("align_columns", f"SELECT entity_id, {', '.join(FEATS)}, NULL::DOUBLE AS absent_feature FROM cohort")
def align_columns(s, sf):
    return C.align_columns(T.cohort(s, sf), FEATS + ["absent_feature"], ["entity_id"])


_RATIO = "CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE WHEN l_tax = 0 THEN 'NaN'::DOUBLE ELSE l_tax / l_discount END"


@query(
    "sanitize",
    f"""SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END), 4) AS total,
    (count(*) FILTER (isnan(v) OR isinf(v)))::BIGINT AS replaced FROM (SELECT l_returnflag, {_RATIO} AS v FROM lineitem) GROUP BY 1""",
)
def sanitize(s, sf):
    v = (
        F.when(F.col("l_discount") == 0, F.lit(float("inf")))
        .when(F.col("l_tax") == 0, F.lit(float("nan")))
        .otherwise(F.try_divide("l_tax", "l_discount"))
    )
    rows = T.table(s, sf, "lineitem").select("l_returnflag", v.alias("v")).withColumn("raw", F.col("v"))
    clean = C.sanitize(rows, ["v"])
    return clean.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"),
        F.count_if(C.finite(F.col("raw")).isNull()).alias("replaced"),
    )


_READ = ["event_id", "user_id", "ts", "hour", *M.READING_KINDS, "label", "value"]


@query(
    "missingness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::INTEGER), 6) AS missing_frac, "
        f"(avg(({c} IS NULL)::INTEGER) > 0.6 {'AND false' if c == 'label' else ''}) AS dropped FROM readings"
        for c in _READ
    ),
)
def missingness(s, sf):
    return r6(C.missingness(T.readings(s, sf)), "missing_frac")


_FF = ", ".join(f"last_value({k} IGNORE NULLS) OVER w AS {k}" for k in M.READING_KINDS)


@query(
    "ffill",
    f"SELECT event_id, user_id, hour, {_FF} FROM readings "
    "WINDOW w AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def ffill(s, sf):
    rows = T.readings(s, sf).select("event_id", "user_id", "hour", *M.READING_KINDS)
    return C.forward_fill(rows, M.READING_KINDS, "user_id", "hour")


@query(
    "median_fill",
    "SELECT entity_id, " + ", ".join(f"round(coalesce({f}, m_{f}), 6) AS {f}" for f in FEATS) + " FROM cohort CROSS JOIN meds",
)
def median_fill(s, sf):
    c = T.cohort(s, sf)
    return r6(C.median_fill(c, c.filter("phase = 'phase1'"), FEATS).select("entity_id", *FEATS), *FEATS)


_Z = ", ".join(
    f"round((coalesce({f}, 0) - avg(coalesce({f}, 0)) FILTER (phase = 'phase1') OVER ()) / "
    f"stddev_pop(coalesce({f}, 0)) FILTER (phase = 'phase1') OVER (), 6) AS {f}"
    for f in FEATS
)


@query("zscore", f"SELECT entity_id, phase, {_Z} FROM cohort")
def zscore(s, sf):
    c = T.cohort(s, sf)
    scaler = C.fit_scaler(c.filter("phase = 'phase1'"), FEATS)
    return r6(C.scale(c.select("entity_id", "phase", *FEATS), FEATS, scaler), *FEATS)


_PF = ["click", "purchase", "error", "signup", "view"]
_LOCF = ", ".join(f"last_value({k} IGNORE NULLS) OVER w AS {k}" for k in _PF)
_PZ = ", ".join(
    f"round((coalesce({f}, 0) - avg(coalesce({f}, 0)) FILTER (early) OVER ()) / "
    f"stddev_pop(coalesce({f}, 0)) FILTER (early) OVER (), 6) AS {f}"
    for f in _PF
)


@query(
    "preprocess",
    f"SELECT event_id, {_PZ} FROM (SELECT *, hour <= 20 AS early FROM (SELECT event_id, user_id, hour, {_LOCF} FROM readings "
    "WINDOW w AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))",
)
def preprocess(s, sf):
    rows = T.readings(s, sf).select("event_id", "user_id", "hour", *_PF)
    out, meta = C.preprocess(
        rows, F.col("hour") <= 20, entity="user_id", hour="hour", protected=("event_id", *C.PROTECTED)
    )
    return r6(out.select("event_id", *meta["feature_cols"]), *_PF)


@query("shift_spec", f"SELECT row_idx, phase, {', '.join(FEATS)}, y FROM moved")
def shift_spec(s, sf):
    moved = C.apply_shift_spec(T.cohort(s, sf), M.SHIFTS, FEATS, label="y", flip=M.FLIP)
    return moved.select("row_idx", "phase", *FEATS, "y")


# ---- roll-ups and profiles --------------------------------------------------------------------------

_ES = ", ".join(
    f"round(avg({k}), 6) AS {k}_mean, round(stddev_samp({k}), 6) AS {k}_std, min({k}) AS {k}_min, max({k}) AS {k}_max"
    for k in M.READING_KINDS
)


@query(
    "entity_stats",
    f"""SELECT user_id, {_ES}, max(label)::INTEGER AS label, arg_min(click, hour) FILTER (click IS NOT NULL) AS click,
    max(hour)::BIGINT AS hour FROM readings GROUP BY user_id""",
)
def entity_stats(s, sf):
    out = CO.entity_stats(T.readings(s, sf), M.READING_KINDS, "user_id", "hour", "label", ["click"], "hour")
    return r6(out, *[f"{k}_{x}" for k in M.READING_KINDS for x in ("mean", "std")])


@query(
    "cohort_profile",
    "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_entities, round(avg(label), 6) AS prevalence FROM readings",
)
def cohort_profile(s, sf):
    return r6(CO.cohort_profile(T.readings(s, sf), "user_id", "label"), "prevalence")


@query(
    "class_balance",
    f"""SELECT phase, (count(*) FILTER (y = 0))::BIGINT AS n_negative, (count(*) FILTER (y = 1))::BIGINT AS n_positive,
    round(count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, 6) AS neg_pos_ratio,
    round(avg(y), 6) AS prevalence FROM stream GROUP BY 1""",
)
def class_balance(s, sf):
    return r6(CO.class_balance(T.scored_stream(s, sf), "y", ["phase"]), "neg_pos_ratio", "prevalence")


# ---- phases and windows -----------------------------------------------------------------------------


@query("phase_split", "SELECT entity_id, row_idx, phase FROM cohort")
def phase_split(s, sf):
    rows = T.order_rows(s, sf).select("entity_id", "arrival")
    return W.phase_split(rows, ["arrival", "entity_id"]).drop("arrival")


@query(
    "phase_label",
    f"SELECT window_id, {O.phase_sql('window_id', 'total')} AS phase FROM "
    "(SELECT window_id, count(*) OVER () AS total FROM (SELECT DISTINCT window_id FROM win))",
)
def phase_label(s, sf):
    from tidewatch.functions.columns import phase_of

    ids = T.window_rows(s, sf).select("window_id").distinct()
    total = ids.agg(F.count("*").alias("_total"))
    return ids.crossJoin(F.broadcast(total)).select(  # one row
        "window_id", phase_of(F.col("window_id"), F.col("_total")).alias("phase")
    )


@query(
    "count_windows",
    f"""SELECT window_id, count(*) AS n_samples, count(*) < {M.WINDOW_SIZE} AS is_partial, min(row_idx) AS first_row,
    max(row_idx) AS last_row FROM win GROUP BY 1""",
)
def count_windows(s, sf):
    w = T.window_rows(s, sf)
    ends = w.groupBy("window_id").agg(F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))
    return W.window_sizes(w, M.WINDOW_SIZE).join(ends, "window_id")


@query("window_phase", "SELECT window_id, true_phase FROM w_phase")
def window_phase(s, sf):
    return W.window_phase(T.window_rows(s, sf))


def _obs_sql() -> str:
    stats = ", ".join(
        f"round(avg({k}) OVER o, 6) AS {k}_mean, round(coalesce(stddev_samp({k}) OVER o, 0), 6) AS {k}_std, "
        f"min({k}) OVER o AS {k}_min, max({k}) OVER o AS {k}_max"
        for k in ("click", "view")
    )
    keep = ", ".join(f"{k}_{x}" for k in ("click", "view") for x in ("mean", "std", "min", "max"))
    return f"""SELECT user_id, row_number() OVER (ORDER BY user_id, hour) - 1 AS window_id, {keep}, label FROM (
      SELECT user_id, hour, count(*) OVER (PARTITION BY user_id) AS n, {stats},
        CASE WHEN count(*) OVER (PARTITION BY user_id) < 6 THEN max(label) OVER o
             ELSE coalesce(max(label) OVER a, 0) END::INTEGER AS label
      FROM readings WINDOW o AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING),
        a AS (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 6 FOLLOWING AND 9 FOLLOWING))
    WHERE hour <= greatest(n - 5, 1)"""


@query("obs_windows", _obs_sql())
def obs_windows(s, sf):
    rows = T.readings(s, sf).select("user_id", "hour", "click", "view", "label")
    out = W.observation_windows(rows, ["click", "view"], "user_id", "hour", "label")
    return r6(out, "click_mean", "click_std", "view_mean", "view_std")


def _obs_hours_sql() -> str:
    stats = ", ".join(
        f"round(avg({k}) OVER o, 6) AS {k}_mean, round(coalesce(stddev_samp({k}) OVER o, 0), 6) AS {k}_std, min({k}) OVER o AS {k}_min, max({k}) OVER o AS {k}_max"
        for k in ("click", "view")
    )
    keep = ", ".join(f"{k}_{x}" for k in ("click", "view") for x in ("mean", "std", "min", "max"))
    return f"""SELECT user_id, hour AS start_hour, row_number() OVER (ORDER BY user_id, hour) - 1 AS window_id, {keep}, label FROM (
      SELECT DISTINCT user_id, hour, min(hour) OVER u AS lo, max(hour) OVER u AS hi, {stats},
        CASE WHEN max(hour) OVER u - min(hour) OVER u + 1 < 24 THEN max(label) OVER o ELSE coalesce(max(label) OVER a, 0) END::INTEGER AS label
      FROM (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS hour, click, "view", label FROM readings)
      WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING),
        a AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN 24 FOLLOWING AND 35 FOLLOWING))
    WHERE hour <= greatest(hi - 23, lo)"""


@query("obs_windows_hours", _obs_hours_sql())
def obs_windows_hours(s, sf):
    """A day of readings and the half day after it; users are seen a few times a day, so rows and hours differ."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour")
    rows = T.readings(s, sf).select("user_id", hour, "click", "view", "label")
    out = W.observation_windows_by_hour(rows, ["click", "view"], "user_id", "hour", "label", 24, 12)
    return r6(out, "click_mean", "click_std", "view_mean", "view_std")


@query(
    "phase_union",
    """SELECT row_idx, phase, n_lines, total_price FROM cohort WHERE phase = 'phase1'
    UNION ALL SELECT row_idx, phase, n_lines, NULL FROM cohort WHERE phase = 'phase2'
    UNION ALL SELECT row_idx, phase, NULL, total_price FROM cohort WHERE phase = 'phase3'""",
)
def phase_union(s, sf):
    c = T.cohort(s, sf).select("row_idx", "phase", "n_lines", "total_price")
    parts = [c.filter(f"phase = 'phase{i}'") for i in (1, 2, 3)]
    return R.union_all([parts[0], parts[1].drop("total_price"), parts[2].drop("n_lines")])


# ---- distribution drift -----------------------------------------------------------------------------


@query(
    "ks_test",
    "SELECT window_id, feature, n_ref, n_cur, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, "
    "p_value < 0.05 AS flagged FROM ks",
)
def ks_test(s, sf):
    out = D.ks_test(window_long(s, sf), profile(s, sf), W_KEY, bounded=True)
    return r6(out.drop("status"), "statistic", "p_value")


@query(
    "ks_single",
    "SELECT window_id, round(statistic, 6) AS statistic, p_value < 0.05 AS drift FROM ks_all WHERE feature = 'p'",
)
def ks_single(s, sf):
    out = D.ks_test(window_long(s, sf, ["p"]), profile(s, sf), W_KEY, bounded=True)
    return out.select("window_id", F.round("statistic", 6).alias("statistic"), F.col("flagged").alias("drift"))


@query(
    "ks_share",
    """SELECT batch_id, count(*) AS n_features, (count(*) FILTER (statistic > 0.3))::BIGINT AS n_high,
    (count(*) FILTER (p_value < 0.05 / 8))::BIGINT AS n_significant, round(avg((statistic > 0.3)::INTEGER), 6) AS share_high,
    round(avg((p_value < 0.05 / 8)::INTEGER), 6) AS share_significant FROM batch_ks GROUP BY 1""",
)
def ks_share(s, sf):
    out = D.ks_share(D.ks_test(batch_long(s, sf), profile(s, sf), ["batch_id"]), ["batch_id"])
    return r6(out, "share_high", "share_significant")


@query(
    "psi",
    "SELECT window_id, feature, round(d.psi, 6) AS psi, round(i.psi, 6) AS psi_index, d.psi > 0.2 AS flagged "
    "FROM psi_detector d JOIN psi_index i USING (window_id, feature)",
)
def psi(s, sf):
    cells = materialize(D.psi_cells(window_long(s, sf), profile(s, sf), W_KEY), "psi")
    return r6(D.psi_both(cells, W_KEY).drop("status"), "psi", "psi_index")


@query(
    "psi_upload",
    "SELECT batch_id, feature, round(psi, 6) AS psi, psi > 0.2 AS flagged, CASE WHEN psi > 0.25 THEN 'major' "
    "WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END AS status FROM batch_psi",
)
def psi_upload(s, sf):
    out = D.psi(batch_long(s, sf), profile(s, sf), ["batch_id"], variant="additive", min_rows=6)
    return r6(out.withColumn("status", D.psi_status(F.col("psi"))), "psi")


_ENTRY_SQL = (
    "SELECT window_id, round(avg(psi), 6) AS mean_psi, "
    + O.ladder_sql("avg(psi)", *AL.LADDERS["alert"])
    + " AS severity FROM psi_detector GROUP BY 1"
)


@query("psi_severity", _ENTRY_SQL)
def psi_severity(s, sf):
    """Which windows of orders moved away from the reference, and how badly."""
    scored = D.psi(window_long(s, sf), profile(s, sf), W_KEY)
    mean = scored.groupBy("window_id").agg(F.avg("psi").alias("mean_psi"))
    return r6(mean.withColumn("severity", AL.severity(F.col("mean_psi"))), "mean_psi")


_FIXED = f"""
SELECT window_id, feature, round(sum((c - r) * ln(c / r)), 6) AS psi FROM (
 SELECT window_id, feature, bin, (sum(b) + 1e-6::DOUBLE) / (sum(sum(b)) OVER p + 1e-5::DOUBLE) AS c,
        (sum(a) + 1e-6::DOUBLE) / (sum(sum(a)) OVER p + 1e-5::DOUBLE) AS r FROM (
  SELECT window_id, feature, {' + '.join(f'(value >= lo + {O.lit(k)} * ((hi - lo) / {O.lit(10)}))::INTEGER' for k in range(1, 10))} AS bin, a, b
  FROM (SELECT w.window_id, w.feature, w.value, 0 AS a, 1 AS b FROM win_long w
        UNION ALL SELECT k.window_id, r.feature, r.value, 1, 0 FROM ref_long r, (SELECT DISTINCT window_id FROM win) k) u
  JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM ref_long GROUP BY 1) USING (feature)
  UNION ALL SELECT window_id, feature, bin, 0, 0 FROM (SELECT DISTINCT window_id, feature FROM win_long), range(0, 10) g(bin))
 GROUP BY window_id, feature, bin WINDOW p AS (PARTITION BY window_id, feature)) WHERE feature <> 'p' GROUP BY 1, 2"""


@query("psi_fixed_edges", _FIXED)
def psi_fixed_edges(s, sf):
    out = D.psi(window_long(s, sf), profile(s, sf), W_KEY, edges="reference")
    return r6(out.select("window_id", "feature", "psi"), "psi")


@query("kl_kde", "SELECT window_id, feature, round(kl, 6) AS kl FROM kl")
def kl_kde(s, sf):
    ref = monitor.attributions(T.reference_rows(s, sf), []).withColumnRenamed("phi", "value")
    cur = A.wide_attributions(T.window_rows(s, sf), W_KEY, FEATS, **monitor.FINGERPRINT)
    return r6(D.kl_windows(cur, ref, W_KEY, FEATS), "kl")


@query("wasserstein", "SELECT window_id, feature, round(w1, 6) AS w1 FROM w1_p")
def wasserstein(s, sf):
    return r6(D.wasserstein(window_long(s, sf, ["p"]), profile(s, sf), W_KEY, bounded=True), "w1")


def _auto_sql() -> str:
    kinds = """SELECT row_idx, window_id, gender::DOUBLE AS gender, (substr(prio, 1, 1))::DOUBLE AS prio_code FROM win"""
    rkinds = """SELECT gender::DOUBLE AS gender, (substr(prio, 1, 1))::DOUBLE AS prio_code FROM ref"""
    cells = f"""
    SELECT window_id, value, sum(b) AS c, sum(a) AS r FROM (
      SELECT window_id, prio_code AS value, 1 AS b, 0 AS a FROM ({kinds})
      UNION ALL SELECT k.window_id, q.prio_code, 0, 1 FROM ({rkinds}) q, (SELECT DISTINCT window_id FROM win) k) GROUP BY ALL"""
    chi = f"""
    SELECT window_id, sum(pow(r - (r + c) * nr / (nr + nc), 2) / ((r + c) * nr / (nr + nc)) + pow(c - (r + c) * nc / (nr + nc), 2) / ((r + c) * nc / (nr + nc))) AS x,
           (count(*) - 1)::DOUBLE AS df FROM (SELECT window_id, value, r::DOUBLE AS r, c::DOUBLE AS c,
              sum(r::DOUBLE) OVER p AS nr, sum(c::DOUBLE) OVER p AS nc FROM ({cells}) WINDOW p AS (PARTITION BY window_id)) GROUP BY 1"""
    wh = "((pow(x / df, 1.0::DOUBLE / 3) - (1 - 2.0::DOUBLE / (9 * df))) / sqrt(2.0::DOUBLE / (9 * df)))"
    chip = f"CASE WHEN {wh} >= 0 THEN {O.two_sided(wh)} / 2 ELSE 1 - {O.two_sided(wh)} / 2 END"
    z = "(CASE WHEN se > 0 THEN (c1 / nc - r1 / nr) / se ELSE 0.0 END)"
    zt = f"""
    SELECT *, sqrt(((r1 + c1) / (nr + nc)) * (1 - (r1 + c1) / (nr + nc)) * (1 / nr + 1 / nc)) AS se FROM (
      SELECT window_id, sum(gender)::DOUBLE AS c1, count(*)::DOUBLE AS nc FROM ({kinds}) GROUP BY 1)
      CROSS JOIN (SELECT sum(gender)::DOUBLE AS r1, count(*)::DOUBLE AS nr FROM ({rkinds}))"""
    return f"""
    SELECT window_id, feature, 'ks' AS test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS flagged
    FROM ks_all WHERE feature = 'p'
    UNION ALL SELECT window_id, 'prio_code', 'chi2', round(x, 6), round(pv, 6), pv < 0.05 FROM (SELECT *, {chip} AS pv FROM ({chi}))
    UNION ALL SELECT window_id, 'gender', 'z', round(abs({z}), 6), round({O.two_sided(z)}, 6), {O.two_sided(z)} < 0.05 FROM ({zt})"""


@query("auto_drift", _auto_sql())
def auto_drift(s, sf):
    cols = ["p", "gender", "prio_code"]

    def long(df, keys):
        return T.to_long(
            df.withColumn("gender", F.col("gender").cast("double")).withColumn(
                "prio_code", F.substring("prio", 1, 1).cast("double")
            ),
            keys,
            cols,
        )

    prof = stage(s, ("auto_profile", sf), lambda: D.distribution_profile(long(T.reference_rows(s, sf), [])))
    out = D.auto_drift(long(T.window_rows(s, sf), W_KEY), prof, W_KEY, bounded=True)
    return r6(out, "statistic", "p_value")


def prediction_cuts(s, sf) -> DataFrame:
    """The adaptive window along all predictions in their order."""
    rows = T.scored_stream(s, sf).select("row_idx", "p")
    return stage(s, ("prediction-cuts", sf), lambda: AW.adwin(rows, [], ["row_idx"], "p", grain=O.PRED_GRAIN))


@query(
    "detector_summary",
    f"""SELECT *, bool_or(drift_detected) OVER (PARTITION BY window_id) AS any_drift FROM (
      SELECT window_id, method, count(*) FILTER (hit) > 0 AS drift_detected, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (hit), '') AS flagged_features FROM (
        SELECT window_id, feature, 'ks' AS method, p_value < 0.05 AS hit FROM ks
        UNION ALL SELECT window_id, feature, 'psi', psi > 0.2 FROM psi_detector) GROUP BY 1, 2
      UNION ALL SELECT window_id, 'adwin', coalesce(bool_or(last_position - 1 >= window_id * {M.WINDOW_STEP} AND last_position - 1 < window_id * {M.WINDOW_STEP} + {M.WINDOW_SIZE}), false), ''
      FROM (SELECT DISTINCT window_id FROM win) LEFT JOIN (SELECT last_position FROM pred_adwin WHERE drift) ON true GROUP BY window_id)""",
)
def detector_summary(s, sf):
    feats = window_long(s, sf)
    ks = D.ks_test(feats, profile(s, sf), W_KEY, bounded=True)
    # the windows that hold the place of each cut
    cuts = prediction_cuts(s, sf).filter("drift").select((F.col("last_position") - 1).alias("row_idx"))
    fired = W.count_windows(cuts, M.WINDOW_SIZE, M.WINDOW_STEP)
    tables = {"ks": ks, "psi": D.psi(feats, profile(s, sf), W_KEY)}
    out = materialize(D.detector_summary(tables, W_KEY, {"adwin": fired}), "summary")
    whole = D.any_drift(out, W_KEY).select("window_id", F.col("any_drift_detected").alias("any_drift"))
    return out.withColumn("flagged_features", F.array_join("flagged_features", ",")).join(whole, "window_id")


# ---- attribution and composite index ----------------------------------------------------------------


@query("attributions", "SELECT row_idx, feature, round(phi, 6) AS phi FROM (" + O.phi_long("stream", "row_idx") + ")")
def attributions(s, sf):
    return r6(monitor.attributions(T.scored_stream(s, sf), ["row_idx"]), "phi")


@query("fingerprint", "SELECT window_id, feature, " + rs(["mean_abs", "mean", "std"]) + ", n, rank FROM fp_win")
def fingerprint(s, sf):
    return r6(A.fingerprint(monitor.attributions(T.window_rows(s, sf), W_KEY), W_KEY), "mean_abs", "mean", "std")


@query(
    "sadi",
    "SELECT window_id, feature, " + rs(["kl", "rank_shift", "direction_flip"]) + ", ref_rank, new_rank, round(sadi, 6) AS sadi FROM sadi",
)
def sadi(s, sf):
    parts = monitor.components(T.reference_rows(s, sf), T.scored_stream(s, sf), W_KEY, cut=T.cut_windows)
    out = I.sadi(parts).select("window_id", "feature", "kl", "rank_shift", "direction_flip", "ref_rank", "new_rank", "sadi")
    return r6(out, "kl", "rank_shift", "direction_flip", "sadi")


@query("sadi_previous", "SELECT window_id, feature, " + rs(["kl", "rank_shift", "direction_flip", "sadi"]) + " FROM sadi_previous")
def sadi_previous(s, sf):
    """The index of every window against the one before it instead of the fixed reference."""
    out = I.sadi(monitor.components_previous(T.window_rows(s, sf), "window_id"))
    return r6(out.select("window_id", "feature", "kl", "rank_shift", "direction_flip", "sadi"), "kl", "rank_shift", "direction_flip", "sadi")


@query("sadi_batch", "SELECT batch_id, feature, " + rs(["kl", "rank_shift", "direction_flip", "sadi"]) + " FROM sadi_batch")
def sadi_batch(s, sf):
    ref = A.fingerprint(monitor.attributions(T.reference_rows(s, sf), []))
    cur = A.fingerprint(monitor.attributions(batches(s, sf), ["batch_id"]), ["batch_id"])
    out = I.sadi_batch(ref, cur, ["batch_id"])
    cols = ["kl", "rank_shift", "direction_flip", "sadi"]
    return r6(out.select("batch_id", "feature", *cols), *cols)


@query(
    "top_features",
    "SELECT window_id, array_to_string(feats, ',') AS top FROM (" + O.top_list("sadi", "sadi") + ")",
)
def top_features(s, sf):
    out = A.top_features(I.sadi(index_parts(s, sf)), "sadi", 5, W_KEY, "top")
    return out.withColumn("top", F.array_join("top", ","))


@query("d_total", "SELECT window_id, " + rs(["d_shap", "d_feature", "d_confidence", "d_total"]) + " FROM d_total")
def d_total(s, sf):
    p = profile(s, sf)
    psi_scores = D.psi(window_long(s, sf), p, W_KEY, variant="index")
    w1 = D.wasserstein(window_long(s, sf, ["p"]), p, W_KEY, bounded=True)
    out = I.d_total(I.sadi(index_parts(s, sf)), psi_scores, w1, W_KEY)
    return r6(out, "d_shap", "d_feature", "d_confidence", "d_total")


_DB = f"""
SELECT batch_id, d_shap, d_feature, least(w1, 1.0) AS d_confidence,
  {O.lit(0.6)} * least(d_shap, 1.5) + {O.lit(0.15)} * d_feature + {O.lit(0.25)} * least(w1, 1.0) AS d_total
FROM (SELECT batch_id, avg(sadi) AS d_shap FROM sadi_batch WHERE ref_rank <= 10 GROUP BY 1)
JOIN (SELECT batch_id, avg((statistic > 0.3)::INTEGER) AS d_feature FROM batch_ks GROUP BY 1) USING (batch_id)
JOIN batch_w1 USING (batch_id)"""


@query("d_total_batch", "SELECT batch_id, " + rs(["d_shap", "d_feature", "d_confidence", "d_total"]) + f" FROM ({_DB})")
def d_total_batch(s, sf):
    b, p = batches(s, sf), profile(s, sf)
    ref = A.fingerprint(monitor.attributions(T.reference_rows(s, sf), []))
    scores = I.sadi_batch(ref, A.fingerprint(monitor.attributions(b, ["batch_id"]), ["batch_id"]), ["batch_id"])
    share = D.ks_share(D.ks_test(batch_long(s, sf), p, ["batch_id"]), ["batch_id"])
    w1 = D.wasserstein(batch_long(s, sf, ["p"]), p, ["batch_id"])
    return r6(I.d_total_batch(scores, share, w1, ["batch_id"]), "d_shap", "d_feature", "d_confidence", "d_total")


@query(
    "d_total_fallback",
    "SELECT batch_id, round(0.6 * avg((statistic > 0.3)::INTEGER) + 0.4 * avg((p_value < 0.05 / 8)::INTEGER), 6) AS d_total "
    "FROM batch_ks GROUP BY 1",
)
def d_total_fallback(s, sf):
    share = D.ks_share(D.ks_test(batch_long(s, sf), profile(s, sf), ["batch_id"]), ["batch_id"])
    return share.select(
        "batch_id", F.round(I.fallback_total(F.col("share_high"), F.col("share_significant")), 6).alias("d_total")
    )


_REPORT = f"""
SELECT batch_id, n_entities, 8 AS n_features, ks_n_flagged, psi_n_flagged, {rs(['d_feature_raw_psi', 'mean_pred', 'ref_mean_pred', 'd_shap', 'd_feature', 'd_confidence', 'd_total', 'dpd'])},
  {O.ladder_sql('d_total', *AL.LADDERS['batch'])} AS severity, coalesce(flagged, '') AS flagged_features
FROM ({_DB}) JOIN (SELECT batch_id, count(*) AS n_entities, avg(p) AS mean_pred,
   coalesce(abs(avg((p >= 0.42)::INTEGER) FILTER (gender = 0) - avg((p >= 0.42)::INTEGER) FILTER (gender = 1)), 0) AS dpd FROM batch GROUP BY 1) USING (batch_id)
JOIN (SELECT batch_id, (count(*) FILTER (p_value < 0.05))::BIGINT AS ks_n_flagged FROM batch_ks GROUP BY 1) USING (batch_id)
JOIN (SELECT batch_id, (count(*) FILTER (psi > 0.2))::BIGINT AS psi_n_flagged, avg(psi) AS d_feature_raw_psi FROM batch_psi GROUP BY 1) USING (batch_id)
CROSS JOIN (SELECT avg(p) AS ref_mean_pred FROM ref)
LEFT JOIN (SELECT batch_id, string_agg(feature, ',' ORDER BY feature) AS flagged FROM (
   SELECT batch_id, feature FROM sadi_batch UNION SELECT batch_id, feature FROM batch_ks WHERE p_value < 0.05
   UNION SELECT batch_id, feature FROM batch_psi WHERE psi > 0.2) GROUP BY 1) USING (batch_id)"""


@query("batch_report", _REPORT)
def batch_report(s, sf):
    return monitor.batch_report(T.reference_rows(s, sf), batches(s, sf), profile(s, sf), ["batch_id"])


@query(
    "flag_union",
    """SELECT window_id, feature FROM ks WHERE p_value < 0.05 UNION SELECT window_id, feature FROM psi_detector WHERE psi > 0.2
    UNION SELECT window_id, feature FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY sadi DESC, feature) AS rk FROM sadi) WHERE rk <= 3""",
)
def flag_union(s, sf):
    feats = window_long(s, sf)
    ks = materialize(D.ks_test(feats, profile(s, sf), W_KEY, bounded=True), "ks")
    ps = materialize(D.psi(feats, profile(s, sf), W_KEY), "psi")
    best = A.top_features(I.sadi(index_parts(s, sf)), "sadi", 3, W_KEY, "top")
    top = best.select("window_id", F.explode("top").alias("feature")).withColumn("sadi", F.lit(1.0))
    return R.flag_union(top, ks, ps, W_KEY)


@query(
    "importance_compare",
    """SELECT c.feature, c.batch_id, round(r.mean_abs, 6) AS ref_mean_abs, r.rank AS ref_rank, round(c.mean_abs, 6) AS new_mean_abs, c.rank AS new_rank
    FROM fp_batch c JOIN fp_ref r USING (feature) WHERE r.rank <= 5""",
)
def importance_compare(s, sf):
    ref = A.fingerprint(monitor.attributions(T.reference_rows(s, sf), []))
    cur = A.fingerprint(monitor.attributions(batches(s, sf), ["batch_id"]), ["batch_id"])
    return r6(A.importance_compare(ref, cur, 5, ["batch_id"]), "ref_mean_abs", "new_mean_abs")


_ARR = ["top_sadi_features", "ks_flagged_features", "psi_flagged_features"]
_RES = [
    "window_idx", "window_num", "true_phase", "D_total", "D_shap", "adv_score", "drift_belief", "risk_score", "est_auprc",
    "baseline_auprc", "intervention_level", "intervention_action", *_ARR, "ks_detected", "psi_detected", "dpd", "eod", "n_samples",
]


@query(
    "window_results",
    "SELECT " + ", ".join(f"array_to_string({c}, ',') AS {c}" if c in _ARR else c for c in _RES) + " FROM results",
)
def window_results(s, sf):
    out = results(s, sf)
    return out.select(*[F.array_join(c, ",").alias(c) if c in _ARR else F.col(c) for c in _RES])


@query(
    "ablation",
    "SELECT config, alpha, beta, gamma, " + ", ".join(
        f"round({e}, 4) AS {n}" for n, e in (
            ("precision", O.safe("tp", "tp + fp")), ("recall", O.safe("tp", "tp + fn")),
            ("f1", O.safe("2.0 * tp", "2 * tp + fp + fn")))
    ) + f""" FROM (SELECT config, alpha, beta, gamma, count(*) FILTER (fired AND true_phase <> 'phase1') AS tp,
      count(*) FILTER (fired AND true_phase = 'phase1') AS fp, count(*) FILTER (NOT fired AND true_phase <> 'phase1') AS fn
    FROM (SELECT config, alpha, beta, gamma, true_phase,
            {O.lit(0.5)} * shap + {O.lit(0.3)} * d_feature + {O.lit(0.2)} * d_confidence > 0.3 AS fired
     FROM (SELECT config, alpha, beta, gamma, window_id, avg(v) AS shap FROM (SELECT *, row_number() OVER (PARTITION BY config, window_id ORDER BY v DESC, feature) AS rk
       FROM (SELECT config, alpha, beta, gamma, window_id, feature, alpha * kl + beta * rank_shift + gamma * direction_flip AS v FROM comps,
         (VALUES """
    + ", ".join(f"('{n}', {O.lit(a)}, {O.lit(b)}, {O.lit(g)})" for a, b, g, n in I.ABLATION)
    + """) t(config, alpha, beta, gamma))) WHERE rk <= 10 GROUP BY ALL)
     JOIN d_total USING (window_id) JOIN w_phase USING (window_id)) GROUP BY ALL)""",
)
def ablation(s, sf):
    p = profile(s, sf)
    psi_scores = D.psi(window_long(s, sf), p, W_KEY, variant="index")
    w1 = D.wasserstein(window_long(s, sf, ["p"]), p, W_KEY, bounded=True)
    parts = I.d_total(I.sadi(index_parts(s, sf)), psi_scores, w1, W_KEY)
    return I.ablation(index_parts(s, sf), parts, W.window_phase(T.window_rows(s, sf)), W_KEY)


# ---- quality ----------------------------------------------------------------------------------------


def _curve(src: str, keys: str, score="p", label="y") -> str:
    return "(" + O.ap(src, keys, score, label) + ")"


@query(
    "auprc",
    f"SELECT lang, n::BIGINT AS n, round(ap, 6) AS auprc FROM (SELECT lang, max(n) AS n, "
    f"CASE WHEN max(n_pos) IN (0, max(n)) THEN 0.0 ELSE {O.AP} END AS ap FROM {_curve('docs', 'lang')} GROUP BY 1)",
)
def auprc(s, sf):
    return r6(Q.average_precision(T.scored_documents(s, sf), ["lang"], "p", "y"), "auprc")


@query("auroc", f"SELECT phase, round({O.AUROC}, 6) AS auroc FROM {_curve('stream', 'phase')} GROUP BY 1")
def auroc(s, sf):
    return r6(Q.area_under_roc(T.scored_stream(s, sf), ["phase"], "p", "y"), "auroc")


@query("brier", "SELECT phase, round(avg((y - p) * (y - p)), 6) AS brier_score FROM stream GROUP BY 1")
def brier(s, sf):
    return r6(Q.brier(T.scored_stream(s, sf), ["phase"], "p", "y"), "brier_score")


@query(
    "best_threshold",
    f"SELECT lang, arg_max(threshold, (f1, -threshold)) AS threshold, round(max(f1), 6) AS f1 FROM "
    f"(SELECT *, {O.F1} AS f1 FROM {_curve('docs', 'lang')}) GROUP BY 1",
)
def best_threshold(s, sf):
    return r6(Q.best_threshold(T.scored_documents(s, sf), ["lang"], "p", "y"), "f1")


def _report_sql(src: str, keys: str, pred: str) -> str:
    def f(tp, fp, fn):
        return O.safe(f"2.0 * {tp}", f"2 * {tp} + {fp} + {fn}")

    one = [O.safe("tp", "tp + fp"), O.safe("tp", "tp + fn"), f("tp", "fp", "fn")]
    zero = [O.safe("tn", "tn + fn"), O.safe("tn", "tn + fp"), f("tn", "fn", "fp")]
    n = "(tp + fp + fn + tn)"
    rows = [("0", *zero, "tn + fp"), ("1", *one, "tp + fn")]
    rows.append(("macro avg", *[f"(({a}) + ({b})) / 2" for a, b in zip(zero, one)], n))
    rows.append(("weighted avg", *[f"(({a}) * (tn + fp) + ({b}) * (tp + fn)) / {n}" for a, b in zip(zero, one)], n))
    rows.append(("accuracy", *[f"(tp + tn) / {n}::DOUBLE"] * 3, n))
    counts = (
        f"(SELECT {keys}, count(*) FILTER (y = 1 AND {pred}) AS tp, count(*) FILTER (y = 0 AND {pred}) AS fp, "
        f"count(*) FILTER (y = 1 AND NOT {pred}) AS fn, count(*) FILTER (y = 0 AND NOT {pred}) AS tn FROM {src} GROUP BY {keys})"
    )
    return " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, round({g}, 6) AS f1_score, "
        f"({s})::BIGINT AS support FROM {counts}"
        for c, p, r, g, s in rows
    )


@query("class_report", _report_sql("docs", "lang", "p >= 0.5"))
def class_report(s, sf):
    counts = Q.confusion(T.scored_documents(s, sf), ["lang"], (F.col("p") >= 0.5).cast("int"), "y")
    return r6(Q.class_report(counts, ["lang"]), "precision", "recall", "f1_score")


@query(
    "evaluate_model",
    f"""SELECT phase, n::BIGINT AS n, n_pos::BIGINT AS n_pos, {rs(['auprc', 'auroc', 'brier_score'])}, t AS optimal_threshold,
    round(f1, 6) AS f1_at_threshold, tp::BIGINT AS tp, (pred - tp)::BIGINT AS fp, (n_pos - tp)::BIGINT AS fn, (n - pred - n_pos + tp)::BIGINT AS tn
    FROM (SELECT phase, max(n) AS n, max(n_pos) AS n_pos, {O.AP} AS auprc, {O.AUROC} AS auroc,
      sum(pos_at * (1 - threshold) * (1 - threshold) + (n_at - pos_at) * threshold * threshold) / max(n) AS brier_score,
      arg_max(threshold, (f1, -threshold)) AS t, arg_max(tp, (f1, -threshold)) AS tp, arg_max(n_pred, (f1, -threshold)) AS pred, max(f1) AS f1
    FROM (SELECT *, {O.F1} AS f1 FROM {_curve('stream', 'phase')}) GROUP BY 1)""",
)
def evaluate_model(s, sf):
    out = Q.evaluate_model(T.scored_stream(s, sf), ["phase"], "p", "y")
    return r6(out, "auprc", "auroc", "brier_score", "f1_at_threshold")


@query(
    "calibration_bins",
    """SELECT phase, least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(y), 6) AS fraction_positive,
    round(avg(p), 6) AS mean_predicted FROM stream GROUP BY ALL""",
)
def calibration_bins(s, sf):
    out = Q.calibration_bins(T.scored_stream(s, sf), ["phase"], "p", "y")
    return r6(out, "fraction_positive", "mean_predicted")


@query(
    "score_histogram", "SELECT phase, least(floor(p * 50), 49)::INTEGER AS bin, count(*) AS n FROM stream GROUP BY ALL"
)
def score_histogram(s, sf):
    return R.score_histogram(T.scored_stream(s, sf), ["phase"], "p")


_CB = f"""SELECT chunk, max(n) AS n, {O.clip(O.AP)} AS ea, {O.clip(O.AUROC)} AS er
FROM {_curve('(SELECT *, row_idx // 250 AS chunk FROM stream)', 'chunk', 'p', 'p')} GROUP BY 1"""
_CBREF = f"""SELECT coalesce(stddev_samp(ap), 0) AS sd FROM (SELECT chunk, {O.AP} AS ap FROM
{_curve("(SELECT *, row_idx // 250 AS chunk FROM ref)", 'chunk', 'p', 'y')} GROUP BY 1)"""


@query(
    "cbpe",
    f"""SELECT chunk, n::BIGINT AS n, round(ea, 6) AS estimated_auprc, round(er, 6) AS estimated_auroc,
    round({O.clip('ea - 3.0 * sd')}, 6) AS lower_bound, round({O.clip('ea + 3.0 * sd')}, 6) AS upper_bound FROM ({_CB}) CROSS JOIN ({_CBREF})""",
)
def cbpe(s, sf):
    chunked = T.scored_stream(s, sf).withColumn("chunk", F.floor(F.col("row_idx") / 250))
    ref = Q.threshold_curve(chunked.filter("phase = 'phase1'"), ["chunk"], "p", "y", bounded=True)
    ref = ref.groupBy("chunk").agg(Q.ap_expr().alias("auprc"))
    out = Q.expected_performance(chunked, "chunk", "p", ref)
    return r6(out, "estimated_auprc", "estimated_auroc", "lower_bound", "upper_bound")


_EST = O.clip("baseline_auprc * (1 - least(w1, 1.0))")


@query(
    "est_auprc",
    f"""SELECT window_id, round(w1, 6) AS wasserstein_distance, round(e, 6) AS est_auprc, round({O.clip('e - 0.05 * e')}, 6) AS lower_bound,
    round({O.clip('e + 0.05 * e')}, 6) AS upper_bound, round({O.clip('baseline_auprc - e')}, 6) AS risk_score
    FROM (SELECT *, {_EST} AS e FROM w1_p CROSS JOIN base)""",
)
def est_auprc(s, sf):
    w1 = D.wasserstein(window_long(s, sf, ["p"]), profile(s, sf), W_KEY, bounded=True)
    base = Q.average_precision(T.reference_rows(s, sf), [], "p", "y", min_rows=10).select(F.col("auprc").alias("b"))
    est = Q.estimate_from_distance(F.col("w1"), F.col("b"))
    return w1.crossJoin(F.broadcast(base)).select(  # one row
        "window_id",
        F.round("w1", 6).alias("wasserstein_distance"),
        *[F.round(c, 6).alias(n) for n, c in est.items()],
        F.round(I.risk(F.col("b"), est["est_auprc"]), 6).alias("risk_score"),
    )


@query(
    "belief",
    f"""SELECT l_returnflag, l_discount, l_tax, count(*) AS n, round(any_value((0.6 * {O.clip('l_discount * 12.0::DOUBLE')} +
    0.4 * {O.clip('((0.4::DOUBLE + l_tax * 8.0::DOUBLE) - 0.5) / 0.5')}) / 1.0), 6) AS belief FROM lineitem GROUP BY 1, 2, 3""",
)
def belief(s, sf):
    d, a = F.col("l_discount") * 12.0, F.lit(0.4) + F.col("l_tax") * 8.0
    rows = T.table(s, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax", I.belief(d, a).alias("b"))
    return rows.groupBy("l_returnflag", "l_discount", "l_tax").agg(
        F.count("*").alias("n"), F.round(F.first("b"), 6).alias("belief")
    )


@query(
    "risk",
    f"SELECT o_orderpriority, round(sum({O.clip('0.9::DOUBLE - o_totalprice / 400000.0::DOUBLE')}), 4) AS total_risk FROM orders GROUP BY 1",
)
def risk(s, sf):
    r = I.risk(F.lit(0.9), F.col("o_totalprice") / F.lit(400000.0))
    return T.table(s, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(r), 4).alias("total_risk"))


# ---- controller, evaluation -------------------------------------------------------------------------

_DEC = O.LEVEL.replace("d_total", "(l_discount * 8.0::DOUBLE)").replace("risk", "(l_tax * 1.5::DOUBLE)")


@query(
    "decide",
    f"SELECT level, {O.case_list('level', CT.ACTIONS)} AS action, {O.case_list('level', CT.MESSAGES)} AS message, count(*) AS n "
    f"FROM (SELECT {_DEC} AS level FROM lineitem) GROUP BY ALL",
)
def decide(s, sf):
    rows = T.table(s, sf, "lineitem").select(
        (F.col("l_discount") * 8.0).alias("d"), (F.col("l_tax") * 1.5).alias("r")
    )
    return CT.decide(rows, "d", "r").groupBy("level", "action", "message").agg(F.count("*").alias("n"))


def detector_flags(s, sf) -> DataFrame:
    return E.detector_flags(
        results(s, sf),
        [],
        {"index": F.col("D_total") > 0.3, "ks": F.col("ks_detected"), "psi": F.col("psi_detected")},
    )


@query(
    "detector_scores",
    f"""SELECT detector, latency, round({O.safe('tp', 'tp + fp')}, 4) AS precision, round({O.safe('tp', 'tp + fn')}, 4) AS recall,
    round({O.safe('2.0 * tp', '2 * tp + fp + fn')}, 4) AS f1 FROM (
      SELECT detector, count(*) FILTER (fired AND true_phase <> 'phase1') AS tp, count(*) FILTER (fired AND true_phase = 'phase1') AS fp,
        count(*) FILTER (NOT fired AND true_phase <> 'phase1') AS fn, min(window_num) FILTER (fired AND window_num >= st) - max(st) AS latency
      FROM flags CROSS JOIN (SELECT min(window_num) AS st FROM results WHERE true_phase = 'phase2') GROUP BY 1)""",
)
def detector_scores(s, sf):
    return E.detector_scores(detector_flags(s, sf))


def _listed(s, sf) -> DataFrame:
    r = results(s, sf).filter("true_phase = 'phase3'")
    return R.union_all(
        [
            r.select(F.lit(m).alias("method"), F.explode(c).alias("feature"))
            for m, c in (("index", "top_sadi_features"), ("ks", "ks_flagged_features"), ("psi", "psi_flagged_features"))
        ]
    )


@query(
    "attribution_accuracy",
    """SELECT method, tp, fp, fn, round(tp / (tp + fp + 1e-9::DOUBLE), 4) AS precision, round(tp / (tp + fn + 1e-9::DOUBLE), 4) AS recall FROM (
      SELECT method, count(t) AS tp, count(*) - count(t) AS fp, (SELECT count(DISTINCT col) FROM truth) - count(t) AS fn FROM (
        SELECT DISTINCT method, feature FROM (
          SELECT 'index' AS method, unnest(top_sadi_features) AS feature FROM results WHERE true_phase = 'phase3'
          UNION ALL SELECT 'ks', unnest(ks_flagged_features) FROM results WHERE true_phase = 'phase3'
          UNION ALL SELECT 'psi', unnest(psi_flagged_features) FROM results WHERE true_phase = 'phase3'))
      LEFT JOIN (SELECT DISTINCT col AS feature, 1 AS t FROM truth) USING (feature) GROUP BY 1)""",
)
def attribution_accuracy(s, sf):
    return E.attribution_accuracy(_listed(s, sf), C.drift_truth(s, M.SHIFTS, FEATS), [])


@query(
    "bootstrap_f1",
    """SELECT detector, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, round(quantile_cont(f1, 0.025), 6) AS ci_low,
    round(quantile_cont(f1, 0.975), 6) AS ci_high FROM resample GROUP BY 1""",
)
def bootstrap_f1(s, sf):
    return r6(E.bootstrap_summary(E.bootstrap_f1(detector_flags(s, sf), []), []), "f1_mean", "f1_std", "ci_low", "ci_high")


@query(
    "wilcoxon",
    f"""SELECT statistic, round(CASE WHEN m > 0 THEN {O.two_sided('z')} ELSE 1.0 END, 6) AS p_value,
    CASE WHEN m > 0 THEN {O.two_sided('z')} ELSE 1.0 END < 0.05 AS significant FROM (
     SELECT coalesce(least(wp, wm), 0.0) AS statistic, m, coalesce((least(wp, wm) - m * (m + 1) / 4) /
        nullif(sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24), 0), 0.0) AS z FROM (
      SELECT sum(r) FILTER (d > 0) + 0.0 AS wp0, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS wp, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS wm,
        count(*)::DOUBLE AS m, (SELECT coalesce(sum(c * c * c - c), 0)::DOUBLE FROM (SELECT count(*)::DOUBLE AS c FROM
          (SELECT abs(round(max(f1) FILTER (detector = 'index') - max(f1) FILTER (detector = 'ks'), 12)) AS ad FROM resample GROUP BY resample) WHERE ad <> 0 GROUP BY ad)) AS ties
      FROM (SELECT d, avg(rn) OVER (PARTITION BY abs(d)) AS r FROM (SELECT d, row_number() OVER (ORDER BY abs(d)) AS rn FROM (
        SELECT round(max(f1) FILTER (detector = 'index') - max(f1) FILTER (detector = 'ks'), 12) AS d FROM resample GROUP BY resample) WHERE d <> 0))))""",
)
def wilcoxon(s, sf):
    return r6(E.wilcoxon(E.bootstrap_f1(detector_flags(s, sf), []), "index", "ks"), "p_value")


# ---- fairness, alerts -------------------------------------------------------------------------------


@query("age_groups", f"SELECT {O.age_band('age - 10')} AS age_group, count(*) AS n FROM order_rows GROUP BY 1")
def age_groups(s, sf):
    rows = T.order_rows(s, sf).select(FR.age_group(F.col("age") - 10).alias("age_group"))
    return rows.groupBy("age_group").agg(F.count("*").alias("n"))


@query("fairness", "SELECT * FROM fair")
def fairness(s, sf):
    rows = T.window_rows(s, sf).withColumn("_g", FR.age_group(F.col("age")))
    return FR.fairness(rows, W_KEY, "_g", (F.col("p") >= 0.5).cast("int"), "y")


@query(
    "fairness_gender",
    """SELECT window_id, round(coalesce(abs(avg((p >= 0.42)::INTEGER) FILTER (gender = 0) - avg((p >= 0.42)::INTEGER) FILTER (gender = 1)), 0), 6) AS dpd
    FROM win GROUP BY 1""",
)
def fairness_gender(s, sf):
    return r6(FR.binary_parity(T.window_rows(s, sf), W_KEY, "gender", (F.col("p") >= 0.42).cast("int")), "dpd")


@query(
    "fairness_check",
    """SELECT window_id, dpd > 0.1 AS dpd_exceeded, eod > 0.1 AS eod_exceeded, concat_ws(' ',
      CASE WHEN dpd > 0.1 THEN 'Demographic Parity Difference (' || printf('%.4f', dpd) || ') exceeds threshold (0.10).' END,
      CASE WHEN eod > 0.1 THEN 'Equalized Odds Difference (' || printf('%.4f', eod) || ') exceeds threshold (0.10).' END) AS alert_message FROM fair""",
)
def fairness_check(s, sf):
    rows = T.window_rows(s, sf).withColumn("_g", FR.age_group(F.col("age")))
    out = FR.fairness(rows, W_KEY, "_g", (F.col("p") >= 0.5).cast("int"), "y")
    return out.select("window_id", *[c.alias(n) for n, c in FR.check(F.col("dpd"), F.col("eod")).items()])


@query(
    "subgroup_metrics",
    f"""SELECT source, n, round(prev, 4) AS prevalence, round({O.safe('tp', 'pred')}, 4) AS precision, round({O.safe('tp', 'pos')}, 4) AS recall,
    round({O.safe('2.0 * tp', 'pred + pos')}, 4) AS f1, round(auprc, 4) AS auprc FROM (
      SELECT source, count(*) AS n, avg(y) AS prev, sum((y = 1 AND p >= 0.5)::INTEGER) AS tp, sum((p >= 0.5)::INTEGER) AS pred, sum(y) AS pos FROM docs GROUP BY 1)
    JOIN (SELECT source, CASE WHEN max(n_pos) IN (0, max(n)) THEN 0.0 ELSE {O.AP} END AS auprc FROM {_curve('docs', 'source')} GROUP BY 1) USING (source)""",
)
def subgroup_metrics(s, sf):
    return FR.subgroup_metrics(T.scored_documents(s, sf), [], "source", (F.col("p") >= 0.5).cast("int"), "y", "p")


@query(
    "severity",
    "SELECT "
    + ", ".join(f"{O.ladder_sql('l_discount * 12.0::DOUBLE', *AL.LADDERS[k])} AS {k}_severity" for k in AL.LADDERS)
    + ", count(*) AS n FROM lineitem GROUP BY ALL",
)
def severity(s, sf):
    d = F.col("l_discount") * 12.0
    rows = T.table(s, sf, "lineitem").select(*[AL.severity(d, k).alias(f"{k}_severity") for k in AL.LADDERS])
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


_CHG = "(abs(new_mean) - abs(ref_mean)) / greatest(abs(ref_mean), 1e-10::DOUBLE)"


@query(
    "direction",
    f"""SELECT window_id, feature, CASE WHEN ref_mean <> 0 AND new_mean <> 0 AND (ref_mean > 0) <> (new_mean > 0) THEN '{DIR[0]}'
    WHEN {_CHG} > 0.2 THEN '{DIR[1]}' WHEN {_CHG} < -0.2 THEN '{DIR[2]}' ELSE '{DIR[3]}' END AS direction FROM comps"""
    if (DIR := AL.DIRECTIONS)
    else None,
)
def direction(s, sf):
    return index_parts(s, sf).select(
        "window_id", "feature", AL.direction(F.col("ref_mean"), F.col("new_mean")).alias("direction")
    )


def _rec_sql(level: str, feats: str) -> str:
    names = f"CASE WHEN len({feats}) > 0 THEN array_to_string({feats}[1:5], ', ') ELSE 'N/A' END"
    whens = []
    for i, t in enumerate(AL.RECOMMENDATIONS):
        parts = t.split("{}")
        body = f"'{parts[0]}'" if len(parts) == 1 else f"'{parts[0]}' || ({names}) || '{parts[1]}'"
        whens.append(f"WHEN {level} = {i} THEN {body}" if i < 4 else f"ELSE {body}")
    return "CASE " + " ".join(whens) + " END"


@query(
    "recommend",
    f"SELECT window_num, {_rec_sql('window_num % 5', 'top_sadi_features')} AS recommendation, "
    + ", ".join(
        f"{O.ladder_sql('D_total', AL.LADDERS[k][0], [r[i] for r in AL.REVIEW_ADVICE[k]])} AS {k}_{n}"
        for k in AL.REVIEW_ADVICE
        for i, n in ((0, "title"), (1, "priority"), (2, "next_action"))
    )
    + " FROM results",
)
def recommend(s, sf):
    d, top = F.col("D_total"), F.col("top_sadi_features")
    cols = [
        AL.advice(d, top, k)[n].alias(f"{k}_{n}") for k in AL.REVIEW_ADVICE for n in ("title", "priority", "next_action")
    ]
    rec = AL.recommendation((F.col("window_num") % 5).cast("int"), top).alias("recommendation")
    return results(s, sf).select("window_num", rec, *cols)


def alert_table(s, sf) -> DataFrame:
    return AL.build_alerts(results(s, sf), FM.top_moves(index_parts(s, sf)), ["window_num"], min_level=1)


_ALERT = f"""
SELECT window_num, true_phase, intervention_level AS level, intervention_action AS action, {O.ladder_sql('D_total', *AL.LADDERS['alert'])} AS severity,
 D_total, risk_score, round(baseline_auprc - est_auprc, 6) AS auprc_drop, round((baseline_auprc - est_auprc) / baseline_auprc * 100, 4) AS auprc_drop_pct,
 array_to_string(top_sadi_features, ',') AS top_names, {_rec_sql('intervention_level', 'top_sadi_features')} AS recommendation
FROM results WHERE intervention_level >= 1"""


@query("alerts", _ALERT)
def alerts(s, sf):
    a = alert_table(s, sf)
    names = F.array_join(F.transform("top_features", lambda t: t["feature"]), ",")
    return a.select(
        "window_num", "true_phase", "level", "action", "severity", "D_total", "risk_score",
        F.round("auprc_drop", 6).alias("auprc_drop"), F.round("auprc_drop_pct", 4).alias("auprc_drop_pct"),
        names.alias("top_names"), "recommendation",
    )


@query(
    "alerts_min_level",
    f"SELECT window_num, level, action FROM ({_ALERT}) WHERE level >= 1 ORDER BY window_num DESC LIMIT 15",
)
def alerts_min_level(s, sf):
    return R.alerts_min_level(alert_table(s, sf), 1, 15).select("window_num", "level", "action")


# ---- review queries ---------------------------------------------------------------------------------


@query(
    "results_filter",
    "SELECT window_num, true_phase, D_total FROM results WHERE window_num BETWEEN 5 AND 20 AND true_phase IN ('phase1', 'phase2')",
)
def results_filter(s, sf):
    return R.results_filter(results(s, sf), 5, 20, ["phase1", "phase2"]).select("window_num", "true_phase", "D_total")


@query(
    "phase_summary",
    """SELECT true_phase, count(*) AS windows, round(avg(D_total), 9) AS d_total_mean, round(max(D_total), 9) AS d_total_max,
    round(avg(D_shap), 9) AS d_shap_mean, round(avg(adv_score), 9) AS adv_mean, round(avg(risk_score), 9) AS risk_mean,
    round(avg(est_auprc), 9) AS est_auprc_mean, max(intervention_level) AS max_level FROM results GROUP BY 1""",
)
def phase_summary(s, sf):
    return R.phase_summary(results(s, sf), digits=9)


@query(
    "phase_fairness",
    """SELECT true_phase, round(avg(dpd), 9) AS mean_dpd, round(max(dpd), 9) AS max_dpd, round(avg(eod), 9) AS mean_eod,
    round(max(eod), 9) AS max_eod FROM results GROUP BY 1""",
)
def phase_fairness(s, sf):
    return R.phase_fairness(results(s, sf), digits=9)


@query(
    "run_kpis",
    f"""SELECT count(*) AS windows, round(avg(D_total), 6) AS mean_d_total, max(D_total) AS max_d_total, (count(*) FILTER (D_total > 0.3))::BIGINT AS over_threshold,
    round(avg(adv_score), 6) AS mean_adv, round(avg(dpd), 6) AS mean_dpd, max(dpd) AS max_dpd, round(avg(eod), 6) AS mean_eod, max(eod) AS max_eod,
    arg_max(D_total, window_num) AS latest_d_total, {O.ladder_sql('arg_max(D_total, window_num)', *AL.LADDERS['review'])} AS latest_severity,
    arg_max(intervention_level, window_num) AS latest_level, round(arg_max(baseline_auprc - est_auprc, window_num), 6) AS perf_drop FROM results""",
)
def run_kpis(s, sf):
    return r6(R.run_kpis(results(s, sf)), "mean_d_total", "mean_adv", "mean_dpd", "mean_eod", "perf_drop")


@query(
    "describe",
    " UNION ALL ".join(
        f"SELECT '{f}' AS \"column\", count({f}) AS n, round(avg({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std, min({f}) AS min, max({f}) AS max, "
        f"round(quantile_cont({f}, 0.25), 4) AS q25, round(quantile_cont({f}, 0.5), 4) AS q50, round(quantile_cont({f}, 0.75), 4) AS q75 FROM cohort"
        for f in FEATS
    ),
)
def describe(s, sf):
    return r6(R.describe(T.cohort(s, sf), FEATS), "mean", "std", "q25", "q50", "q75", digits=4)


_CORR = ["D_total", "D_shap", "adv_score", "drift_belief", "risk_score", "est_auprc"]


@query(
    "score_corr",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM results" for a in _CORR for b in _CORR
    ),
)
def score_corr(s, sf):
    return r6(R.score_corr(results(s, sf), _CORR), "corr", digits=4)


@query(
    "level_counts",
    """SELECT 'level' AS what, intervention_level::VARCHAR AS item, count(*) AS n FROM results GROUP BY 2
    UNION ALL SELECT 'phase', true_phase, count(*) FROM results GROUP BY 2""",
)
def level_counts(s, sf):
    r = results(s, sf)
    lev = R.value_counts(r, "intervention_level").select(
        F.lit("level").alias("what"), F.col("intervention_level").cast("string").alias("item"), "n"
    )
    return lev.unionByName(R.value_counts(r, "true_phase").select(F.lit("phase").alias("what"), F.col("true_phase").alias("item"), "n"))


@query(
    "phase_ranges",
    "SELECT true_phase, min(window_num)::DOUBLE - 0.5 AS x0, max(window_num)::DOUBLE + 0.5 AS x1 FROM results GROUP BY 1",
)
def phase_ranges(s, sf):
    out = R.phase_ranges(results(s, sf))
    return out.select("true_phase", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))


@query(
    "flag_counts",
    """SELECT window_num, len(ks_flagged_features)::INTEGER AS ks_flagged, len(psi_flagged_features)::INTEGER AS psi_flagged, ks_detected, psi_detected
    FROM results""",
)
def flag_counts(s, sf):
    return R.flag_counts(results(s, sf))


@query("feature_events", "SELECT window_num, feature, rank, phase FROM events_f")
def feature_events(s, sf):
    return R.feature_events(results(s, sf))


@query("feature_freq", "SELECT feature, n FROM freq")
def feature_freq(s, sf):
    return R.feature_freq(R.feature_events(results(s, sf)))


@query(
    "rank_heatmap",
    """SELECT window_num, feature, coalesce(rank, 0)::INTEGER AS rank FROM (SELECT DISTINCT window_num FROM events_f)
    CROSS JOIN (SELECT feature FROM (SELECT feature, count(*) AS n FROM events_f GROUP BY 1 ORDER BY n DESC, feature LIMIT 10))
    LEFT JOIN (SELECT window_num, feature, min(rank) AS rank FROM events_f GROUP BY 1, 2) USING (window_num, feature)""",
)
def rank_heatmap(s, sf):
    return R.rank_heatmap(R.feature_events(results(s, sf)))


@query(
    "truth_comparison",
    """SELECT feature, CASE WHEN a AND b THEN 'tp' WHEN a THEN 'fp' ELSE 'fn' END AS outcome FROM (
    SELECT coalesce(f.feature, t.feature) AS feature, f.feature IS NOT NULL AS a, t.feature IS NOT NULL AS b
    FROM (SELECT DISTINCT feature FROM events_f) f FULL OUTER JOIN (SELECT DISTINCT col AS feature FROM truth) t ON f.feature = t.feature)""",
)
def truth_comparison(s, sf):
    return R.truth_comparison(R.feature_events(results(s, sf)), C.drift_truth(s, M.SHIFTS, FEATS))


def _hist_sql() -> str:
    slot = "CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 30.0::DOUBLE)), 29) ELSE 0 END::INTEGER"
    return f"""SELECT phase, feature, bin, count(*) AS n, round(count(*) / (any_value(t) * any_value((hi - lo) / 30.0::DOUBLE)), 8) AS density FROM (
      SELECT phase, feature, {slot} AS bin, hi, lo, t FROM (SELECT *, min(value) OVER g AS lo, max(value) OVER g AS hi, count(*) OVER g AS t
      FROM ({O.unpivot('stream', 'phase', ['qty_mean', 'total_price'])}) WINDOW g AS (PARTITION BY phase, feature))) GROUP BY ALL"""


@query("phase_histogram", _hist_sql())
def phase_histogram(s, sf):
    return r6(R.histogram(T.scored_stream(s, sf), ["qty_mean", "total_price"], ["phase"]), "density", digits=8)


@query("scatter_data", "SELECT window_num, true_phase, D_total, est_auprc, risk_score, dpd, eod FROM results")
def scatter_data(s, sf):
    return results(s, sf).select("window_num", "true_phase", "D_total", "est_auprc", "risk_score", "dpd", "eod")


# ---- models, imputation, domain classifiers ---------------------------------------------------------


@query(
    "stratified_split",
    f"""SELECT row_idx, y, CASE WHEN rn <= floor(n * {O.lit(0.2)}) THEN 'val' ELSE 'train' END AS split FROM (
    SELECT row_idx, y, row_number() OVER (PARTITION BY y ORDER BY {O.bits('row_idx', 42)}, row_idx) AS rn,
      count(*) OVER (PARTITION BY y) AS n FROM ref)""",
)
def stratified_split(s, sf):
    return ML.stratified_split(T.reference_rows(s, sf), "y", "row_idx").select("row_idx", "y", "split")


def gbt_model(s, sf, trees: int = 100, depth: int = 5):
    key = (s.sparkContext.applicationId, sf, trees, depth)
    if key not in _MODELS:
        _MODELS[key] = ML.train_gbt(split_rows(s, sf), FEATS, "y", trees=trees, depth=depth)
    return _MODELS[key]


_MODELS: dict = {}


def _quality(scored: DataFrame, model: str) -> DataFrame:
    rounded = scored.withColumn("p", F.round("p", 9))
    return Q.evaluate_model(rounded, ["split"], "p", "y").withColumn("model", F.lit(model))


@query("train_gbt")
def train_gbt(s, sf):
    rows = split_rows(s, sf)
    return _quality(ML.score(gbt_model(s, sf), rows, FEATS, ["split", "y"]), "gbt")


@query("train_lr")
def train_lr(s, sf):
    rows = split_rows(s, sf)
    rows = C.scale(rows, FEATS, C.fit_scaler(rows.filter("split = 'train'"), FEATS))
    model = ML.train_lr(rows.filter("split = 'train'"), FEATS, "y")
    return _quality(ML.score(model, rows, FEATS, ["split", "y"]), "logistic_regression")


@query("calibrate")
def calibrate(s, sf):
    rows = split_rows(s, sf)
    scored = ML.score(gbt_model(s, sf), rows, FEATS, ["split", "y"])
    val = scored.filter("split = 'val'")
    parts = [
        _quality(ML.calibrate(val, "y", m)(scored), f"gbt_{m}")
        for m in ("sigmoid", "isotonic")
    ]
    return R.union_all(parts)


def _knn_sql() -> str:
    seen = [f"(r.{f} IS NOT NULL AND d.{f} IS NOT NULL)::INTEGER" for f in FEATS]
    sq = " + ".join(f"coalesce(pow(r.{f} - d.{f}, 2), 0)" for f in FEATS)
    return f"""SELECT entity_id, round(avg(v), 6) AS qty_std FROM (
      SELECT r.entity_id, d.qty_std AS v, row_number() OVER (PARTITION BY r.entity_id ORDER BY
         round(sqrt(({sq}) * {len(FEATS)} / ({' + '.join(seen)})), 9), d.row_idx) AS rk
      FROM cohort r JOIN cohort d ON d.qty_std IS NOT NULL AND r.entity_id <> d.entity_id
      WHERE r.qty_std IS NULL) WHERE rk <= 5 GROUP BY 1"""


@query("knn_impute", _knn_sql())
def knn_impute(s, sf):
    c = T.cohort(s, sf).select("row_idx", "entity_id", *FEATS)
    gaps = c.filter("qty_std is null").select("row_idx", "entity_id")
    filled = IM.knn_impute(c, c, "row_idx", FEATS)
    return r6(filled.join(gaps, ["row_idx", "entity_id"], "left_semi").select("entity_id", "qty_std"), "qty_std")


@query("adversarial", "SELECT window_id, round(adv_score, 6) AS adv_score, status FROM adversarial")
def adversarial(s, sf):
    return r6(domain_scores(s, sf), "adv_score")


@query("adversarial_importance", "SELECT window_id, feature, round(importance, 6) AS importance FROM adv_importance")
def adversarial_importance(s, sf):
    out = AD.adversarial_importance(held_out(s, sf), T.window_rows(s, sf), "window_id", "row_idx", FEATS)
    return r6(out, "importance")


def tree_leaves(s, sf) -> list[dict]:
    return TA.leaf_paths(gbt_model(s, sf).stages[-1], s, f"{scratch_dir(s)}/tidewatch-{s.sparkContext.applicationId}")


def tree_parts(s, sf, form: str) -> DataFrame:
    """Attributions of every scored row: against all explained rows, or by the trees' own weights."""

    def build():
        leaves = tree_leaves(s, sf)
        rows = ML.clean_features(T.scored_stream(s, sf), FEATS)
        tables = TA.path_tables(s, leaves) if form == "path" else TA.contribution_table(leaves, TA.background_masks(rows, FEATS, leaves))
        return TA.tree_attributions(rows, ["row_idx", "phase"], FEATS, leaves, materialize(tables, "leaf-tables"))

    return stage(s, ("tree", form, sf), build)


@query("tree_attributions")
def tree_attributions(s, sf):
    return A.fingerprint(tree_parts(s, sf, "background"), ["phase"])


@query("tree_path_attributions")
def tree_path_attributions(s, sf):
    return A.fingerprint(tree_parts(s, sf, "path"), ["phase"])


@query(
    "tree_conditions",
    " UNION ALL ".join(
        f"SELECT '{form}' AS form, '{part}' AS part, (SELECT count(*) FROM stream) AS n, 0.0::DOUBLE AS gap"
        for form, part in [*[("background", f) for f in FEATS], ("background", "margin"), ("path", "margin")]
    ),
)
def tree_conditions(s, sf):
    """What holds whatever the trees: parts add up to the margin less its base, and cancel over the explained rows."""
    margin = ML.score(gbt_model(s, sf), T.scored_stream(s, sf), FEATS, ["row_idx"]).select("row_idx", "margin")
    base = {"background": margin.agg(F.avg("margin")).first()[0], "path": TA.path_base(tree_leaves(s, sf))}
    size = lambda c: (F.round(c, 6) + 0.0).alias("gap")  # noqa: E731  no negative zero
    out = []
    for form in base:
        phi = tree_parts(s, sf, form)
        if form == "background":
            out.append(phi.groupBy(F.lit(form).alias("form"), F.col("feature").alias("part")).agg(F.count("*").alias("n"), size(F.avg("phi"))))
        sums = phi.groupBy("row_idx").agg(F.sum("phi").alias("sum")).join(margin, "row_idx")
        gap = F.max(F.abs(F.col("sum") + F.lit(base[form]) - F.col("margin")))
        out.append(sums.agg(F.count("*").alias("n"), size(gap)).select(F.lit(form).alias("form"), F.lit("margin").alias("part"), "n", "gap"))
    return R.union_all(out)


@query(
    "model_conditions",
    " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{condition}' AS condition, (SELECT count(*) FROM split WHERE split = '{split}') AS n, 0.0::DOUBLE AS gap"
        for model, split, conditions in [("logistic_regression", "train", ["intercept", *FEATS]), ("sigmoid", "val", ["mean"]), ("isotonic", "val", ["mean"]), ("gbt", "train", ["loss above that of a constant"])]
        for condition in conditions
    ),
)
def model_conditions(s, sf):
    """First-order conditions of the fits: weighted residuals cancel (against the penalty), calibrated means equal those of the labels."""
    rows = split_rows(s, sf)
    scaled = C.scale(rows, FEATS, C.fit_scaler(rows.filter("split = 'train'"), FEATS)).filter("split = 'train'")
    model = ML.train_lr(scaled, FEATS, "y")
    coefficients = model.stages[-1].coefficients
    fit = ML.score(model, ML.balanced_weight(scaled, "y"), FEATS, ["y", "weight", *FEATS])
    residual = F.col("weight") * (F.col("y") - F.col("p"))
    zero = lambda c: F.round(c, 3) + 0.0  # noqa: E731  no negative zero
    terms = [F.struct(F.lit("intercept").alias("condition"), zero(F.sum(residual) / F.sum("weight")).alias("gap"))]
    for f, b in zip(FEATS, coefficients):
        terms.append(F.struct(F.lit(f).alias("condition"), zero((F.sum(residual * F.col(f)) - F.lit(float(b))) / F.sum("weight")).alias("gap")))
    out = [fit.agg(F.count("*").alias("n"), F.array(*terms).alias("t")).select("n", F.inline("t")).select(F.lit("logistic_regression").alias("model"), "condition", "n", "gap")]
    scored = ML.score(gbt_model(s, sf), rows, FEATS, ["split", "y"])
    val = scored.filter("split = 'val'")
    for method in ("sigmoid", "isotonic"):
        gap = zero(F.avg(F.col("p") - F.col("y"))).alias("gap")
        out.append(ML.calibrate(val, "y", method)(val).agg(F.count("*").alias("n"), gap).select(F.lit(method).alias("model"), F.lit("mean").alias("condition"), "n", "gap"))
    train = ML.balanced_weight(scored.filter("split = 'train'"), "y")
    weighted = F.sum(F.col("weight") * F.when(F.col("y") == 1, -F.log("p")).otherwise(-F.log(1 - F.col("p")))) / F.sum("weight")
    worse = F.greatest(weighted - F.log(F.lit(2.0)), F.lit(0.0)).alias("gap")
    out.append(train.agg(F.count("*").alias("n"), worse).select(F.lit("gbt").alias("model"), F.lit("loss above that of a constant").alias("condition"), "n", "gap"))
    return R.union_all(out)


def stepped(df: DataFrame) -> DataFrame:
    """The events are stationary; lift the second half of the month so that there is a change to find."""
    late = F.col("ts") >= F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    return df.withColumn("moved", F.least(F.col("value") / 500.0 + F.when(late, 0.5).otherwise(0.0), F.lit(1.0)))


@query(
    "adwin",
    """SELECT k AS label, count(*) AS n, count(*) FILTER (drift) AS n_drift, arg_max(window_size, run) AS window_size FROM reading_adwin GROUP BY 1""",
)
def adwin(s, sf):
    flags = AW.adwin(stepped(T.readings(s, sf)), ["label"], ["ts", "event_id"], "moved", grain=O.READING_GRAIN)
    return flags.groupBy("label").agg(
        F.count("*").alias("n"),
        F.count_if("drift").alias("n_drift"),
        F.max_by("window_size", "run").alias("window_size"),
    )


@query(
    "adwin_changes",
    f"""SELECT run, arg_max(rn, (gap, -rn)) AS change_position FROM (
      SELECT run, rn, round(abs(s0 / n0 - (total - s0) / (n - n0)) * sqrt(n0 * (n - n0) / n), 9) AS gap FROM (
        SELECT c.run, rn, count(*) OVER o AS n0, sum(p) OVER o AS s0, count(*) OVER (PARTITION BY c.run) AS n, sum(p) OVER (PARTITION BY c.run) AS total
        FROM (SELECT *, (last_position - window_size)::BIGINT // {O.PRED_GRAIN} AS kept FROM pred_adwin WHERE drift) c
        JOIN (SELECT row_idx + 1 AS rn, row_idx // {O.PRED_GRAIN} AS of, p FROM stream) r ON r.of IN (c.kept, c.kept - 1)
        WINDOW o AS (PARTITION BY c.run ORDER BY rn)) WHERE n0 < n) GROUP BY 1""",
)
def adwin_changes(s, sf):
    """Changes of the predictions: cuts over summaries, then the place within two of them."""
    rows = T.scored_stream(s, sf).select("row_idx", "p")
    return AW.change_positions(rows, prediction_cuts(s, sf), [], ["row_idx"], "p", O.PRED_GRAIN)


# ---- streams ----------------------------------------------------------------------------------------


def event_stream(s, sf) -> DataFrame:
    return file_stream(s, sf, T.table(s, sf, "events").schema, glob="events.parquet")


_EV_BIN = " + ".join(f"(value >= lo + {O.lit(k)} * ((hi - lo) / {O.lit(10)}))::INTEGER" for k in range(1, 10))


@query(
    "stream_profile",
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, bin::INTEGER AS bin, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT date_trunc('day', ts) AS day, value, {_EV_BIN} AS bin FROM events
      CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-11')) GROUP BY ALL""",
)
def stream_profile(s, sf):
    ref = T.table(s, sf, "events").filter("ts < timestamp_ntz'2024-01-11'").select(F.lit("value").alias("feature"), "value")
    edges = SW.reference_edges(ref)
    build = lambda stream: SW.stream_profile(stream, "ts", ["value"], edges, "1 day", delay="1 day")
    out = run_closed(event_stream(s, sf), "ts", build, "profile", value=0.0)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "bin", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sessions",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_rows, round(avg(value), 6) AS value_mean,
    min(value) AS value_min, max(value) AS value_max FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (
        SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
        FROM events)) GROUP BY user_id, sid""",
)
def stream_sessions(s, sf):
    build = lambda stream: SW.stream_sessions(stream, "ts", "user_id", ["value"], "6 hours", "1 day")
    out = run_closed(event_stream(s, sf), "ts", build, "sessions", user_id=0, value=0.0)
    start = F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start")
    return r6(out.select("user_id", start, "n_rows", "value_mean", "value_min", "value_max"), "value_mean")


@query(
    "stream_count_windows",
    """SELECT user_id, (rn - 1) // 20 AS window_no, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS rn FROM events) GROUP BY 1, 2""",
)
def stream_count_windows(s, sf):
    build = lambda stream: SS.stream_count_windows(stream, "user_id", "ts", "value", 20)
    out = run_closed(event_stream(s, sf), "ts", build, "counts", user_id=0, value=0.0)
    return r6(out, "mean")


@query(
    "stream_late",
    """SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS arrived, (count(*) FILTER (NOT late OR day + INTERVAL 1 DAY > top - INTERVAL 1 DAY))::BIGINT AS kept,
      (count(*) FILTER (late AND day + INTERVAL 1 DAY <= top - INTERVAL 1 DAY))::BIGINT AS late
    FROM (SELECT date_trunc('day', ts) AS day, event_id % 7 = 0 AS late, (SELECT max(ts) FROM events WHERE event_id % 7 <> 0) AS top FROM events) GROUP BY 1""",
)
def stream_late(s, sf):
    """A seventh of the events comes after all others: what the watermark had already passed is counted, day by day."""
    events, base = T.table(s, sf, "events"), f"{scratch_dir(s)}/tidewatch-{s.sparkContext.applicationId}/late-{uuid.uuid4().hex}"
    edges = SW.reference_edges(events.select(F.lit("value").alias("feature"), "value"))
    late = F.col("event_id") % 7 == 0

    def arrive(rows, stream):
        rows.write.mode("append").parquet(f"{base}/in")
        return run_to_table(SW.stream_profile(stream(), "ts", ["value"], edges, "1 day", delay="1 day"), "late", base)

    source = lambda: file_stream(s, f"{base}/in", events.schema)
    arrive(events.filter(~late), source)
    arrive(events.filter(late), source)
    end = events.limit(1).select(*[F.lit(END_OF_STREAM).cast(f.dataType).alias(f.name) if f.name == "ts" else F.col(f.name) for f in events.schema.fields])
    kept = arrive(end, source)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    return SW.late_rows(events.select(day("ts")), kept.select(day("window_start"), "n"), ["day"])


@query("stream_adwin", "SELECT k AS event_type, last_position AS position, s AS value FROM kind_adwin JOIN kind_runs USING (k, run, last_position) WHERE drift")
def stream_adwin(s, sf):
    return run_to_table(SS.stream_adwin(stepped(event_stream(s, sf)), "event_type", "ts", "moved"), "cuts")


EPOCHS = 3


def epoch_of(index: str, first: str, total: str) -> str:
    return f"(({index}) - ({first})) * {EPOCHS} // (({total}) - ({first}))"


_EPOCH_WIN = f"""SELECT stream.*, {epoch_of('row_idx', 'f', 'n')} AS window_id
FROM stream, (SELECT min(row_idx) FILTER (phase <> 'phase1') AS f, count(*) AS n FROM stream) WHERE phase <> 'phase1'"""
_MONITORED = "D_total, D_shap, adv_score, drift_belief, risk_score, est_auprc, intervention_level, intervention_action, true_phase, n_samples, dpd, eod"


@query(
    "stream_monitor",
    f"SELECT window_idx AS batch_id, {_MONITORED}, intervention_level >= 2 AS alerted FROM results",
    {"win": _EPOCH_WIN},
)
def stream_monitor(s, sf):
    """The later phases arrive in epochs; each micro-batch gets its whole record and, from level 2 on, its alert."""
    base = f"{scratch_dir(s)}/tidewatch-{s.sparkContext.applicationId}/mon-{uuid.uuid4().hex}"
    scored, ref, prof = T.scored_stream(s, sf), T.reference_rows(s, sf), profile(s, sf)
    rows = scored.filter("phase <> 'phase1'")
    first, last = rows.agg(F.min("row_idx"), F.max("row_idx")).first()
    held = reference_fit(s, sf)

    def record(batch):
        windowed = batch.withColumn("window_id", F.col("batch_id")).drop("batch_id")
        parts = materialize(monitor.components(ref, windowed, W_KEY), "epoch")
        adv = AD.adversarial_scores(held, windowed, "window_id", "row_idx", FEATS, 3).select("window_id", "adv_score")
        found = materialize(monitor.window_results(ref, windowed, prof, parts, adv, bounded=False), "epoch").withColumn("batch_id", F.col("window_idx"))
        alerts = AL.build_alerts(found.drop("batch_id"), FM.top_moves(parts), ["window_num"], min_level=2)
        return {"records": found, "alerts": alerts.withColumn("batch_id", F.col("window_num"))}

    epoch = F.floor((F.col("row_idx") - first) * EPOCHS / F.lit(last + 1 - first))
    for i in range(EPOCHS):  # arrivals; the query goes on from its checkpoint
        rows.filter(epoch == i).write.mode("append").parquet(f"{base}/in")
        stream = file_stream(s, f"{base}/in", scored.schema)
        SM.stream_monitor(stream, record, f"{base}/out", f"{base}/checkpoint", "monitor").awaitTermination()
    records = s.read.parquet(f"{base}/out/records").drop("query_id")
    alerts = s.read.schema("window_num long, query_id string, batch_id long").parquet(f"{base}/out/alerts")
    alerts = alerts.select("batch_id", F.lit(True).alias("alerted"))
    out = records.join(alerts, "batch_id", "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    return out.select(F.col("batch_id").cast("long").alias("batch_id"), *_MONITORED.split(", "), "alerted")


@query(
    "run_bundle",
    """SELECT 'run_a' AS run_id, true_phase, count(*) AS windows, round(avg(D_total), 6) AS mean_d, sum(len(top_sadi_features))::BIGINT AS listed
    FROM results GROUP BY 2""",
)
def run_bundle(s, sf):
    base = f"{scratch_dir(s)}/tidewatch-{s.sparkContext.applicationId}/runs-{uuid.uuid4().hex}"
    B.write_results(results(s, sf), base, "run_a")
    back = B.load_bundle(s, base)["results"]
    return back.groupBy("run_id", "true_phase").agg(
        F.count("*").alias("windows"),
        F.round(F.avg("D_total"), 6).alias("mean_d"),
        F.sum(F.size("top_sadi_features")).alias("listed"),
    )


# ---- sources and sinks: written from the given tables, read back, compared with the tables -------------------


def new_folder(s, name: str) -> str:
    return f"{scratch_dir(s)}/tidewatch-{s.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_VITALS = dict(zip(M.READING_KINDS, SR.VITALS))


@query(
    "read_psv",
    "SELECT user_id::VARCHAR AS patient_id, count(*) AS n, max(hour)::INTEGER AS hours, sum(label)::BIGINT AS positives, "
    + ", ".join(f"count({k}) AS n_{v}, round(sum({k}), 6) AS sum_{v}" for k, v in _VITALS.items())
    + ", 0::BIGINT AS rejected FROM readings GROUP BY user_id",
)
def read_psv(s, sf):
    """Readings of every user as files of their own, and back by the files' headers."""
    path = new_folder(s, "psv")
    rows = T.readings(s, sf).select(
        F.col("user_id").alias("patient_id"), *[F.col(k).alias(v) for k, v in _VITALS.items()], F.col("hour").alias("ICULOS"), F.col("label").alias("SepsisLabel")
    )
    SR.write_psv(rows, path, parts=2)
    back, rejects = SR.read_psv(s, path, layout="folders")
    sums = [a for v in _VITALS.values() for a in (F.count(v).alias(f"n_{v}"), F.round(F.sum(v), 6).alias(f"sum_{v}"))]
    out = back.groupBy("patient_id").agg(F.count("*").alias("n"), F.max("ICULOS").alias("hours"), F.sum("SepsisLabel").alias("positives"), *sums)
    lost = rejects.groupBy("patient_id").agg(F.count("*").alias("rejected"))
    return out.join(lost, "patient_id", "left").fillna(0, ["rejected"])


@query(
    "read_upload",
    """SELECT patient_id, n, n_values, round(total, 6) AS total, rejected, 'hourly' AS format FROM (
    SELECT user_id::VARCHAR AS patient_id, count(*) AS n, count(*) FILTER (event_id % 7 <> 3 AND value IS NOT NULL) AS n_values,
      sum(value) FILTER (event_id % 7 <> 3) AS total, count(*) FILTER (event_id % 7 = 3) AS rejected FROM events GROUP BY user_id)""",
)
def read_upload(s, sf):
    """Events as an uploaded table with cells that are no numbers: they are NULL, their lines are rejects."""
    path = new_folder(s, "upload")
    cell = F.when(F.col("event_id") % 7 == 3, F.lit("n/a (sensor)")).otherwise(F.col("value").cast("string"))
    B.write_csv(T.table(s, sf, "events").select(F.col("user_id").alias("PatientID"), cell.alias("HR"), (F.col("event_id") % 2).alias("Gender")), path)
    rows, rejects, kind = SR.read_upload_checked(s, path)
    out = rows.groupBy("patient_id").agg(F.count("*").alias("n"), F.count("HR").alias("n_values"), F.round(F.sum("HR"), 6).alias("total"))
    lost = rejects.groupBy(F.element_at(F.split("line", ","), 1).alias("patient_id")).agg(F.count("*").alias("rejected"))
    return out.join(lost, "patient_id", "left").fillna(0, ["rejected"]).withColumn("format", F.lit(kind))


@query(
    "alert_log",
    f"SELECT window_num, true_phase, level, action, severity, D_total, top_names, length(recommendation)::INTEGER AS text_length FROM ({_ALERT})",
)
def alert_log(s, sf):
    """Alerts as JSON lines with their nested lists, and back."""
    path, made = new_folder(s, "alerts"), alert_table(s, sf)
    B.write_json(made, path)
    back = s.read.schema(made.schema).json(path)
    names = F.array_join(F.transform("top_features", lambda t: t["feature"]), ",")
    return back.select("window_num", "true_phase", "level", "action", "severity", "D_total", names.alias("top_names"), F.length("recommendation").alias("text_length"))


@query(
    "stored_fingerprint",
    "SELECT feature, " + rs(["mean_abs", "mean", "std"]) + ", n, rank, round(lo, 6) AS lo, round(hi, 6) AS hi FROM fp_ref "
    "JOIN (SELECT feature, min(phi) AS lo, max(phi) AS hi FROM phi_ref GROUP BY 1) USING (feature)",
)
def stored_fingerprint(s, sf):
    """The reference profile saved in its two parts, and loaded."""
    path, phi = new_folder(s, "profile"), monitor.attributions(T.reference_rows(s, sf), [])
    B.save_fingerprint(A.fingerprint(phi), phi, path)
    summary, values = B.load_fingerprint(s, path)
    ends = values.groupBy("feature").agg(F.round(F.min("phi"), 6).alias("lo"), F.round(F.max("phi"), 6).alias("hi"))
    return r6(summary, "mean_abs", "mean", "std").join(ends, "feature")


@query(
    "model_metrics",
    f"""SELECT 'run_m' AS run_id, model, round(auprc, 4) AS auprc, round(auroc, 4) AS auroc, round(brier_score, 4) AS brier_score,
      round(optimal_threshold, 4) AS optimal_threshold, class, round(precision, 4) AS precision, round(recall, 4) AS recall
    FROM (SELECT phase AS model, {O.AP} AS auprc, {O.AUROC} AS auroc,
        sum(pos_at * (1 - threshold) * (1 - threshold) + (n_at - pos_at) * threshold * threshold) / max(n) AS brier_score,
        arg_max(threshold, (f1, -threshold)) AS optimal_threshold FROM (SELECT *, {O.F1} AS f1 FROM {_curve('stream', 'phase')}) GROUP BY 1)
    JOIN (SELECT phase AS model, class, CASE WHEN class <> 'accuracy' THEN precision END AS precision, CASE WHEN class <> 'accuracy' THEN recall END AS recall
        FROM ({_report_sql('stream', 'phase', 'p >= 0.5')})) USING (model)""",
)
def model_metrics(s, sf):
    """Quality of the scores by phase, written as a run's metrics file, and read from the tree of runs."""
    path, rows = new_folder(s, "metrics"), T.scored_stream(s, sf).withColumnRenamed("phase", "model")
    report = Q.class_report(Q.confusion(rows, ["model"], (F.col("p") >= 0.5).cast("int"), "y"), ["model"])
    report = report.select("model", "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "support")
    B.write_metrics(Q.evaluate_model(rows, ["model"], "p", "y"), report, path, "run_m")
    B.write_results(results(s, sf), path, "run_m")
    kept = B.load_bundle(s, path)["baseline"]
    classes = B.class_metrics(kept).select("model", "class", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))
    return B.model_metrics(kept).join(classes, "model")


# ---- the whole flow on a fitted model ----------------------------------------------------------------


def fitted_flow(s, sf):
    key = (s.sparkContext.applicationId, sf, "fitted")
    if key not in _MODELS:
        domain = lambda windowed: AD.adversarial_scores(held_out(s, sf), windowed, "window_id", "row_idx", FEATS, 3).select("window_id", "adv_score")
        _MODELS[key] = FM.monitor_fitted(split_rows(s, sf), T.scored_stream(s, sf).drop("p"), "y", domain)
    return _MODELS[key]


@query("fitted_monitor")
def fitted_monitor(s, sf):
    """Train, calibrate, score, attribute, monitor, alert: the record of every window with its alert, if any."""
    _, _, record, due = fitted_flow(s, sf)
    due = due.select("window_num", "severity", "recommendation", "alert_text")
    return record.join(by_shuffle(due), "window_num", "left").select(*[F.array_join(c, ",").alias(c) if c in _ARR else F.col(c) for c in _RES], "severity", "recommendation")


_RULE = """(SELECT n, size, step, (n - 1) // step + 1 AS windows FROM (
  SELECT *, CASE WHEN n < 500 THEN greatest(10, size // 4) ELSE size // 2 END AS step FROM (
    SELECT n, CASE WHEN n < 500 THEN greatest(30, n // 10) WHEN n < 2000 THEN 100 ELSE 200 END AS size FROM (SELECT count(*) AS n FROM stream))))"""


@query(
    "fitted_conditions",
    " UNION ALL ".join(
        f"SELECT '{name}' AS condition, ({n})::BIGINT AS n, 0.0::DOUBLE AS gap"
        for name, n in [
            ("windows", f"SELECT windows FROM {_RULE}"),
            ("rows in windows", f"SELECT sum(least(n, w * step + size) - w * step) FROM (SELECT *, unnest(range(windows)) AS w FROM {_RULE})"),
            ("attributions add up", "SELECT count(*) FROM stream"),
            ("calibrated mean of the held-out rows", "SELECT count(*) FROM split WHERE split = 'val'"),
            ("levels follow from the record", f"SELECT windows FROM {_RULE}"),
            ("alerts are the windows at level 1 or above", f"SELECT windows FROM {_RULE}"),
        ]
    ),
)
def fitted_conditions(s, sf):
    """What holds whatever the fit; windows and rows are counted by the size rule in the check."""
    model, scored, record, due = fitted_flow(s, sf)

    def row(df, name, gap, n=F.count("*")):
        return df.agg(n.cast("long").alias("n"), (F.round(F.coalesce(gap, F.lit(0.0)), 5) + 0.0).cast("double").alias("gap")).select(F.lit(name).alias("condition"), "n", "gap")

    parts = monitor.attributions(scored, ["row_idx", "margin"], model.linear).groupBy("row_idx", "margin").agg(F.sum("phi").alias("phi"))
    val = scored.join(held_out(s, sf).select("row_idx"), "row_idx", "left_semi")
    level = CT.intervention_level(F.col("D_total"), F.col("risk_score"))
    marked = record.join(by_shuffle(due.select("window_num", "level")), "window_num", "left")
    return R.union_all([
        row(record, "windows", F.lit(0.0)),
        row(record, "rows in windows", F.lit(0.0), F.sum("n_samples")),
        row(parts, "attributions add up", F.max(F.abs(F.col("margin") - F.lit(model.intercept) - F.col("phi")))),
        row(val, "calibrated mean of the held-out rows", F.avg(F.col("p") - F.col("y"))),
        row(record, "levels follow from the record", F.sum((level != F.col("intervention_level")).cast("double"))),
        row(marked, "alerts are the windows at level 1 or above", F.sum((F.col("level").isNotNull() != (F.col("intervention_level") >= 1)).cast("double"))),
    ])


@query(
    "flags_by_column",
    " UNION ALL ".join(
        f"SELECT window_id, '{kind}' AS test, array_to_string(list(feature ORDER BY list_position({FEATS!r}, feature))[1:5], ',') AS features FROM {src} GROUP BY 1"
        for kind, src in (("ks", "ks WHERE p_value < 0.05"), ("psi", "psi_detector WHERE psi > 0.2"))
    ),
)
def flags_by_column(s, sf):
    """The first five flagged features of every window in the order of the columns."""
    long = window_long(s, sf)
    ks = D.ks_test(long, profile(s, sf), W_KEY, bounded=True)
    both = D.psi_both(D.psi_cells(long, profile(s, sf), W_KEY), W_KEY)
    out = [
        A.first_features(df.filter("flagged"), FEATS, 5, W_KEY, "features").select("window_id", F.lit(kind).alias("test"), F.array_join("features", ",").alias("features"))
        for kind, df in (("ks", ks), ("psi", both))
    ]
    return R.union_all(out)

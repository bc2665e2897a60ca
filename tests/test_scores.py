"""Published values of the composite scores, decisions, detector tables and reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as AL
from tidewatch.operators import controller as CT
from tidewatch.operators import drift_index as I
from tidewatch.operators import evaluation as E
from tidewatch.operators import fairness as FR
from tidewatch.operators import quality as Q
from tidewatch.operators import reports as R
from tidewatch.operators import windows as W


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize(
    "parts,total,label",
    [((0.2476, 0.1284, 0.1228), 0.1985, "NOMINAL"), ((0.2686, 0.1560, 0.1797), 0.2295, "MODERATE"), ((0.2761, 0.3394, 0.2065), 0.2682, "HIGH")],
)
def test_batch_triage(spark, parts, total, label):
    d = I.batch_total(*[F.lit(p) for p in parts])
    row = one(spark, d=d, s=AL.severity(d, "batch"))
    assert row.d == pytest.approx(total, abs=6e-5) and row.s == label


def test_belief_and_risk(spark):
    row = one(
        spark,
        a=I.belief(F.lit(1.7), F.lit(0.45)),
        b=I.belief(F.lit(0.5), F.lit(0.75)),
        c=I.risk(F.lit(0.83), F.lit(0.79)),
        d=I.risk(F.lit(0.5), F.lit(0.9)),
    )
    assert (row.a, row.b) == (pytest.approx(0.6), pytest.approx(0.5)) and row.c == pytest.approx(0.04) and row.d == 0
    for bad in ((-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            I.belief(F.lit(0.1), F.lit(0.5), *bad)


@pytest.mark.parametrize(
    "d,risk,level",
    [(0.1, 0.01, 0), (0.1, 0.2, 1), (1.9, 0.04, 1), (0.4, 0.2, 2), (0.9, 0.06, 2), (0.6, 0.2, 3), (0.7, 0.2, 4)],
)
def test_intervention_levels(spark, d, risk, level):
    df = spark.createDataFrame([(d, risk)], "d double, r double")
    row = CT.decide(df, "d", "r").first()
    assert row.level == level and row.action == CT.ACTIONS[level] and row.message == CT.MESSAGES[level]


def test_detector_table(spark):
    """30 windows 12/7/11; the index and PSI always fire, KS misses two stable windows."""
    rows = [(i, "phase1" if i < 12 else "phase2" if i < 19 else "phase3", 1.0, i not in (3, 7), True) for i in range(30)]
    res = spark.createDataFrame(rows, "window_num int, true_phase string, D_total double, ks boolean, psi boolean")
    flags = E.detector_flags(res, [], {"index": F.col("D_total") > 0.3, "ks": F.col("ks"), "psi": F.col("psi")})
    got = {r.detector: (r.precision, r.recall, r.f1, r.latency) for r in E.detector_scores(flags).collect()}
    assert got == {"index": (0.6, 1.0, 0.75, 0), "ks": (0.6429, 1.0, 0.7826, 0), "psi": (0.6, 1.0, 0.75, 0)}
    boot = {r.detector: r for r in E.bootstrap_summary(E.bootstrap_f1(flags, []), []).collect()}
    assert boot["index"].f1_mean == pytest.approx(0.7533, abs=0.01) and boot["index"].f1_std == pytest.approx(0.0718, abs=0.01)
    assert boot["ks"].f1_mean == pytest.approx(0.785, abs=0.01)
    same = E.wilcoxon(E.bootstrap_f1(flags, []), "index", "psi").first()
    assert (same.statistic, same.p_value) == (0.0, 1.0)  # they agree on every window


def test_resamples_are_paired(spark):
    """Two detectors on disjoint halves of the drifted windows: in a resample one gains what the other loses."""
    rows = [(i, "phase1" if i < 20 else "phase3", 20 <= i < 30, i >= 30) for i in range(40)]
    res = spark.createDataFrame(rows, "window_num int, true_phase string, a boolean, b boolean")
    flags = E.detector_flags(res, [], {"a": F.col("a"), "b": F.col("b")})
    f1 = E.bootstrap_f1(flags, [], 200).groupBy("resample").pivot("detector", ["a", "b"]).agg(F.first("f1")).toPandas()
    # hits x and y share the drawn drifted windows: F1 is 2x / (2x + y) and 2y / (2y + x)
    ratio = f1["a"] / (2 - f1["a"]) + f1["b"] / (2 - f1["b"])
    assert len(f1) == 200 and ratio.between(1 - 1e-9, 1 + 1e-9).all() and (f1["a"] != f1["b"]).mean() > 0.5
    assert E.wilcoxon(E.bootstrap_f1(flags, [], 200), "a", "b").first().statistic > 0


def test_resamples_per_key(spark):
    rows = [(k, i, "phase1" if i < 3 else "phase2", "d", i > 1) for k in ("x", "y") for i in range(7)]
    flags = spark.createDataFrame(rows, "run string, window_num int, true_phase string, detector string, fired boolean")
    got = E.bootstrap_f1(flags, ["run"], 50).toPandas()
    x, y = (got[got["run"] == k].sort_values("resample")["f1"].tolist() for k in ("x", "y"))
    assert len(x) == 50 and x == y and got["f1"].between(0, 1).all()  # equal flags, equal resamples
    assert E.bootstrap_f1(flags.filter("run = 'z'"), ["run"], 50).count() == 0


def test_latency_is_null_without_alarm(spark):
    rows = [(0, "phase1", False), (1, "phase2", False), (2, "phase3", False)]
    flags = spark.createDataFrame(rows, "window_num int, true_phase string, fired boolean").withColumn("detector", F.lit("x"))
    row = E.detector_scores(flags).first()
    assert row.latency is None and row.precision == row.recall == row.f1 == 0


def test_wilcoxon_by_hand(spark):
    a, b = [0.5, 0.6, 0.9, 0.4, 0.7], [0.4, 0.7, 0.6, 0.4, 0.5]
    rows = [("a", i, v) for i, v in enumerate(a)] + [("b", i, v) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "detector string, resample int, f1 double")
    row = E.wilcoxon(df, "a", "b").first()  # differences .1 -.1 .3 0 .2: ranks 1.5 1.5 4 - 3
    assert row.statistic == 1.5
    same = E.wilcoxon(df.withColumn("f1", F.lit(0.5)), "a", "b").first()
    assert (same.statistic, same.p_value) == (0.0, 1.0)


def test_attribution_accuracy_of_known_counts(spark):
    truth = spark.createDataFrame([(f"t{i}",) for i in range(27)], "column string")
    hits = [("m", f"t{i}") for i in range(10)] + [("m", f"x{i}") for i in range(11)]
    det = spark.createDataFrame(hits * 2, "method string, feature string")
    row = E.attribution_accuracy(det, truth, []).first()
    assert (row.precision, row.recall) == (0.4762, 0.3704)


def test_class_report_of_known_confusion(spark):
    df = spark.createDataFrame([(9, 4, 1, 106)], "tp long, fp long, fn long, tn long")
    got = {r["class"]: r for r in Q.class_report(df, []).collect()}
    r4 = lambda r: tuple(round(v, 4) for v in (r.precision, r.recall, r.f1_score))
    assert r4(got["0"]) == (0.9907, 0.9636, 0.9770) and r4(got["1"]) == (0.6923, 0.9, 0.7826)
    assert round(got["accuracy"].f1_score, 4) == 0.9583 and got["macro avg"].support == 120


def test_quality_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "p double, y int").withColumn("g", F.lit("m"))
    row = Q.evaluate_model(df, ["g"], "p", "y").first()
    assert row.auprc == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert row.auroc == pytest.approx((3 + 2.5 + 1) / 9)
    assert row.brier_score == pytest.approx((0.01 + 0.64 + 0.04 + 0.09 + 0.64 + 0.01) / 6)
    assert row.optimal_threshold == 0.2 and (row.tp, row.fp, row.fn, row.tn) == (3, 2, 0, 1)  # 3/5 and 1
    one_class = df.withColumn("y", F.lit(0))
    assert Q.average_precision(one_class, ["g"], "p", "y").first().auprc == 0.0
    assert Q.average_precision(df, ["g"], "p", "y", min_rows=10).first().auprc == 0.5
    assert Q.area_under_roc(one_class, ["g"], "p", "y").first().auroc == 0.5


def test_window_count_and_phases(spark):
    rows = spark.range(1500).select(F.col("id").alias("row_idx")).withColumn(
        "phase", F.when(F.col("row_idx") < 600, "phase1").when(F.col("row_idx") < 975, "phase2").otherwise("phase3")
    )
    win = W.count_windows(rows, 100, 50)
    sizes = {r.window_id: r for r in W.window_sizes(win, 100).collect()}
    assert len(sizes) == 30 and sizes[29].n_samples == 50 and sizes[29].is_partial
    modes = [r.true_phase for r in W.window_phase(win).collect()]
    assert [modes.count(f"phase{i}") for i in (1, 2, 3)] == [12, 7, 11]
    with pytest.raises(ValueError):
        W.count_windows(rows, 0, 1)
    gaps = W.count_windows(rows, 2, 5).filter("window_id = 1").agg(F.min("row_idx"), F.max("row_idx")).first()
    assert tuple(gaps) == (5, 6)


@pytest.mark.parametrize("n,want", [(100, (30, 10)), (400, (40, 10)), (499, (49, 12)), (1500, (100, 50)), (2000, (200, 100))])
def test_window_size_rule(n, want):
    assert W.window_size_rule(n) == want


def test_fairness_by_hand(spark):
    rows = [("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("a", 0, 0), ("b", 1, 1), ("b", 0, 0), ("b", 0, 0), ("b", 0, 0)]
    df = spark.createDataFrame(rows, "g string, y int, p int").withColumn("w", F.lit(1))
    row = FR.fairness(df, ["w"], "g", F.col("p"), "y").first()
    assert (row.dpd, row.eod, row.n_groups) == (0.25, 0.5, 2)
    alone = FR.fairness(df.filter("g = 'a'"), ["w"], "g", F.col("p"), "y").first()
    assert (alone.dpd, alone.eod) == (0.0, 0.0)
    chk = one(spark, **FR.check(F.lit(0.25), F.lit(0.05)))
    assert chk.dpd_exceeded and not chk.eod_exceeded
    assert chk.alert_message == "Demographic Parity Difference (0.2500) exceeds threshold (0.10)."


def test_age_bands_are_right_closed(spark):
    ages = [(0.0,), (40.0,), (40.5,), (65.0,), (66.0,), (200.0,), (201.0,), (-1.0,), (None,)]
    df = spark.createDataFrame(ages, "a double")
    got = [r[0] for r in df.select(FR.age_group(F.col("a"))).collect()]
    assert got == ["young_0-40"] * 2 + ["middle_40-65"] * 2 + ["elderly_65+"] * 2 + ["unknown"] * 3
    assert df.select(FR.age_group(F.col("a"), [0, 50, 100])).first()[0] == "group_0"


def test_direction_and_recommendation(spark):
    pairs = [(1.0, -1.0), (1.0, 1.3), (1.0, 0.7), (1.0, 1.1), (0.0, 0.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r[0].split()[-1] for r in df.select(AL.direction(F.col("a"), F.col("b"))).collect()]
    assert got == ["FLIPPED", "UP", "DOWN", "STABLE", "STABLE"]
    feats = F.array(*[F.lit(f"f{i}") for i in range(7)])
    text = one(spark, t=AL.recommendation(F.lit(2), feats)).t
    assert "f0, f1, f2, f3, f4." in text and "f5" not in text
    empty = one(spark, t=AL.recommendation(F.lit(1), F.array().cast("array<string>"))).t
    assert "in: N/A." in empty


def test_alerts_carry_fairness_and_moves(spark):
    res = spark.createDataFrame(
        [(7, "phase3", 3, "PARTIAL_RETRAIN", 0.61, 0.12, 0.8, 0.68, 0.2, 0.0), (8, "phase1", 1, "ALERT", 0.31, 0.0, 0.8, 0.8, 0.0, 0.0)],
        "window_num int, true_phase string, intervention_level int, intervention_action string, D_total double, risk_score double, "
        "baseline_auprc double, est_auprc double, dpd double, eod double",
    )
    top = spark.createDataFrame(
        [(7, "x", 0.9, 1.0, -1.0, 1), (7, "y", 0.5, 1.0, 1.0, 2)],
        "window_num int, feature string, sadi double, ref_mean double, new_mean double, rank int",
    )
    rows = AL.build_alerts(res, top, ["window_num"]).collect()
    assert len(rows) == 1
    a = rows[0]
    assert a.severity == "HIGH" and a.auprc_drop_pct == pytest.approx(15.0)
    assert [t.feature for t in a.top_features] == ["x", "y"] and a.top_features[0].direction.endswith("FLIPPED")
    assert "Demographic" in a.fairness_note and "Significant drift detected in: x, y." in a.alert_text


def test_truth_scores(spark):
    ev = spark.createDataFrame([("a",), ("a",), ("b",)], "feature string")
    truth = spark.createDataFrame([("a",), ("c",)], "column string")
    row = R.truth_scores(R.truth_comparison(ev, truth)).first()
    assert (row.tp, row.fp, row.fn, row.f1) == (1, 1, 1, 0.5)


def test_index_weights_and_batch_caps(spark):
    ref = spark.createDataFrame([("a", 0.5, 0.2, 0.1, 1), ("b", 0.1, -0.1, 0.1, 2)], "feature string, mean_abs double, mean double, std double, rank int")
    cur = spark.createDataFrame([(0, "a", 0.1, -0.1, 0.1, 2), (0, "b", 0.9, -0.3, 0.1, 1)], "w int, feature string, mean_abs double, mean double, std double, rank int")
    kl = spark.createDataFrame([(0, "a", 0.4), (0, "b", 0.2)], "w int, feature string, kl double")
    got = {r.feature: r for r in I.sadi(I.index_components(ref, cur, kl, ["w"])).collect()}
    assert got["a"].sadi == pytest.approx(0.5 * 0.4 + 0.3 * 0.5 + 0.2) and got["b"].sadi == pytest.approx(0.1 + 0.15)
    batch = {r.feature: r for r in I.sadi_batch(ref, cur, ["w"]).collect()}
    assert batch["b"].kl == 2.0 and batch["a"].kl == pytest.approx(0.8) and batch["a"].direction_flip == 1.0


def test_observation_windows_by_hour_count_gaps(spark):
    """Frames span hours; brute force over an entity longer than one chunk and short ones."""
    from tidewatch.operators.windows import observation_windows_by_hour

    rng = np.random.default_rng(12)
    rows = [("a", int(h), float(rng.normal()) if rng.random() < 0.8 else None, int(rng.random() < 0.1)) for h in np.sort(rng.integers(0, 300, 150))]
    rows += [("b", 5, 1.0, 0), ("b", 7, 3.0, 1), ("c", 9, None, 0), (None, 1, 1.0, 1), ("d", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "patient_id string, ICULOS int, x double, SepsisLabel int").repartition(3)
    got = observation_windows_by_hour(df, ["x", "absent"], obs=6, pred=4, chunk_hours=32).orderBy("window_id").collect()
    want = []
    for e in ("a", "b", "c"):
        mine = [r for r in rows if r[0] == e and r[1] is not None]
        lo, hi = min(r[1] for r in mine), max(r[1] for r in mine)
        for h in sorted({r[1] for r in mine}):
            if h > max(hi - 5, lo):
                continue
            x = [r[2] for r in mine if h <= r[1] <= h + 5 and r[2] is not None]
            ahead = [r[3] for r in mine if (h <= r[1] <= h + 5 if hi - lo + 1 < 6 else h + 6 <= r[1] <= h + 9)]
            want.append((e, h, np.mean(x) if x else None, np.std(x, ddof=1) if len(x) > 1 else 0.0, max(ahead, default=0)))
    assert len(got) == len(want) and [r.window_id for r in got] == list(range(len(want)))
    for r, (e, h, mean, std, label) in zip(got, want):
        assert (r.patient_id, r.start_hour, r.label) == (e, h, label)
        assert r.x_mean == (None if mean is None else pytest.approx(mean)) and r.x_std == pytest.approx(std)


def test_tables_of_windows_are_not_broadcast(spark):
    """A table with a row or more per window grows with the stream, so no join may send it through the driver."""
    scores = spark.createDataFrame([(0, "f", 1.0)], "window_id long, feature string, sadi double")
    psi = scores.withColumnRenamed("sadi", "psi")
    w1 = spark.createDataFrame([(0, 0.5)], "window_id long, w1 double")
    plan = I.d_total(scores, psi, w1, ["window_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2


def test_stages_are_written_smaller(spark, tmp_path):
    """Stage tables keep their rows in less room than by the session's codec."""
    from pathlib import Path

    from tidewatch.functions.runtime import SMALL, materialize

    def room(df):
        return sum(Path(f.removeprefix("file://")).stat().st_size for f in df.inputFiles())

    rows = spark.range(0, 60_000, 1, 2).select((F.col("id") * 1e-3).alias("x"), F.sqrt("id").alias("y"))
    plain, small = materialize(rows, "plain"), materialize(rows, "small", **SMALL)
    assert room(small) < room(plain)
    assert small.exceptAll(plain).count() == 0 and small.count() == 60_000

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import divergence as D

W = ["w"]


def long(spark, parts):
    """parts: {(window, feature): values}; NaN becomes NULL."""
    rows = [(w, f, None if v != v else float(v)) for (w, f), vs in parts.items() for v in vs]
    return spark.createDataFrame(rows, "w long, feature string, value double")


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(5)
    ref = {"a": rng.normal(size=400), "b": rng.integers(0, 6, 400).astype(float), "c": np.full(50, 2.0)}
    cur = {
        (0, "a"): rng.normal(size=120), (1, "a"): rng.normal(1.0, 1.0, 90), (0, "b"): rng.integers(0, 6, 150).astype(float),
        (1, "b"): rng.integers(3, 9, 80).astype(float), (0, "c"): np.full(20, 2.0), (1, "c"): np.array([np.nan] * 5),
    }
    r = long(spark, {(0, f): v for f, v in ref.items()}).drop("w")
    return ref, cur, r, long(spark, cur), D.distribution_profile(r)


def ecdf_gap(a, b):
    grid = np.sort(np.concatenate([a, b]))
    f, g = np.searchsorted(np.sort(a), grid, "right") / len(a), np.searchsorted(np.sort(b), grid, "right") / len(b)
    return np.abs(f - g).max(), np.sum(np.abs(f - g)[:-1] * np.diff(grid))


@pytest.mark.parametrize("bounded", [True, False])
def test_ks_and_wasserstein_match_numpy(many_blocks, sides, bounded):
    ref, cur, _, c, prof = sides
    ks = {(r.w, r.feature): r for r in D.ks_test(c, prof, W, bounded=bounded).collect()}
    w1 = {(r.w, r.feature): r.w1 for r in D.wasserstein(c, prof, W, bounded=bounded).collect()}
    for (w, f), v in cur.items():
        if np.isnan(v).all():
            assert ks[w, f].p_value == 1.0 and ks[w, f].status == "empty" and w1[w, f] == 0.0
            continue
        d, area = ecdf_gap(ref[f], v)
        assert ks[w, f].statistic == pytest.approx(d, abs=1e-12)
        assert w1[w, f] == pytest.approx(area, abs=1e-10)
    assert ks[1, "a"].flagged and ks[1, "a"].p_value < 1e-6 and not ks[0, "c"].flagged


@pytest.mark.parametrize("variant,eps", [("detector", 1e-6), ("index", 1e-10), ("additive", 1e-6)])
def test_psi_variants_match_numpy(spark, sides, variant, eps):
    ref, cur, _, c, prof = sides
    got = {(r.w, r.feature): r for r in D.psi(c, prof, W, variant=variant).collect()}
    for (w, f), v in cur.items():
        if f == "c":
            assert got[w, f].psi == 0.0
            continue
        edges = np.linspace(min(ref[f].min(), v.min()), max(ref[f].max(), v.max()), 11)
        edges[-1] += 1e-9
        a, b = np.histogram(ref[f], edges)[0], np.histogram(v, edges)[0]
        if variant == "additive":
            p, q = a / len(ref[f]) + eps, b / len(v) + eps
        else:
            p, q = (a + eps) / (len(ref[f]) + 10 * eps), (b + eps) / (len(v) + 10 * eps)
        assert got[w, f].psi == pytest.approx(np.sum((q - p) * np.log(q / p)), abs=1e-9)
        assert got[w, f].psi >= 0
    assert got[1, "a"].flagged


def test_identical_samples_have_no_drift(spark, sides):
    ref, _, r, _, prof = sides
    same = r.withColumn("w", F.lit(0).cast("long")).select("w", "feature", "value")
    assert all(x.psi == pytest.approx(0, abs=1e-12) for x in D.psi(same, prof, W).collect())
    assert all(x.statistic == 0 and x.p_value == 1 for x in D.ks_test(same, prof, W).collect())
    assert all(x.w1 == pytest.approx(0, abs=1e-12) for x in D.wasserstein(same, prof, W).collect())


def test_wasserstein_of_a_shift_is_the_shift(spark, sides):
    ref, _, _, _, prof = sides
    moved = long(spark, {(0, "a"): ref["a"] + 2.5, (1, "a"): ref["a"] - 0.75})
    got = {x.w: x.w1 for x in D.wasserstein(moved, prof, W).collect()}
    assert got[0] == pytest.approx(2.5) and got[1] == pytest.approx(0.75)


def test_fixed_edges_clip_outliers_into_end_bins(spark, sides):
    ref, _, _, _, prof = sides
    far = long(spark, {(0, "a"): np.full(10, 99.0)})
    joint = D.psi(far, prof, W).first().psi
    fixed = D.psi_cells(far, prof, W, edges="reference").first()
    assert fixed["_c9"] == 10 and joint > 0


def test_kl_guards_and_value(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=300)
    ref = long(spark, {(0, "v"): base, (0, "k"): np.full(9, 1.0), (0, "few"): base[:3]}).drop("w")
    parts = {(0, "v"): rng.normal(0.5, 1.2, 200), (1, "v"): np.full(8, 3.0), (0, "k"): np.full(7, 1.0), (1, "k"): np.full(7, 2.0),
             (0, "few"): base[:50]}
    got = {(r.w, r.feature): r.kl for r in D.kl_kde(long(spark, parts), ref, W).collect()}
    assert got[1, "v"] == 5.0 and got[0, "k"] == 0.0 and got[1, "k"] == 10.0 and got[0, "few"] == 0.0
    v = parts[0, "v"]
    lo, hi = min(base.min(), v.min()), max(base.max(), v.max())
    m = 0.1 * (hi - lo + 1e-10)
    grid = np.linspace(lo - m, hi + m, 100)

    def kde(x):
        h = x.std(ddof=1) * len(x) ** -0.2
        d = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        d = np.maximum(d, 1e-10)
        return d / d.sum()

    p, q = kde(base), kde(v)
    assert got[0, "v"] == pytest.approx(np.sum(p * np.log(p / q)), rel=1e-9)


def test_kl_of_heavy_tails_equals_the_exact_kernel_sum(spark):
    """Most values lie within a small part of the range, and far values must neither widen nor hide them."""
    rng = np.random.default_rng(18)
    draw = {"lognormal": lambda n: rng.lognormal(0, 2.5, n), "t2": lambda n: rng.standard_t(2, n), "pareto": lambda n: rng.pareto(1.1, n), "ties": lambda n: rng.integers(0, 4, n).astype(float)}
    ref, parts = {(0, f): d(1500) for f, d in draw.items()}, {}
    for w in range(3):
        parts |= {(w, f): d(400) * (1 + 0.2 * w) + 0.1 * w for f, d in draw.items()}
    got = {(r.w, r.feature): r.kl for r in D.kl_kde(long(spark, parts), long(spark, ref).drop("w"), W).collect()}
    for (w, f), v in parts.items():
        base = ref[0, f]
        lo, hi = min(base.min(), v.min()), max(base.max(), v.max())
        grid = np.linspace(lo - 0.1 * (hi - lo + 1e-10), hi + 0.1 * (hi - lo + 1e-10), 100)
        d = []
        for x in (base, v):
            h = x.std(ddof=1) * len(x) ** -0.2
            y = np.maximum(np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi)), 1e-10)
            d.append(y / y.sum())
        assert got[w, f] == pytest.approx(np.sum(d[0] * np.log(d[0] / d[1])), rel=1e-8, abs=1e-12), (w, f)


def test_auto_drift_picks_tests_by_type(spark):
    rng = np.random.default_rng(9)
    ref = {"num": rng.normal(size=500), "bin": rng.integers(0, 2, 500), "cat": rng.integers(0, 4, 500)}
    r = long(spark, {(0, f): v for f, v in ref.items()}).drop("w")
    cur = {(0, "num"): rng.normal(2, 1, 300), (0, "bin"): np.ones(300), (0, "cat"): rng.choice([0, 9], 300),
           (1, "num"): ref["num"][:300], (1, "bin"): ref["bin"][:300], (1, "cat"): ref["cat"][:300]}
    got = {(x.w, x.feature): x for x in D.auto_drift(long(spark, cur), D.distribution_profile(r), W).collect()}
    assert {f: got[0, f].test for f in ref} == {"num": "ks", "bin": "z", "cat": "chi2"}
    assert all(got[0, f].flagged for f in ref) and not any(got[1, f].flagged for f in ref)


def test_more_shift_gives_more_drift(spark, sides):
    ref, _, _, _, prof = sides
    steps = long(spark, {(i, "a"): ref["a"] + 0.4 * i for i in range(4)})
    for table, col in ((D.psi(steps, prof, W), "psi"), (D.ks_test(steps, prof, W), "statistic"), (D.wasserstein(steps, prof, W), "w1")):
        vals = [x[col] for x in table.orderBy("w").collect()]
        assert vals == sorted(vals) and vals[-1] > vals[0]


def test_bonferroni_divides_by_features(spark, sides):
    _, _, _, c, prof = sides
    plain = D.ks_test(c, prof, W).filter("flagged").count()
    strict = D.ks_test(c, prof, W, correction="bonferroni").filter("flagged").count()
    assert strict <= plain
    assert pd.DataFrame(D.ks_share(D.ks_test(c, prof, W), W).collect()).shape[0] == 2


def test_summary_names_the_methods_that_fired(spark, sides):
    _, _, _, c, prof = sides
    table = D.detector_summary({"ks": D.ks_test(c, prof, W), "psi": D.psi(c, prof, W)}, W)
    got = {r.w: r for r in D.any_drift(table, W).collect()}
    assert got[1].any_drift_detected and got[1].methods_reporting_drift == ["ks", "psi"]
    assert not got[0].any_drift_detected and got[0].methods_reporting_drift == []


def test_kl_against_the_window_before(spark):
    rng = np.random.default_rng(21)
    parts = {(w, f): rng.normal(0.3 * w, 1 + 0.1 * w, 150 + 20 * w) for w in range(4) for f in ("a", "b")}
    parts[2, "b"] = np.full(40, 1.5)
    cur = long(spark, parts)
    got = {(r.w, r.feature): r.kl for r in D.kl_previous(cur, "w").collect()}
    assert set(got) == {(w, f) for w in (1, 2, 3) for f in ("a", "b")} and got[2, "b"] == got[3, "b"] == 5.0
    for w in (1, 2, 3):
        ref = long(spark, {(0, f): parts[w - 1, f] for f in ("a", "b")}).drop("w")
        fixed = {r.feature: r.kl for r in D.kl_kde(cur.filter(F.col("w") == w), ref, W).collect()}
        assert all(got[w, f] == pytest.approx(fixed[f], rel=1e-9, abs=1e-12) for f in ("a", "b"))


def test_kl_of_whole_windows_is_the_general_one(spark, monkeypatch):
    """One pass a window, reference cells by groups of windows: heavy tails, gaps, constant and missing sides."""
    monkeypatch.setattr(D, "WINDOWS_TOGETHER", 2)  # several groups of windows
    rng = np.random.default_rng(8)
    ref = {"a": rng.normal(size=500), "b": rng.standard_cauchy(300), "c": np.full(40, 2.0), "d": np.array([1.0, 2.0, 3.0])}
    rows, parts = [], {}
    for w in range(9):
        n = 3 if w == 8 else 60
        cols = {"a": rng.normal(w / 4, 1, n), "b": rng.standard_cauchy(n) * 10**w, "c": np.full(n, 2.0 + (w % 2)), "d": rng.normal(size=n)}
        if w == 7:
            cols["a"] = np.full(n, np.nan)
        cols["b"][::5] = np.nan
        rows += [(w, *[None if v != v else float(v) for v in r]) for r in zip(*cols.values())]
        parts |= {(w, f): v for f, v in cols.items()}
    wide = spark.createDataFrame(rows, "w long, a double, b double, c double, d double")
    r = long(spark, {(0, f): v for f, v in ref.items()}).drop("w")
    want = {(x.w, x.feature): x.kl for x in D.kl_kde(long(spark, parts), r, W).collect()}
    found = D.kl_windows(wide, r, W, ["a", "b", "c", "d"])
    assert found.columns == ["w", "feature", "kl"]
    got = {(x.w, x.feature): x.kl for x in found.collect()}
    assert set(got) == set(want) and max(want.values()) > 1
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9), k
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_kernel_sums" not in plan and " add(" not in plan  # no block of cells is copied per window


def test_psi_shuffles_counts_and_not_values(spark):
    """Few groups of many rows: values are binned where they lie, also next to NULL values and NULL keys."""
    ref = spark.createDataFrame([("f", float(i)) for i in range(100)], "feature string, value double")
    rows = [(k, "f", float(v) if v % 7 else None) for k in ("a", "b", None) for v in range(200)]
    cur = spark.createDataFrame(rows, "k string, feature string, value double")
    cells = D.psi_cells(cur, D.distribution_profile(ref), ["k"])
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*value#", plan)
    got = {r["k"]: r for r in cells.collect()}
    assert [sum(got["a"][f"_c{i}"] for i in range(10)), got["a"]["n_cur"], got[None]["n_cur"]] == [171, 171, 0]
    both = {r["k"]: r for r in D.psi_both(cells, ["k"]).collect()}
    index = {r["k"]: r["psi"] for r in D.psi_score(cells, ["k"], variant="index").collect()}
    assert both["b"]["psi_index"] == index["b"] and both["b"]["psi"] > 0.2


@pytest.mark.parametrize(("n", "points", "scale"), [(1000, 100, 1.0), (7, 100, 1.0), (1500, 101, 1.0), (1000, 100, 1e6), (1000, 3, 1.0)])
def test_kernels_share_exponentials(n, points, scale, monkeypatch):
    """Sums equal the plain ones, a far value included, and steps below a bandwidth take far fewer exponentials."""
    r = np.random.default_rng(n + points)
    x = r.normal(size=n)
    x[0] *= scale
    at, h = np.linspace(x.min() - 0.5, x.max() + 0.5, points), n**-0.2
    want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1)
    made, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda z, *a, **k: made.append(np.size(z)) or exp(z, *a, **k))
    got = D._kernels_at(at, x, h)
    assert np.allclose(got, want, rtol=1e-11, atol=1e-200)
    if scale == 1.0 and points >= 100 and n >= 1000:
        assert sum(made) < n * points / 4


def test_stream_rows_are_explained_before_windows_multiply_them(spark):
    """Cutting explained rows into windows gives the components of window rows, a missing value and a row without index included."""
    from tidewatch.operators.windows import count_windows
    from tidewatch.plans import model as M
    from tidewatch.plans import monitor

    r = np.random.default_rng(11)
    pdf = pd.DataFrame({f: np.round(r.normal(M.CENTER[f], M.SCALE[f], 260), 4) for f in M.FEATURES}).assign(row_idx=np.arange(260))
    rows = spark.createDataFrame(pdf).withColumn("qty_std", F.when(F.col("row_idx") % 9 > 0, F.col("qty_std")))
    rows = rows.unionByName(rows.filter("row_idx = 3").withColumn("row_idx", F.lit(None).cast("long")))
    cut = lambda df: count_windows(df, 80, 40)
    ref = rows.filter("row_idx < 100")
    got = monitor.components(ref, rows, ["window_id"], cut=cut).toPandas().sort_values(["window_id", "feature"], ignore_index=True)
    want = monitor.components(ref, cut(rows), ["window_id"]).toPandas().sort_values(["window_id", "feature"], ignore_index=True)
    assert len(want) == 7 * len(M.FEATURES)
    pd.testing.assert_frame_equal(got, want)

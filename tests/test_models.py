import itertools
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.runtime import scratch_dir
from tidewatch.operators import adversarial as AD
from tidewatch.operators import adwin as AW
from tidewatch.operators import cleaning as C
from tidewatch.operators import impute as IM
from tidewatch.operators import modeling as ML
from tidewatch.operators import tree_attribution as TA
from tidewatch.operators import windows as W

FEATS = ["a", "b", "c", "d"]


def table(spark, n=300, seed=3, holes=0.0):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame(rng.normal(size=(n, 4)), columns=FEATS)
    y = (x["a"] + x["b"] * x["c"] + rng.normal(0, 0.5, n) > 0.4).astype(int)
    x = x.mask(rng.random(x.shape) < holes)
    x.insert(0, "row_idx", np.arange(n))
    x["y"] = y
    df = spark.createDataFrame(x)
    return x, df.select("row_idx", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in FEATS], "y")


@pytest.mark.parametrize("block_rows", [20000, 40])
def test_knn_matches_brute_force(spark, block_rows):
    pdf, df = table(spark, 120, holes=0.2)
    got = IM.knn_impute(df, df, "row_idx", FEATS, 3, block_rows).toPandas().set_index("row_idx").sort_index()
    x = pdf[FEATS].to_numpy()
    for i, j in zip(*np.where(np.isnan(x))):
        best = []
        for d in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[d])
            if d != i and not np.isnan(x[d, j]) and both.any():
                best.append((round(np.sqrt(4 / both.sum() * np.sum((x[i, both] - x[d, both]) ** 2)), 9), d))
        near = [d for _, d in sorted(best)[:3]]
        want = x[near, j].mean() if near else np.nanmean(x[:, j])
        assert got[FEATS[j]].loc[i] == pytest.approx(want)
    empty = IM.knn_impute(df.withColumn("d", F.lit(None).cast("double")), df.withColumn("d", F.lit(None).cast("double")), "row_idx", FEATS)
    assert empty.agg(F.max("d"), F.min("d")).first()[:] == (0.0, 0.0)


@pytest.fixture(scope="module")
def fitted(spark):
    pdf, df = table(spark)
    split = ML.stratified_split(df, "y", "row_idx")
    return pdf, df, split, ML.train_gbt(split, FEATS, "y", trees=5, depth=3)


def test_split_is_stratified_and_repeatable(fitted):
    _, df, split, _ = fitted
    counts = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        assert counts[y, "val"] == int(0.2 * (counts[y, "val"] + counts[y, "train"]))
    again = ML.stratified_split(df.repartition(5), "y", "row_idx")
    key = lambda d: sorted((r.row_idx, r.split) for r in d.collect())
    assert key(split) == key(again)


def test_training_without_positives_fails(spark):
    _, df = table(spark, 40)
    with pytest.raises(ValueError):
        ML.train_lr(df.withColumn("y", F.lit(0)), FEATS, "y")


def test_tree_attributions_are_exact(spark, fitted):
    pdf, df, _, model = fitted
    gbt = model.stages[-1]
    leaves = TA.leaf_paths(gbt, spark, f"{scratch_dir(spark)}/trees-test")
    bg_df = df.filter("row_idx < 40")
    tables = TA.contribution_table(leaves, TA.background_masks(bg_df, FEATS, leaves))
    phi = TA.tree_attributions(df.filter("row_idx < 12"), ["row_idx"], FEATS, leaves, tables)
    got = phi.toPandas().pivot(index="row_idx", columns="feature", values="phi")[FEATS].to_numpy()
    x, bg = pdf[FEATS].to_numpy()[:12], pdf[FEATS].to_numpy()[:40]
    raw = ML.score(model, df.filter("row_idx < 12"), FEATS, ["row_idx"]).orderBy("row_idx").toPandas()["margin"]
    scale = raw.to_numpy() / TA.tree_margin(x, leaves)
    assert np.allclose(scale, scale[0])  # the model's margin is a multiple of the tree sum
    assert np.allclose(got.sum(1), TA.tree_margin(x, leaves) - TA.tree_margin(bg, leaves).mean())
    for i in range(4):
        for j in range(4):
            total = 0.0
            others = [k for k in range(4) if k != j]
            for r in range(4):
                for s in itertools.combinations(others, r):
                    with_j, without = bg.copy(), bg.copy()
                    with_j[:, list(s) + [j]] = x[i, list(s) + [j]]
                    without[:, list(s)] = x[i, list(s)]
                    gain = TA.tree_margin(with_j, leaves).mean() - TA.tree_margin(without, leaves).mean()
                    total += factorial(r) * factorial(3 - r) / factorial(4) * gain
            assert got[i, j] == pytest.approx(total, abs=1e-9)


def test_tree_attributions_cancel_over_their_own_background(spark, fitted, monkeypatch):
    _, df, _, model = fitted
    leaves = TA.leaf_paths(model.stages[-1], spark, f"{scratch_dir(spark)}/trees-test")
    rows = df.filter("row_idx < 50")
    tables = TA.contribution_table(leaves, TA.background_masks(rows, FEATS, leaves))
    whole = TA.tree_attributions(rows, ["row_idx"], FEATS, leaves, tables).toPandas()
    assert whole.groupby("feature")["phi"].mean().abs().max() < 1e-9
    monkeypatch.setattr(TA, "SENT_BYTES", 300)  # several parts
    parts = TA.tree_attributions(rows, ["row_idx"], FEATS, leaves, tables).toPandas()
    both = whole.merge(parts, on=["row_idx", "feature"])
    assert len(TA._parts(leaves)) > 3 and np.allclose(both["phi_x"], both["phi_y"])


def test_path_attributions_by_subsets(spark, fitted):
    """Brute force over coalitions; the value of one walks each tree, splitting by training weight outside it."""
    pdf, df, _, model = fitted
    leaves = TA.leaf_paths(model.stages[-1], spark, f"{scratch_dir(spark)}/trees-test")
    phi = TA.tree_attributions(df.filter("row_idx < 6"), ["row_idx"], FEATS, leaves, TA.path_tables(spark, leaves))
    got = phi.toPandas().pivot(index="row_idx", columns="feature", values="phi")[FEATS].to_numpy()
    trees, x = model.stages[-1].trees, pdf[FEATS].to_numpy()[:6]

    def weight(node):
        return float(node.impurityStats().stats()[0])

    def walk(node, row, known):
        if node.numDescendants() == 0:
            return node.prediction()
        f, low = node.split().featureIndex(), node.leftChild()
        if f in known:
            return walk(low if row[f] <= node.split().threshold() else node.rightChild(), row, known)
        share = weight(low) / (weight(low) + weight(node.rightChild()))
        return share * walk(low, row, known) + (1 - share) * walk(node.rightChild(), row, known)

    roots = [(t._java_obj.rootNode(), w) for t, w in zip(trees, model.stages[-1].treeWeights)]
    value = lambda row, known: sum(w * walk(r, row, known) for r, w in roots)
    for i in range(len(x)):
        for j in range(4):
            total = 0.0
            for r in range(4):
                for s in itertools.combinations([k for k in range(4) if k != j], r):
                    total += factorial(r) * factorial(3 - r) / factorial(4) * (value(x[i], {*s, j}) - value(x[i], set(s)))
            assert got[i, j] == pytest.approx(total, abs=1e-9)
        assert got[i].sum() == pytest.approx(value(x[i], {0, 1, 2, 3}) - TA.path_base(leaves), abs=1e-9)


def test_calibration_methods(fitted):
    _, _, split, model = fitted
    scored = ML.score(model, split, FEATS, ["row_idx", "split", "y"])
    val = scored.filter("split = 'val'")
    for method in ("sigmoid", "isotonic"):
        p = ML.calibrate(val, "y", method)(val).select("margin", "p", "y").toPandas().sort_values("margin")
        assert p["p"].between(0, 1).all() and (p["p"].diff().dropna() >= -1e-12).all()
        assert p["p"].mean() == pytest.approx(p["y"].mean(), abs=0.02)
    with pytest.raises(ValueError):
        ML.calibrate(val, "y", "other")


def test_adwin_finds_a_step_and_ignores_noise(spark):
    rng = np.random.default_rng(4)
    step = np.concatenate([rng.normal(0.2, 0.05, 500), rng.normal(0.7, 0.05, 500)])
    flat = rng.normal(0.2, 0.05, 1000)
    pdf = pd.DataFrame({"k": ["s"] * 1000 + ["f"] * 1000, "t": list(range(1000)) * 2, "v": np.concatenate([step, flat])})
    df = spark.createDataFrame(pdf).repartition(4)
    got = AW.adwin(df, ["k"], ["t"], "v").toPandas()
    s = got[got.k == "s"].sort_values("run")
    assert s["drift"].tolist() == AW.replay(pd.Series(step))
    first = s.loc[s.drift, "last_position"].min()
    assert 500 < first < 600 and not got.loc[got.k == "f", "drift"].any()
    coarse = AW.adwin(df, ["k"], ["t"], "v", grain=20).toPandas()
    assert coarse[coarse.k == "s"]["drift"].any() and not coarse[coarse.k == "f"]["drift"].any()
    assert len(coarse) == 100


def test_adversarial_scores_and_importance(spark):
    rng = np.random.default_rng(6)
    ref = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"])
    ref.insert(0, "i", np.arange(200))
    same, moved, tiny = (pd.DataFrame(rng.normal(size=(n, 2)), columns=["a", "b"]) for n in (150, 150, 3))
    moved["a"] += 3
    parts = []
    for w, p in enumerate((same, moved, tiny)):
        p.insert(0, "i", np.arange(len(p)))
        parts.append(p.assign(w=w))
    r, c = spark.createDataFrame(ref), spark.createDataFrame(pd.concat(parts))
    scores = AD.adversarial_scores(r, c, "w", "i", ["a", "b"], 3).collect()
    got = {x.w: x.adv_score for x in scores}
    assert {x.w: x.status for x in scores} == {0: "ok", 1: "ok", 2: "too_small"}
    assert 0.35 < got[0] < 0.65 and got[1] > 0.95 and got[2] == 0.5
    imp = {(x.w, x.feature): x.importance for x in AD.adversarial_importance(r, c, "w", "i", ["a", "b"]).collect()}
    assert imp[1, "a"] > 5 * imp[1, "b"] and imp[0, "a"] < 0.5


def test_domain_rows_fill_with_the_median_of_both_domains(spark):
    ref = spark.createDataFrame([(i, 100.0 + i if i % 2 else None, None) for i in range(8)], "i int, a double, b double")
    cur = spark.createDataFrame([(i, 110.0 if i % 2 else None, None, 0) for i in range(4)], "i int, a double, b double, w int")
    rows = AD.domain_rows(ref, cur, "w", "i", ["a", "b"], 2).toPandas()
    known = [101.0, 103.0, 105.0, 107.0, 110.0, 110.0]
    want = np.array(known + [np.median(known)] * 6)
    want = (want - want.mean()) / want.std()
    assert np.allclose(np.sort(rows["a"]), np.sort(want)) and (rows["b"] == 0).all()


def test_cleaning_guards(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1, 1.0, nan, None), (1, 2, inf, 2.0, None), (2, 1, None, 4.0, 5.0)], "id int, t int, x double, y double, z double")
    clean = C.null_non_finite(df, ["x", "y", "z"])
    assert [tuple(r) for r in clean.orderBy("id", "t").select("x", "y").collect()] == [(1.0, None), (None, 2.0), (None, 4.0)]
    kept, dropped = C.drop_high_missing(clean, 0.6, ("id",))
    assert dropped == ["x", "z"] or dropped == ["z", "x"] or dropped == ["x", "z"][:len(dropped)]
    filled = C.forward_fill(clean, ["x"], "id", "t").orderBy("id", "t").collect()
    assert [r.x for r in filled] == [1.0, 1.0, None]
    scaled = C.scale(clean, ["y"], C.fit_scaler(clean.filter("id = 9"), ["y"]))
    assert scaled.count() == 3
    const = C.fit_scaler(clean.select(F.lit(3.0).alias("k")), ["k"]).first()
    assert (const["mean"], const["scale"]) == (3.0, 1.0)
    aligned = C.align_columns(df, ["y", "nope"], ["id"])
    assert aligned.columns == ["id", "y", "nope"] and aligned.filter("nope is not null").count() == 0


def test_shift_spec_is_stable_and_phase_bound(spark):
    df = spark.range(500).select(
        F.col("id").alias("row_idx"), F.lit(10.0).alias("x_mean"), F.lit(None).cast("double").alias("x_std"), F.lit(0).alias("y"),
        F.when(F.col("id") < 250, "phase1").otherwise("phase3").alias("phase"),
    )
    spec = [C.Shift("phase3", "x", multiply=0.7, noise_std=0.1, component="low")]
    out = C.apply_shift_spec(df, spec, ["x_mean", "x_std"], label="y", flip=C.LabelFlip("phase3", 0.07))
    p = out.toPandas().set_index("row_idx").sort_index()
    q = C.apply_shift_spec(df.repartition(9), spec, ["x_mean", "x_std"], label="y", flip=C.LabelFlip("phase3", 0.07))
    pd.testing.assert_frame_equal(p, q.toPandas().set_index("row_idx").sort_index())
    assert (p["x_mean"][:250] == 10).all() and p["x_mean"][250:].mean() == pytest.approx(7.0, abs=0.03)
    assert p["x_mean"][250:].std() == pytest.approx(0.1, abs=0.02) and p["x_std"].isna().all()
    assert p["y"][:250].sum() == 0 and 5 < p["y"][250:].sum() < 35
    truth = C.drift_truth(spark, spec, ["x_mean", "x_std", "xy"]).collect()
    assert {r.column for r in truth} == {"x_mean", "x_std"}


def test_observation_windows_short_and_long(spark, monkeypatch):
    rows = [("a", h, float(h), int(h == 9)) for h in range(1, 13)] + [("b", h, float(h), int(h == 2)) for h in range(1, 4)]
    df = spark.createDataFrame(rows, "id string, t int, v double, y int")
    whole = W.observation_windows(df, ["v"], "id", "t", "y").orderBy("window_id").collect()
    assert [r.window_id for r in whole] == list(range(8)) and whole[-1].id == "b" and whole[-1].label == 1
    assert [r.label for r in whole[:7]] == [1, 1, 1, 0, 0, 0, 0]
    assert whole[0].v_mean == 3.5 and whole[0].v_std == pytest.approx(1.8708287)
    monkeypatch.setattr(W, "_CHUNK", 4)  # force chunk borders inside one entity
    cut = W.observation_windows(df, ["v"], "id", "t", "y", obs=2, pred=1).orderBy("window_id").collect()
    monkeypatch.setattr(W, "_CHUNK", 65536)
    one = W.observation_windows(df, ["v"], "id", "t", "y", obs=2, pred=1).orderBy("window_id").collect()
    assert cut == one
    with pytest.raises(ValueError):
        W.observation_windows(df, ["missing"], "id", "t", "y")


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_fitted_flow_finds_planted_weights(spark, method):
    from tidewatch.plans import fitted as FM

    rng = np.random.default_rng(5)
    n, names = 4000, ["a", "b"]
    x = pd.DataFrame({"row_idx": np.arange(n), "a": rng.normal(10, 2, n), "b": rng.normal(-3, 0.5, n)})
    eta = 1.2 * (x["a"] - 10) / 2 - 0.7 * (x["b"] + 3) / 0.5 - 1
    x["y"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    rows = ML.stratified_split(spark.createDataFrame(x), "y", "row_idx")
    model = FM.fit(rows, names, "y", method)
    assert model.weight["a"] == pytest.approx(1.2, abs=0.15) and model.weight["b"] == pytest.approx(-0.7, abs=0.15)
    got = model.score(rows.withColumn("p", F.lit(9.0))).toPandas()
    want = model.intercept + sum(model.weight[f] * (got[f] - model.center[f]) / model.scale[f] for f in names)
    assert np.allclose(got["margin"], want)
    # the class weights move the margin; the calibration moves the mean back
    held = got[got["split"] == "val"]
    assert abs(held["p"].mean() - held["y"].mean()) < 2e-3 and (1 / (1 + np.exp(-held["margin"]))).mean() > held["y"].mean() + 0.05
    assert held.sort_values("margin")["p"].is_monotonic_increasing


def test_first_flagged_features_follow_the_columns(spark):
    from tidewatch.operators import attribution as A

    rows = spark.createDataFrame([(1, f) for f in "dbac"] + [(1, "a"), (2, "c")], "w int, feature string")
    got = {r.w: r.f for r in A.first_features(rows, list("dcba"), 2, ["w"], "f").collect()}
    assert got == {1: ["d", "c"], 2: ["c"]}
    assert A.first_features(rows.filter("false"), ["a"], 2, ["w"], "f").count() == 0


def test_fit_over_pieces_of_rows():
    """A fit of more rows than one piece, a short last piece included, meets its first-order conditions in every fold."""
    r = np.random.default_rng(5)
    n = 2 * AD.ROWS_TOGETHER + 37
    d = AD.Domains(r.normal(size=(n, 3)), r.normal(size=(400, 3)) + 0.3, 3)
    train = (d.fold[None, :] != np.arange(d.k)[:, None]).astype(float)
    beta, done = d.fit(train)
    x = np.column_stack([np.ones(len(d.x)), d.x])
    for b, t in zip(beta, train):
        q = 1 / (1 + np.exp(-x @ b))
        ones = (t * d.y).sum()
        weight = t * np.where(d.y == 1, t.sum() / (2 * ones), t.sum() / (2 * (t.sum() - ones)))
        slope = x.T @ (weight * (d.y - q)) - np.array([1e-9, 1, 1, 1]) * b
        assert done and np.abs(slope).max() < 1e-6


def test_fit_of_many_rows_starts_near(monkeypatch):
    """The curvature of all rows is needed once, at the fit of some of them, and the fit is that of Newton steps from nothing."""
    r = np.random.default_rng(6)
    d = AD.Domains(r.normal(size=(12_000, 4)), r.normal(size=(700, 4)) * 1.2 + 0.2, 3)
    train = (d.fold[None, :] != np.arange(d.k)[:, None]).astype(float)
    monkeypatch.setattr(AD, "START_ROWS", 10**9)
    plain, _ = d.fit(train)
    monkeypatch.setattr(AD, "START_ROWS", 2000)
    sizes, whole = [], AD.Logits.at_point
    monkeypatch.setattr(AD.Logits, "at_point", lambda self, beta: sizes.append(sum(p[1].shape[1] for p in self.pieces)) or whole(self, beta))
    near, done = d.fit(train)
    assert done and sizes.count(12_700) == 1
    assert np.abs(near - plain).max() < 1e-9


def test_fit_that_does_not_settle_takes_newton_steps():
    x = np.vstack([np.ones(4000), np.r_[np.linspace(-1, -0.5, 2000), np.linspace(0.5, 1, 2000)]])
    y, weight = np.repeat([0.0, 1.0], 2000), np.ones((1, 4000))
    fits = AD.Logits(x, y, weight)
    far = np.array([[0.0, 40.0]])
    assert not fits.steady(far, 1e-8)[1]
    assert np.abs(fits.slope(fits.newton(np.zeros((1, 2)), 1e-8)[0])).max() < 1e-6

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewatch.operators import ordered as O


def skewed(n=900):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n))
    v = np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 50, n))
    return pd.DataFrame({"key": key, "t": rng.permutation(n), "v": v})


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))) if "v" in pdf else df


def test_row_index_is_the_sorted_position(many_blocks):
    pdf = skewed()
    got = O.row_index(frame(many_blocks, pdf), ["t"], total="all").toPandas()
    assert (got["row_idx"] == got["t"]).all() and (got["all"] == len(pdf)).all()


def test_running_totals_cross_block_borders(many_blocks):
    pdf = skewed()
    df = frame(many_blocks, pdf).fillna(0, ["v"])
    got = O.running_totals(df, ["key"], ["t"], {"s": F.col("v"), "n": F.lit(1)}, totals=True, following="t")
    assert O.into_blocks(df, ["key"], ["t"]).select(O.BLOCK).distinct().count() > 3
    got = got.toPandas().sort_values(["key", "t"])
    want = pdf.fillna({"v": 0}).sort_values(["key", "t"])
    g = want.groupby("key")
    assert np.allclose(got["s"], g["v"].cumsum())
    assert (got["n"].to_numpy() == g.cumcount().to_numpy() + 1).all()
    assert np.allclose(got["s_total"], g["v"].transform("sum"))
    nxt = g["t"].shift(-1)
    assert got["t_next"].fillna(-1).to_numpy().tolist() == nxt.fillna(-1).to_numpy().tolist()


def test_bounded_path_gives_the_same(many_blocks):
    df = frame(many_blocks, skewed()).fillna(0, ["v"])
    kw = dict(keys=["key"], order=["t"], sums={"s": F.col("v")}, totals=True, following="t")
    a, b = (O.running_totals(df, bounded=x, **kw).toPandas().sort_values("t").reset_index(drop=True) for x in (True, False))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False)


def test_last_known_keeps_leading_nulls(many_blocks):
    pdf = skewed()
    got = O.last_known(frame(many_blocks, pdf), ["key"], ["t"], ["v"]).toPandas().sort_values(["key", "t"])
    want = pdf.sort_values(["key", "t"])
    want["v"] = want.groupby("key")["v"].ffill()
    assert np.allclose(got["v"].fillna(-1), want["v"].fillna(-1))


def test_asof_lookup_both_directions(many_blocks):
    rng = np.random.default_rng(2)
    table = pd.DataFrame({"f": "x", "at": np.sort(rng.choice(200, 60, replace=False)).astype(float)})
    table["val"] = np.arange(60)
    query = pd.DataFrame({"f": "x", "q": np.repeat(rng.integers(-5, 205, 50), 4).astype(float), "id": np.arange(200)})
    q, t = many_blocks.createDataFrame(query), many_blocks.createDataFrame(table)
    for forward in (False, True):
        got = O.asof_lookup(q, t, ["f"], "q", "at", ["val"], ["id"], forward).toPandas().sort_values("id")
        direction = "forward" if forward else "backward"
        want = pd.merge_asof(
            query.sort_values("q"), table, left_on="q", right_on="at", by="f", direction=direction
        ).sort_values("id")
        assert got["val"].fillna(-1).tolist() == want["val"].fillna(-1).tolist()


def test_exact_quantiles_interpolate(many_blocks):
    pdf = skewed()
    got = O.exact_quantiles(frame(many_blocks, pdf), ["key"], "v", {"a": 0.25, "m": 0.5}).toPandas().set_index("key")
    want = pdf.groupby("key")["v"].quantile([0.25, 0.5]).unstack()
    assert np.allclose(got["a"], want[0.25].loc[got.index]) and np.allclose(got["m"], want[0.5].loc[got.index])


def test_results_do_not_depend_on_input_layout(many_blocks):
    pdf = skewed()
    a = O.last_known(frame(many_blocks, pdf), ["key"], ["t"], ["v"])
    b = O.last_known(frame(many_blocks, pdf.sample(frac=1, random_state=3)).repartition(7), ["key"], ["t"], ["v"])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_null_key_over_many_blocks(many_blocks):
    """A NULL group is carried from block to block like any other."""
    rows = [(None, i, float(i) if i % 100 == 0 else None) for i in range(2000)]
    df = many_blocks.createDataFrame(rows, "k string, t long, v double")
    got = O.grouped_index(df, ["k"], ["t"], totals=True).orderBy("t").collect()
    assert [r.rn for r in got] == list(range(1, 2001)) and {r.rn_total for r in got} == {2000}
    filled = O.last_known(df, ["k"], ["t"], ["v"]).orderBy("t").collect()
    assert [r.v for r in filled] == [float(i // 100 * 100) for i in range(2000)]


def test_lookup_carries_a_double_position_once(spark, monkeypatch):
    written, plain = [], O.materialize
    monkeypatch.setattr(O, "materialize", lambda df, *label, **options: written.append(df.columns) or plain(df, *label, **options))
    table = spark.createDataFrame([(1.0, 10), (2.0, 20)], "t double, v int")
    for kind, want in (("double", []), ("int", ["_at"])):  # another type needs its own column to compare with
        asked = spark.createDataFrame([(0,), (1,), (3,), (None,)], f"x {kind}" if kind == "int" else "x int").select(F.col("x").cast(kind).alias("x"))
        got = O.asof_lookup(asked, table, [], "x", "t", ["v"], [])
        assert got.dtypes == [("x", kind), ("v", "int")]
        assert {r.x: r.v for r in got.collect()} == {None: None, 0: None, 1: 10, 3: 20}
        assert [c for c in written[-1] if c == "_at"] == want

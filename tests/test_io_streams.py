import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import attribution as A
from tidewatch.sources import bundles as B
from tidewatch.sources import readings as S
from tidewatch.streaming import monitor as SM
from tidewatch.streaming import stateful as SS
from tidewatch.streaming import windows as SW
from tidewatch.streaming.runner import END_OF_STREAM, file_stream, run_closed, run_to_table

HEAD = "HR|O2Sat|Age|Gender|ICULOS|SepsisLabel"


def test_psv_folder(spark, tmp_path):
    (tmp_path / "p2.psv").write_text(f"{HEAD}\n80|NaN|60|1|1|0\n81|97|60|1|2|1\n")
    (tmp_path / "p1.psv").write_text(f"{HEAD}\n70|95|50|0|1|0\nbroken|x|50|0|2|0\n")
    rows, rejects = S.read_psv(spark, str(tmp_path))
    got = rows.orderBy("patient_id", "ICULOS").collect()
    assert [(r.patient_id, r.HR, r.O2Sat, r.SepsisLabel) for r in got] == [("p1", 70.0, 95.0, 0), ("p2", 80.0, None, 0), ("p2", 81.0, 97.0, 1)]
    assert [r.patient_id for r in rejects.collect()] == ["p1"]
    assert dict(rows.dtypes)["Gender"] == "int"
    first, _ = S.read_psv(spark, str(tmp_path), max_entities=1)
    assert {r.patient_id for r in first.collect()} == {"p1"}
    with pytest.raises(Exception):
        S.read_psv(spark, str(tmp_path / "none"))


def test_psv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a 1.psv").write_text("HR|Temp|ICULOS\n70|36.5|1\n71||2\n\n")
    (tmp_path / "b.psv").write_text("Temp|HR|ICULOS\n37|90|1\n38|91\n39|92|2|7\n")
    (tmp_path / "c.psv").write_text("HR|Temp|ICULOS\n60|36|1\n")
    (tmp_path / "d.psv").write_text("HR|Lactate|ICULOS\n80|1.5|1\n")
    (tmp_path / "e.psv").write_text("HR|Temp|ICULOS\n")
    rows, rejects = S.read_psv(spark, str(tmp_path))
    assert rows.columns == ["HR", "Temp", "ICULOS", "Lactate", "patient_id"]
    got = [tuple(r) for r in rows.orderBy("patient_id", "ICULOS").collect()]
    assert got == [
        (70.0, 36.5, 1, None, "a 1"), (71.0, None, 2, None, "a 1"), (90.0, 37.0, 1, None, "b"), (60.0, 36.0, 1, None, "c"),
        (80.0, None, 1, 1.5, "d"),
    ]
    assert sorted(r.line for r in rejects.collect()) == ["38|91", "39|92|2|7"]


def test_psv_files_are_opened_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("b", None, 2)], "patient_id string, HR double, ICULOS int")
    S.write_psv(df, str(tmp_path / "out"), 2)
    rows, rejects = S.read_psv(spark, str(tmp_path / "out"), layout="folders")
    assert not any(str(tmp_path) in f for df in (rows, rejects) for f in df.inputFiles())
    assert sorted((r.patient_id, r.HR, r.ICULOS) for r in rows.fillna(-1.0).collect()) == [("a", 1.0, 1), ("b", -1.0, 2), ("b", 2.0, 1)]


def test_upload_formats(spark, tmp_path):
    (tmp_path / "h.csv").write_text("PatientID,HR,Gender\n7,80,1\n")
    df, kind = S.read_upload(spark, str(tmp_path / "h.csv"))
    assert kind == "hourly" and df.first().patient_id == "7"
    assert S.detect_format(["HR_mean"]) == "patient_level" and S.detect_format(["z"]) == "unknown"
    (tmp_path / "u.csv").write_text("foo\n1\n")
    with pytest.raises(ValueError):
        S.read_upload(spark, str(tmp_path / "u.csv"))
    with pytest.raises(ValueError):
        S.unify_entity(spark.range(1))


def test_psv_lines_equal_to_the_header_are_no_headers(spark, tmp_path, monkeypatch):
    (tmp_path / "a.psv").write_text("HR|ICULOS\n70|1\nHR|ICULOS\n71|2\n")
    rows, rejects = S.read_psv(spark, str(tmp_path))
    assert sorted(r.HR for r in rows.collect()) == [70.0, 71.0] and [r.line for r in rejects.collect()] == ["HR|ICULOS"]
    (tmp_path / "b.psv").write_text("1|2\n")
    monkeypatch.setattr(S, "MOST_HEADERS", 1)
    with pytest.raises(ValueError, match="header"):
        S.read_psv(spark, str(tmp_path))


@pytest.mark.parametrize("parts", [1, 3])
def test_psv_round_trip(spark, tmp_path, parts):
    rows = [("p 1", 70.5, None, 1), ("p 1", None, None, 2), ("q", 1.0, 2.0, 1), ("q", 1.0, 2.0, 1), ("r", None, None, None)]
    df = spark.createDataFrame(rows, "patient_id string, HR double, Temp double, ICULOS int")
    S.write_psv(df, str(tmp_path / "out"), parts)
    back, rejects = S.read_psv(spark, str(tmp_path / "out"), layout="folders")
    assert sorted(map(str, (tuple(r) for r in back.select(*df.columns).collect()))) == sorted(map(str, rows)) and rejects.count() == 0


def test_upload_rejects(spark, tmp_path):
    (tmp_path / "h.csv").write_text("pid,HR,Gender\n7,80,1\n8,high,0\n9,60\n10,,1\n")
    df, rejects, kind = S.read_upload_checked(spark, str(tmp_path / "h.csv"))
    assert kind == "hourly" and df.columns == ["patient_id", "HR", "Gender"]
    assert {(r.patient_id, r.HR, r.Gender) for r in df.collect()} == {("7", 80.0, 1), ("8", None, 0), ("9", 60.0, None), ("10", None, 1)}
    assert sorted(r.line for r in rejects.collect()) == ["8,high,0", "9,60"]
    (tmp_path / "e.csv").write_text("pid,HR\n")
    df, rejects, _ = S.read_upload_checked(spark, str(tmp_path / "e.csv"))
    assert df.count() == rejects.count() == 0


def test_metrics_and_truth_come_back_from_the_tree(spark, tmp_path):
    nums = [('m "1"', 0.82631, 0.9, 0.1, 0.4), ("m2", None, None, 0.2, None)]
    metrics = spark.createDataFrame(nums, "model string, auprc double, auroc double, brier_score double, optimal_threshold double")
    lines = [('m "1"', "0", 0.9, 0.8, 0.85, 10), ('m "1"', "macro avg", 0.5, 0.5, 0.5, 20), ('m "1"', "accuracy", 0.75, 0.75, 0.75, 20)]
    report = spark.createDataFrame(lines, "model string, class string, precision double, recall double, f1_score double, support long")
    B.write_metrics(metrics, report, str(tmp_path), "run_z")
    truth = spark.createDataFrame([("c1", "b", "p", "k")], "column string, base_feature string, phase string, component string")
    B.write_truth(truth, str(tmp_path / "run_z" / "drift_ground_truth.json"))
    got = B.load_bundle(spark, str(tmp_path))
    assert sorted((r.run_id, r.model, r.auprc, r.brier_score) for r in B.model_metrics(got["baseline"]).collect()) == [("run_z", 'm "1"', 0.8263, 0.1), ("run_z", "m2", None, 0.2)]
    classes = {r["class"]: r for r in B.class_metrics(got["baseline"]).collect()}
    assert classes["0"].f1_score == 0.85 and classes["0"].support == 10 and classes["accuracy"].value == 0.75 and len(classes) == 3
    assert [tuple(r) for r in got["drift_gt"].collect()] == [("run_z", "c1", "b", "p", "k")]


def test_bundle_tree(spark, tmp_path):
    run = tmp_path / "run_x"
    (run / "tables").mkdir(parents=True)
    cols = [c.split()[0] for c in B.RESULTS_SCHEMA.split(", ")]
    vals = ["0", "0", "phase1", "0.1", "0.2", "0.5", "0.06", "0.0", "0.8", "0.8", "0", "NO_ACTION", '"[""HR_mean"", ""pH_std""]"', "False", "True", "[]", '"[""a""]"', "0.01", "0.02", "100"]
    (run / "x_results.csv").write_text(",".join(cols) + "\n" + ",".join(vals) + "\n")
    (run / "alert_log.json").write_text(json.dumps([{"window_idx": 3, "phase": "phase2", "level": 2, "action": "RECALIBRATE", "alert_text": "t"}]))
    (run / "drift_ground_truth.json").write_text(json.dumps({"HR_mean": {"base_feature": "HR", "phase": "phase2", "component": "c"}}))
    report = {"0": {"precision": 0.9, "recall": 0.8, "f1-score": 0.85, "support": 10.0}, "accuracy": 0.9}
    (run / "baseline_metrics.json").write_text(json.dumps({"m": {"auprc": 0.82631, "auroc": 0.9, "brier_score": 0.1, "optimal_threshold": 0.4, "classification_report": report}}))
    (run / "tables" / "table4_fairness.csv").write_text("Phase,Mean_DPD,Max_DPD,Mean_EOD,Max_EOD\nphase1,0.1,0.2,0.3,0.4\n")
    got = B.load_bundle(spark, str(tmp_path))
    r = got["results"].first()
    assert (r.run_id, r.top_sadi_features, r.psi_detected, r.ks_flagged_features) == ("run_x", ["HR_mean", "pH_std"], True, [])
    a = got["alerts"].first()
    assert (a.run_id, a.level, a.D_total) == ("run_x", 2, None)
    assert got["drift_gt"].first()["column"] == "HR_mean" and got["table4"].first().Max_EOD == 0.4
    assert got["stat_sig"].count() == 0 and got["table1"].count() == 0
    assert B.model_metrics(got["baseline"]).first().auprc == 0.8263
    cls = {x["class"]: x for x in B.class_metrics(got["baseline"]).collect()}
    assert cls["0"].f1_score == 0.85 and cls["accuracy"].value == 0.9


def test_sinks_round_trip(spark, tmp_path):
    phi = spark.createDataFrame([("a", 0.5), ("a", -0.1), ("b", 0.2)], "feature string, phi double")
    B.save_fingerprint(A.fingerprint(phi), phi, str(tmp_path / "fp"))
    summary, values = B.load_fingerprint(spark, str(tmp_path / "fp"))
    assert summary.count() == 2 and values.count() == 3
    B.write_json(spark.createDataFrame([(1, ["x"])], "w int, f array<string>"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().f == ["x"]
    truth = spark.createDataFrame([("c1", "b", "p", "k")], "column string, base_feature string, phase string, component string")
    B.write_truth(truth, str(tmp_path / "t"))
    text = spark.read.text(str(tmp_path / "t")).first().value
    assert json.loads(text) == {"c1": {"base_feature": "b", "phase": "p", "component": "k"}}
    B.write_table(phi.withColumn("run_id", F.lit("r")), str(tmp_path / "p"), ["run_id"])
    B.write_csv(phi, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def put(spark, folder, name, rows):
    """One parquet file per call, in arrival order."""
    os.makedirs(folder, exist_ok=True)
    pd.DataFrame(rows, columns=["k", "ts", "value"]).assign(ts=lambda d: pd.to_datetime(d["ts"]).astype("datetime64[us]")).to_parquet(f"{folder}/{name}.parquet")


SCHEMA = "k long, ts timestamp_ntz, value double"


def test_late_rows_are_dropped_and_restart_continues(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, "a", [(1, "2024-01-01 10:00", 1.0), (1, "2024-01-05 10:00", 9.0)])
    ref = spark.createDataFrame([("value", float(v)) for v in range(11)], "feature string, value double")
    edges = SW.reference_edges(ref)

    def go():
        stream = file_stream(spark, src, SCHEMA, 1)
        return run_to_table(SW.stream_profile(stream, "ts", ["value"], edges, "1 day", delay="1 day"), "p", base)

    assert [(r.n, r.bin) for r in go().collect()] == [(1, 1)]
    put(spark, src, "b", [(1, "2024-01-01 11:00", 2.0), (1, "2024-01-09 10:00", 3.0)])  # the first row is late
    rows = go().orderBy("window_start").collect()
    assert [(str(r.window_start.date()), r.n) for r in rows] == [("2024-01-01", 1), ("2024-01-05", 1)]
    psi = SW.profile_psi(go(), edges).collect()
    assert len(psi) == 2 and all(r.psi > 0 for r in psi)


def test_sessions_split_at_gaps(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, "a", [(1, "2024-01-01 00:00", 1.0), (1, "2024-01-01 01:00", 3.0), (1, "2024-01-01 09:00", 5.0), (2, "2024-01-09 00:00", 7.0)])
    out = SW.stream_sessions(file_stream(spark, src, SCHEMA), "ts", "k", ["value"], "6 hours", "1 day")
    got = run_to_table(out, "s").orderBy("session_start").collect()
    assert [(r.k, r.n_rows, r.value_mean) for r in got] == [(1, 2, 2.0), (1, 1, 5.0)]


def test_count_windows_carry_state_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(5):
        put(spark, src, f"f{i}", [(1, f"2024-01-0{i + 1} 00:00", float(2 * i)), (1, f"2024-01-0{i + 1} 01:00", float(2 * i + 1))])
    out = SS.stream_count_windows(file_stream(spark, src, SCHEMA, 1), "k", "ts", "value", 4)
    got = run_to_table(out, "c").orderBy("window_no").collect()
    assert [(r.window_no, r.n, r["min"]) for r in got][:2] == [(0, 4, 0.0), (1, 4, 4.0)] and len(got) == 2


def test_stream_adwin_equals_batch(spark, tmp_path):
    from tidewatch.operators.adwin import replay

    src = str(tmp_path / "in")
    vals = [0.1 + 0.01 * (i % 7) for i in range(300)] + [0.9 + 0.01 * (i % 5) for i in range(300)]
    stamps = pd.date_range("2024-01-01", periods=600, freq="min")
    for i in range(0, 600, 150):
        put(spark, src, f"f{i:03d}", [(1, str(t), v) for t, v in zip(stamps[i : i + 150], vals[i : i + 150])])
    got = run_to_table(SS.stream_adwin(file_stream(spark, src, SCHEMA, 1), "k", "ts", "value"), "w")
    want = [i + 1 for i, f in enumerate(replay(pd.Series(vals))) if f]
    assert sorted(r.position for r in got.collect()) == want and want


def test_monitor_is_idempotent_per_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, "a", [(1, "2024-01-01 00:00", 1.0), (2, "2024-01-01 00:00", 3.0)])
    record = lambda b: b.groupBy("batch_id").agg(F.avg("value").alias("m"))
    for attempt in ("c1", "c2"):  # a second run replays batch 0 over the same output
        SM.stream_monitor(file_stream(spark, src, SCHEMA), record, out, str(tmp_path / attempt), "q").awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r.query_id, r.batch_id, r.m) for r in rows] == [("q", 0, 2.0)]


def test_count_windows_close_when_a_key_is_idle(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, "a", [(1, f"2024-01-01 0{i}:00", float(i)) for i in range(7)] + [(2, "2024-01-01 00:00", 5.0)])
    put(spark, src, "b", [(2, "2024-01-09 00:00", 6.0)])
    build = lambda stream: SS.stream_count_windows(stream, "k", "ts", "value", 4, "1 day")
    got = run_closed(file_stream(spark, src, SCHEMA, 1), "ts", build, "c", k=0, value=0.0).collect()
    assert sorted((r.k, r.n, r["min"], r["max"]) for r in got if r.k == 1) == [(1, 3, 4.0, 6.0), (1, 4, 0.0, 3.0)]
    assert sum(r.n for r in got if r.k == 2) == 2 and all(r.k in (1, 2) for r in got)


def test_closed_streams_emit_every_window_and_count_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, "a", [(1, "2024-01-01 10:00", 1.0), (1, "2024-01-05 10:00", 9.0), (1, "2024-01-05 11:00", 8.0)])
    ref = spark.createDataFrame([("value", float(v)) for v in range(11)], "feature string, value double")
    edges, base = SW.reference_edges(ref), str(tmp_path / "out")
    go = lambda s: run_to_table(SW.stream_profile(s, "ts", ["value"], edges, "1 day", delay="1 day"), "p", base)
    go(file_stream(spark, src, SCHEMA, 1))
    put(spark, src, "b", [(1, "2024-01-01 11:00", 2.0), (1, "2024-01-05 01:00", 3.0)])  # the first row is late
    end = spark.range(1).select(F.lit(1).cast("long").alias("k"), F.lit(END_OF_STREAM).cast("timestamp_ntz").alias("ts"), F.lit(0.0).alias("value"))
    end.write.mode("append").parquet(src)
    kept = go(file_stream(spark, src, SCHEMA, 1))
    day = lambda c: F.date_format(c, "MM-dd").alias("day")
    arrived = file_rows(spark, src).filter(F.col("ts") < "2900-01-01").select(day("ts"))
    got = {r.day: (r.arrived, r.kept, r.late) for r in SW.late_rows(arrived, kept.select(day("window_start"), "n"), ["day"]).collect()}
    assert got == {"01-01": (2, 1, 1), "01-05": (3, 3, 0)}


def file_rows(spark, folder):
    return spark.read.schema(SCHEMA).parquet(folder)


def test_monitor_writes_several_results_of_one_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def record(b):
        sums = b.groupBy("batch_id").agg(F.sum("value").alias("s"))
        return {"records": sums, "alerts": sums.filter("s > 5")}

    for name, rows in (("a", [(1, "2024-01-01 00:00", 1.0)]), ("b", [(1, "2024-01-02 00:00", 9.0)])):
        put(spark, src, name, rows)
        SM.stream_monitor(file_stream(spark, src, SCHEMA), record, out, str(tmp_path / "cp"), "q").awaitTermination()
    assert sorted((r.batch_id, r.s) for r in spark.read.parquet(f"{out}/records").collect()) == [(0, 1.0), (1, 9.0)]
    assert [(r.batch_id, r.s) for r in spark.read.parquet(f"{out}/alerts").collect()] == [(1, 9.0)]

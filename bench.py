"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidewatch.plans import catalog
from tidewatch.plans import tables as T

# Stage tables are built once per application, as in production; their time is reported on its own lines.
STAGES = {
    "stage_cohort": T.cohort,
    "stage_stream": T.scored_stream,
    "stage_profile": catalog.profile,
    "stage_components": catalog.index_parts,
    "stage_domain": catalog.domain_scores,
    "stage_results": catalog.results,
}
QUERIES = [
    "entity_stats", "ffill", "obs_windows", "median_fill", "zscore", "shift_spec", "count_windows", "ks_test", "psi",
    "psi_severity", "psi_upload", "kl_kde", "wasserstein", "auto_drift", "detector_summary", "attributions",
    "fingerprint", "sadi", "d_total", "batch_report", "window_results", "evaluate_model", "auprc", "auroc",
    "subgroup_metrics", "cbpe", "est_auprc", "decide", "detector_scores", "bootstrap_f1", "fairness", "alerts",
    "phase_summary", "describe", "phase_histogram",
]

#: Timed too, but not part of the headline total, so that it stays comparable over time.
MORE = [
    "adversarial_importance", "sadi_previous", "obs_windows_hours", "knn_impute", "adwin", "adwin_changes", "train_gbt",
    "tree_attributions", "tree_path_attributions", "model_conditions", "stream_profile", "stream_count_windows", "stream_adwin", "stream_monitor",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewatch-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the workers
    times = {}
    for name, build in STAGES.items():
        start = time.time()
        build(spark, sf)
        times[name] = round(time.time() - start, 3)
    total = None
    for name in [*QUERIES, *MORE]:
        if name == MORE[0]:
            total = round(sum(times.values()), 3)
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()

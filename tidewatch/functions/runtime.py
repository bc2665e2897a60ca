"""Session helpers: staged tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_stages: dict[tuple, DataFrame] = {}
#: Writer options of the monitoring tables, which hold many alike values.
SMALL = {"compression": "zstd"}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session.

    A local session (tests) without the setting gets its own temporary folder; on a
    cluster a machine-local folder would not survive losing that machine, so it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before staging tables")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, stable row layout; ``options`` are the writer's."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{scratch_dir(spark)}/tidewatch-{app}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, which has a row or more per window, as a join side that never passes through the driver."""
    return df.hint("merge")


def materialize_all(spark: SparkSession, builders: dict) -> dict[str, DataFrame]:
    """Build and write several independent tables as concurrent jobs, so that one fills the other's tail."""

    def one(item):
        name, build = item
        return name, materialize(build(), name, **SMALL)

    with ThreadPoolExecutor(max_workers=max(1, len(builders))) as pool:
        target = inheritable_thread_target(spark)(one)
        return dict(pool.map(target, builders.items()))


def stage(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Build a named stage table once per application and reuse the written copy."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _stages:
        _stages[full] = materialize(build(), "-".join(str(k).strip("/").replace("/", "_") for k in key), **SMALL)
    return _stages[full]


def forget_stages() -> None:
    """Drop the registry (not the files), so the next use rebuilds every stage table."""
    _stages.clear()

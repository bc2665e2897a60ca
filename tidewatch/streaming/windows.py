"""Event-time profiles and sessions on unbounded readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.divergence import psi_score
from tidewatch.streaming.runner import before_end


def reference_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, lo, hi, r0..) fixed bins over the reference range; one row per feature."""
    span = reference.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = reference.join(F.broadcast(span), "feature").withColumn("bin", fixed_bin(bins))
    counts = binned.groupBy("feature").agg(
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
        F.count("value").alias("n_ref"),
        *[F.count_if(F.col("bin") == k).alias(f"_r{k}") for k in range(bins)],
    )
    return counts


def fixed_bin(bins: int = 10):
    """Bin over [lo, hi] with outliers in the end bins, so that counts of different windows merge."""
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return sum([(F.col("value") >= F.col("lo") + F.lit(float(k)) * step).cast("int") for k in range(1, bins)], F.lit(0))


def stream_profile(
    stream: DataFrame,
    ts: str,
    features: list[str],
    edges: DataFrame,
    width: str,
    slide: str | None = None,
    delay: str = "1 day",
    bins: int = 10,
) -> DataFrame:
    """Bin counts per event-time window, feature and bin, emitted when the watermark closes the window.

    Rows later than the watermark are dropped. ``edges`` is the static reference table.
    """
    # session time zone UTC turns the zone-less column into an event time
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).filter(before_end("_ts"))
    long = timed.select("_ts", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ["_ts"], features, "feature", "value"
    )
    binned = long.filter(F.col("value").isNotNull()).join(
        F.broadcast(edges.select("feature", "lo", "hi")), "feature"  # one row per feature
    )
    grain = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    return (
        binned.withColumn("bin", fixed_bin(bins))
        .groupBy(grain.alias("w"), "feature", "bin")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "bin", "n", "total")
    )


def profile_psi(counts: DataFrame, edges: DataFrame, bins: int = 10) -> DataFrame:
    """Stability index of each closed window from its merged bin counts."""
    keys = ["window_start"]
    wide = counts.groupBy(*keys, "feature").agg(
        F.sum("n").alias("n_cur"), *[F.sum(F.when(F.col("bin") == k, F.col("n")).otherwise(0)).alias(f"_c{k}") for k in range(bins)]
    )
    cells = wide.join(F.broadcast(edges), "feature").withColumn("_spread", F.col("hi") > F.col("lo"))
    return psi_score(cells, keys, bins)


def late_rows(arrived: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, arrived, kept, late): rows that reached each window and rows the closed stream counted in it.

    ``arrived`` has the keys, a row per arrival; ``kept`` the keys and ``n``. Every window is closed, so what is missing came
    after the watermark had passed it.
    """
    came = arrived.groupBy(*keys).agg(F.count("*").alias("arrived"))
    there = kept.groupBy(*keys).agg(F.sum("n").alias("kept"))
    joined = came.join(there, keys, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return joined.withColumn("late", F.col("arrived") - F.col("kept"))


def stream_sessions(stream: DataFrame, ts: str, entity: str, features: list[str], gap: str, delay: str) -> DataFrame:
    """Stays of each entity, split at gaps, with their statistics; emitted when the watermark passes."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).filter(before_end("_ts"))
    stats = []
    for f in features:
        stats += [F.avg(f).alias(f"{f}_mean"), F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max")]
    return (
        timed.groupBy(entity, F.session_window("_ts", gap).alias("w"))
        .agg(F.count("*").alias("n_rows"), *stats)
        .select(entity, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_rows",
                *[f"{f}_{x}" for f in features for x in ("mean", "min", "max")])
    )

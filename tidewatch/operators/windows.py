"""Phases, count windows over the arrival order, and observation windows per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import phase_of
from tidewatch.operators.ordered import grouped_index, row_index

_CHUNK = 65536


def phase_split(df: DataFrame, order: list[str], first: float = 0.40, second: float = 0.25) -> DataFrame:
    """Add the arrival position and its phase; ``order`` must be unique."""
    indexed = row_index(df, order, "row_idx", total="_rows")
    return indexed.withColumn("phase", phase_of(F.col("row_idx"), F.col("_rows"), first, second)).drop("_rows")


def window_size_rule(n: int) -> tuple[int, int]:
    """Window size and step for a stream of ``n`` rows."""
    if n < 500:
        size = max(30, n // 10)
        return size, max(10, size // 4)
    return (100, 50) if n < 2000 else (200, 100)


def count_windows(df: DataFrame, size: int, step: int, index: str = "row_idx") -> DataFrame:
    """Replicate each row into every count window that covers it; window w covers [w*step, w*step+size).

    No theta join: a row yields its at most ceil(size/step) windows directly. Tail windows are short.
    """
    if size < 1 or step < 1:
        raise ValueError("window size and step must be at least 1")
    i = F.col(index)
    low = F.greatest(F.lit(0), F.ceil((i - (size - 1)) / F.lit(float(step)))).cast("long")
    high = F.floor(i / F.lit(float(step))).cast("long")
    covered = F.when(low <= high, F.sequence(low, high))
    return df.select("*", F.explode(covered).alias("window_id"))


def window_sizes(windowed: DataFrame, size: int, keys: list[str] = ()) -> DataFrame:
    """Rows per window and whether it is a short tail window."""
    return windowed.groupBy(*keys, "window_id").agg(F.count("*").alias("n_samples")).withColumn(
        "is_partial", F.col("n_samples") < size
    )


def window_phase(windowed: DataFrame, phase: str = "phase", index: str = "row_idx", keys: list[str] = ()) -> DataFrame:
    """Most frequent phase per window; ties go to the phase seen first."""
    counts = windowed.groupBy(*keys, "window_id", phase).agg(F.count("*").alias("_n"), F.min(index).alias("_first"))
    return counts.groupBy(*keys, "window_id").agg(
        F.max_by(phase, F.struct(F.col("_n"), -F.col("_first"))).alias("true_phase")
    )


def observation_windows(
    df: DataFrame,
    features: list[str],
    entity: str = "patient_id",
    hour: str = "ICULOS",
    label: str = "SepsisLabel",
    obs: int = 6,
    pred: int = 4,
) -> DataFrame:
    """Sliding row windows per entity with a look-ahead label.

    Frames are row counts. An entity shorter than ``obs`` rows gives one window labelled by all its rows.
    Long entities are cut into chunks with an overlap of ``obs + pred`` rows, so that one entity holding
    most of the rows still runs in many tasks.
    """
    present = [c for c in features if c in df.columns]
    if not present:
        raise ValueError("none of the requested features is present")
    indexed = grouped_index(df, [entity], [hour], "_rn", totals=True)
    i = F.col("_rn") - 1
    own = F.floor(i / F.lit(float(_CHUNK)))
    halo = obs + pred
    chunks = F.when((i % _CHUNK < halo) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = indexed.withColumn("_own", own).withColumn("_chunk", F.explode(chunks))
    w = Window.partitionBy(entity, "_chunk").orderBy("_rn")
    seen, ahead = w.rowsBetween(0, obs - 1), w.rowsBetween(obs, obs + pred - 1)
    stats = []
    for f in present:
        c = F.col(f)
        stats += [
            F.avg(c).over(seen).alias(f"{f}_mean"),
            F.coalesce(F.stddev_samp(c).over(seen), F.lit(0.0)).alias(f"{f}_std"),
            F.min(c).over(seen).alias(f"{f}_min"),
            F.max(c).over(seen).alias(f"{f}_max"),
        ]
    if label in df.columns:
        y = (
            F.when(F.col("_rn_total") < obs, F.max(label).over(seen))
            .otherwise(F.coalesce(F.max(label).over(ahead), F.lit(0)))
            .cast("int")
        )
    else:
        y = F.lit(0)
    made = rows.select(entity, "_rn", "_rn_total", "_own", "_chunk", *stats, y.alias("label"))
    complete = made.filter(
        (F.col("_own") == F.col("_chunk")) & (F.col("_rn") <= F.greatest(F.col("_rn_total") - obs + 1, F.lit(1)))
    ).drop("_rn_total", "_own", "_chunk")
    return row_index(complete, [entity, "_rn"], "window_id").drop("_rn")


def observation_windows_by_hour(
    df: DataFrame,
    features: list[str],
    entity: str = "patient_id",
    hour: str = "ICULOS",
    label: str = "SepsisLabel",
    obs: int = 6,
    pred: int = 4,
    chunk_hours: int = 4096,
) -> DataFrame:
    """As ``observation_windows`` with frames of hours instead of rows, so that gaps count.

    One window per hour that has rows, over the rows of that hour and the ``obs`` - 1 after it; the label looks at the
    ``pred`` hours that follow. Windows end within the entity's last hour; an entity of less than ``obs`` hours gives
    one window labelled by all its rows. Entities are cut by time with a halo of ``obs + pred`` hours. Rows without
    entity or hour take no part.
    """
    present = [c for c in features if c in df.columns]
    if not present:
        raise ValueError("none of the requested features is present")
    c = F.col
    df = df.filter(c(entity).isNotNull() & c(hour).isNotNull())
    span = df.groupBy(entity).agg(F.min(hour).cast("long").alias("_lo"), F.max(hour).cast("long").alias("_hi"))
    at = df.withColumn("_h", c(hour).cast("long"))
    own = F.floor(c("_h") / F.lit(float(chunk_hours)))
    halo = obs + pred
    chunks = F.when(F.pmod(c("_h"), F.lit(chunk_hours)) < halo, F.array(own, own - 1)).otherwise(F.array(own))
    rows = at.withColumn("_own", own).withColumn("_chunk", F.explode(chunks)).join(span, entity)
    w = Window.partitionBy(entity, "_chunk").orderBy("_h")
    seen, ahead = w.rangeBetween(0, obs - 1), w.rangeBetween(obs, obs + pred - 1)
    stats = []
    for f in present:
        stats += [
            F.avg(f).over(seen).alias(f"{f}_mean"),
            F.coalesce(F.stddev_samp(f).over(seen), F.lit(0.0)).alias(f"{f}_std"),
            F.min(f).over(seen).alias(f"{f}_min"),
            F.max(f).over(seen).alias(f"{f}_max"),
        ]
    y = F.lit(0)
    if label in df.columns:
        short = c("_hi") - c("_lo") + 1 < obs
        y = F.when(short, F.max(label).over(seen)).otherwise(F.coalesce(F.max(label).over(ahead), F.lit(0))).cast("int")
    fresh = F.coalesce(F.lag("_h").over(w) != c("_h"), F.lit(True))
    made = rows.select(entity, "_h", "_own", "_chunk", "_lo", "_hi", *stats, y.alias("label"), fresh.alias("_first"))
    kept = made.filter("_own = _chunk and _first").filter(c("_h") <= F.greatest(c("_hi") - obs + 1, c("_lo")))
    kept = kept.select(entity, c("_h").alias("start_hour"), *[c(f"{f}_{x}") for f in present for x in ("mean", "std", "min", "max")], "label")
    return row_index(kept, [entity, "start_hour"], "window_id")

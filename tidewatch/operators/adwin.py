"""Adaptive windowing (Bifet and Gavalda, 2007) on ordered score streams, keyed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import grouped_index

MAX_BUCKETS = 5
CLOCK = 32
MIN_SIDE = 5
GRACE = 10


class AdaptiveWindow:
    """Exponential histogram of an adaptive window: O(log n) buckets of (count, sum, squared deviation)."""

    def __init__(self, delta: float = 0.002, rows=None):
        self.delta = delta
        self.rows = [list(r) for r in rows] if rows is not None else []  # newest last: [level, n, sum, dev]
        self.seen = 0

    @property
    def size(self) -> float:
        return sum(r[1] for r in self.rows)

    def _merge(self) -> None:
        level = 0
        while True:
            same = [i for i, r in enumerate(self.rows) if r[0] == level]
            if len(same) <= MAX_BUCKETS:
                return
            i, j = same[0], same[1]  # the two oldest of this level are neighbours
            a, b = self.rows[i], self.rows[j]
            n = a[1] + b[1]
            gap = a[2] / a[1] - b[2] / b[1]
            self.rows[j] = [level + 1, n, a[2] + b[2], a[3] + b[3] + gap * gap * a[1] * b[1] / n]
            del self.rows[i]
            level += 1

    def _has_cut(self) -> bool:
        n = self.size
        if n <= GRACE:
            return False
        total = sum(r[2] for r in self.rows)
        mean = total / n
        var = sum(r[3] + r[1] * (r[2] / r[1] - mean) ** 2 for r in self.rows) / n
        log_term = math.log(2.0 * math.log(n) / self.delta)
        n0 = s0 = 0.0
        for r in self.rows[:-1]:
            n0, s0 = n0 + r[1], s0 + r[2]
            n1 = n - n0
            if n0 < MIN_SIDE or n1 < MIN_SIDE:
                continue
            inv = 1.0 / n0 + 1.0 / n1
            bound = math.sqrt(2.0 * inv * var * log_term) + 2.0 / 3.0 * inv * log_term
            if abs(s0 / n0 - (total - s0) / n1) > bound:
                return True
        return False

    def add(self, n: float, total: float, dev: float = 0.0) -> bool:
        """Insert one value (or one pre-aggregated run of values); True if the window was cut."""
        self.rows.append([0, n, total, dev])
        self._merge()
        before, self.seen = self.seen, self.seen + n
        if int(before // CLOCK) == int(self.seen // CLOCK):
            return False
        cut = False
        while len(self.rows) > 1 and self._has_cut():
            del self.rows[0]
            cut = True
        return cut


def _runs(df: DataFrame, keys: list[str], order: list[str], score: str, grain: int) -> DataFrame:
    """Scored rows with their 1-based place ``_rn`` in the key's stream and its run of ``grain`` values."""
    numbered = grouped_index(df.filter(F.col(score).isNotNull()), keys, order, "_rn")
    return numbered.withColumn("run", F.floor((F.col("_rn") - 1) / grain))


def adwin(
    df: DataFrame, keys: list[str], order: list[str], score: str, delta: float = 0.002, grain: int = 1
) -> DataFrame:
    """(keys, run, last_position, n, drift, window_size) along each ordered stream; without keys there is one.

    The algorithm is sequential per key. ``grain`` consecutive values are first summarised in parallel, so
    that the sequential step handles 1/grain of the rows and keeps only O(log n) buckets; it reads its
    partition as a sorted stream of batches and never holds a key in memory. ``grain=1`` checks every value.
    """
    runs = _runs(df, keys, order, score, grain).groupBy(*keys, "run").agg(
        F.max("_rn").alias("last_position"),
        F.count("*").cast("double").alias("n"),
        F.sum(score).alias("_sum"),
        (F.coalesce(F.var_pop(score), F.lit(0.0)) * F.count("*")).alias("_dev"),
    )
    laid = (runs.repartition(*keys) if keys else runs.coalesce(1)).sortWithinPartitions(*keys, "run")  # summaries of one stream
    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    head = ", ".join(f"{c} {types[c]}" for c in [*keys, "run", "last_position", "n"])

    def walk(batches):
        current, win = None, None
        for pdf in batches:
            drift, size = [], []
            at_sum, at_dev = pdf.columns.get_loc("_sum"), pdf.columns.get_loc("_dev")
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, win = key, AdaptiveWindow(delta)
                drift.append(win.add(row.n, row[at_sum], row[at_dev]))
                size.append(win.size)
            out = pdf[[*keys, "run", "last_position", "n"]].copy()
            out["drift"], out["window_size"] = drift, size
            yield out

    return laid.mapInPandas(walk, f"{head}, drift boolean, window_size double")


def change_positions(df: DataFrame, cuts: DataFrame, keys: list[str], order: list[str], score: str, grain: int) -> DataFrame:
    """(keys, run, change_position): where between its two runs the stream changed, for every cut of ``adwin``.

    A cut drops whole runs; only the last run dropped and the first one kept are read again. The place is the last
    value before the split that sets their means apart most, weighted by the sizes of both sides.
    """
    c = F.col
    first_kept = F.floor((c("last_position") - c("window_size")) / grain).cast("long")
    sides = cuts.filter("drift").select(*keys, c("run").alias("_cut"), F.explode(F.array(first_kept - 1, first_kept)).alias("run"))
    rows = _runs(df, keys, order, score, grain).select(*keys, "run", "_rn", c(score).alias("_v"))
    near = rows.join(sides, [*keys, "run"])
    whole = Window.partitionBy(*keys, "_cut")  # two runs
    upto = whole.orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    n0, s0 = F.count("*").over(upto), F.sum("_v").over(upto)
    n, total = F.count("*").over(whole), F.sum("_v").over(whole)
    split = near.select(*keys, c("_cut"), "_rn", n0.alias("n0"), s0.alias("s0"), n.alias("n"), total.alias("total")).filter("n0 < n")
    gap = F.round(F.abs(c("s0") / c("n0") - (c("total") - c("s0")) / (c("n") - c("n0"))) * F.sqrt(c("n0") * (c("n") - c("n0")) / c("n")), 9)
    best = F.max_by("_rn", F.struct(gap, -c("_rn")))
    return split.groupBy(*keys, c("_cut").alias("run")).agg(best.alias("change_position"))


def replay(values: pd.Series, delta: float = 0.002) -> list[bool]:
    """Flags of one short in-memory series; used by the tests as the plain definition."""
    win = AdaptiveWindow(delta)
    return [win.add(1.0, float(v)) for v in values]

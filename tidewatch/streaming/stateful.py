"""Keyed state: count windows over arrivals, and adaptive windows over scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.adwin import AdaptiveWindow
from tidewatch.streaming.runner import before_end


def stream_count_windows(stream: DataFrame, key: str, order: str, value: str, size: int, idle: str = "1 day") -> DataFrame:
    """(key, window_no, n, mean, min, max) for every ``size`` arrivals of a key, and for what is left of an idle one.

    ``order`` is the event time. Arrivals of one micro-batch are taken in its order; the trigger's file limit bounds a
    micro-batch. State: the counter and the at most size - 1 values of the open window. A key whose last arrival the watermark
    (``idle`` behind the latest event) has passed emits its open window, short as it is, and is forgotten; later
    arrivals of it start again at window 0.
    """
    key_type = dict(stream.dtypes)[key]
    timed = stream.withColumn("_ts", F.col(order).cast("timestamp")).withWatermark("_ts", idle).filter(before_end("_ts"))

    def row(k, number, values):
        part = pd.Series(values)
        return (k[0], number, len(values), part.mean(), part.min(), part.max())

    def update(k, batches, state: GroupState):
        done, held, last = state.get if state.exists else (0, [], 0)
        held, out = list(held), []
        if state.hasTimedOut:
            if held:
                out.append(row(k, done, held))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["_ts", value], kind="mergesort")
            values = held + rows[value].astype(float).tolist()
            full = len(values) // size
            out = [row(k, done + i, values[i * size : (i + 1) * size]) for i in range(full)]
            last = max(last, int(rows["_ts"].max().timestamp() * 1000))
            state.update((done + full, values[full * size :], last))
            # an event time timeout lies beyond the watermark
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, "window_no", "n", "mean", "min", "max"])

    return timed.select(key, "_ts", value).groupBy(key).applyInPandasWithState(
        update,
        f"{key} {key_type}, window_no bigint, n bigint, mean double, min double, max double",
        "done bigint, held array<double>, last bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_adwin(stream: DataFrame, key: str, order: str, score: str, delta: float = 0.002) -> DataFrame:
    """(key, position, value) of every score at which the adaptive window of the key was cut.

    State: the O(log n) buckets of the window, flattened, and the number of values seen.
    """
    key_type = dict(stream.dtypes)[key]

    def update(k, batches, state: GroupState):
        seen, flat = state.get if state.exists else (0, [])
        flat = list(flat)
        win = AdaptiveWindow(delta, [flat[i : i + 4] for i in range(0, len(flat), 4)])
        for r in win.rows:
            r[0] = int(r[0])
        win.seen = seen
        rows = pd.concat(list(batches)).sort_values(order, kind="mergesort")
        out = []
        for v in rows[score].astype(float):
            if v == v and win.add(1.0, v):
                out.append((k[0], int(win.seen), v))
        state.update((int(win.seen), [float(x) for r in win.rows for x in r]))
        yield pd.DataFrame(out, columns=[key, "position", "value"])

    return stream.select(key, order, score).groupBy(key).applyInPandasWithState(
        update,
        f"{key} {key_type}, position bigint, value double",
        "seen bigint, flat array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )

"""Nearest-neighbour imputation with distances over the jointly observed features.

Distances depend on which features both rows have. Rows with the same missing features form a pattern; a receiver
pattern and a donor pattern share a fixed set of features, a space, in which the distance is Euclidean up to a
factor. Donors of a space are keyed by their nearest pivot and ordered by their distance to it, so a run of rows, a
block, is an annulus. A receiver first visits the nearest block of its nearest pivots; its k-th distance so far then
opens only the annuli that the triangle inequality does not rule out. The answer is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.operators.ordered import grouped_index

#: Receivers that meet a block in one task, pivots of a pattern at most, pivots whose nearest block is visited first.
TASK_RECEIVERS, MOST_PIVOTS, FIRST_PIVOTS = 4096, 1024, 3
#: Pattern pairs that are sent to every task: a handful in practice, and an error beyond this.
MOST_SPACES = 10_000
_TILE = 256  # receivers per distance tile: bounds the memory of one task


def _pattern(features: list[str]):
    """Bit j is set where the j-th feature is present."""
    return sum(((F.col(f).isNotNull()).cast("long") * (1 << j) for j, f in enumerate(features)), F.lit(0).cast("long"))


def _spaces(receivers: DataFrame, donors: DataFrame) -> list[tuple[int, int, int]]:
    """(receiver pattern, donor pattern, shared features) of pairs that share features and where the donor has one that the receiver lacks."""
    wanted = [r[0] for r in receivers.select("_pattern").distinct().limit(MOST_SPACES + 1).collect()]
    given = [r[0] for r in donors.select("_pattern").distinct().limit(MOST_SPACES + 1).collect()]
    pairs = [(r, d, r & d) for r in wanted for d in given if r & d and d & ~r]
    if len(pairs) > MOST_SPACES:
        raise ValueError(f"{len(pairs)} pairs of missing patterns; impute in groups of features")
    return pairs


def _columns(mask: int) -> list[int]:
    return [j for j in range(mask.bit_length()) if mask >> j & 1]


def _pivots(donors: DataFrame, key: str, features: list[str]) -> dict[int, np.ndarray]:
    """A keyed-hash sample of each donor pattern: the root of its rows, at most MOST_PIVOTS."""
    counts = donors.groupBy("_pattern").agg(F.count("*").alias("_rows"))
    place = F.row_number().over(Window.partitionBy("_pattern").orderBy(F.xxhash64(key), key))  # cut map-side
    few = donors.withColumn("_place", place).filter(F.col("_place") <= MOST_PIVOTS).join(F.broadcast(counts), "_pattern")  # one row per pattern
    rows = few.filter(F.col("_place") <= F.greatest(F.lit(1), F.ceil(F.sqrt("_rows") / 4))).select("_pattern", *features).toArrow()
    x = np.column_stack([rows.column(f).to_numpy() for f in features]) if rows.num_rows else np.zeros((0, len(features)))
    of = rows.column("_pattern").to_numpy()
    return {int(p): x[of == p] for p in np.unique(of)}


def _to_pivots(x: np.ndarray, pivots: np.ndarray, shared: list[int]) -> np.ndarray:
    return np.sqrt(((x[:, None, shared] - pivots[None][:, :, shared]) ** 2).sum(2))


def _matrix(batch, features) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in features]).astype(float)


def _ranges(blocks: DataFrame, pivots) -> dict[tuple[int, int], np.ndarray]:
    """Least and greatest distance to each pivot in every space; one row per space and pivot."""
    rows = blocks.groupBy("_d", "_s", "_cell").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).collect()
    out = {}
    for r in rows:
        both = out.setdefault((r["_d"], r["_s"]), np.tile([[np.inf], [-np.inf]], len(pivots[r["_d"]])))
        both[:, r["_cell"]] = r["lo"], r["hi"]
    return out


def _visits(receivers: DataFrame, key: str, features: list[str], spaces, pivots, reach: dict | None = None) -> DataFrame:
    """(key, features, _d, _s, _cell, _at, _from, _to): pivots to visit in every space of a receiver.

    ``_at`` is the distance to the pivot. The first visit takes the nearest pivots; with ``reach`` and a column ``_limit``, the
    k-th distance so far, every pivot whose donors lie at a distance that this one allows (``reach``: least and greatest of each).
    """
    sent = receivers.sparkSession.sparkContext.broadcast((spaces, pivots, reach))

    def emit(batches):
        spaces, pivots, reach = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, features)
            pattern = batch.column(batch.schema.get_field_index("_pattern")).to_numpy()
            limit = batch.column(batch.schema.get_field_index("_limit")).to_numpy() if reach is not None else None
            for r, d, s in spaces:
                rows = np.flatnonzero(pattern == r)
                if not len(rows) or d not in pivots:
                    continue
                for low in range(0, len(rows), _TILE):
                    part = rows[low : low + _TILE]
                    to = _to_pivots(x[part], pivots[d], _columns(s))
                    if reach is not None:
                        if (d, s) not in reach:
                            continue
                        width = (limit[part] + 2e-9) * math.sqrt(len(_columns(s)) / len(features)) * (1 + 1e-9)
                        lo, hi = reach[d, s]
                        i, cell = np.nonzero((to - width[:, None] <= hi) & (to + width[:, None] >= lo))
                        begin, end = to[i, cell] - width[i], to[i, cell] + width[i]
                    else:
                        cell = np.argsort(to, axis=1, kind="stable")[:, :FIRST_PIVOTS].ravel()
                        i = np.repeat(np.arange(len(part)), min(FIRST_PIVOTS, to.shape[1]))
                        begin = end = to[i, cell]
                    full = lambda v, t: pa.array(np.full(len(i), v), t)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(part[i])), full(d, pa.int64()), full(s, pa.int64()), pa.array(cell.astype(np.int32)), pa.array(to[i, cell]), pa.array(begin), pa.array(end)],
                        [key, "_d", "_s", "_cell", "_at", "_from", "_to"],
                    )

    names = [key, "_pattern", *features, *(["_limit"] if reach is not None else [])]
    return receivers.select(*names).mapInArrow(emit, f"`{key}` long, _d long, _s long, _cell int, _at double, _from double, _to double")


def _placed(donors: DataFrame, key: str, features: list[str], spaces, pivots) -> DataFrame:
    """Donors once per space: (key, features, _d, _s, _cell, _dist), the nearest pivot and the distance to it."""
    by_pattern: dict[int, set[int]] = {}
    for _, d, s in spaces:
        by_pattern.setdefault(d, set()).add(s)
    sent = donors.sparkSession.sparkContext.broadcast(({d: sorted(s) for d, s in by_pattern.items()}, pivots))

    def emit(batches):
        by_pattern, pivots = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, features)
            pattern = batch.column(1).to_numpy()
            for d, subsets in by_pattern.items():
                rows = np.flatnonzero(pattern == d)
                for s in subsets:
                    for low in range(0, len(rows), _TILE):
                        part = rows[low : low + _TILE]
                        to = _to_pivots(x[part], pivots[d], _columns(s))
                        cell = to.argmin(1)
                        full = lambda v: pa.array(np.full(len(part), v))
                        taken = batch.take(pa.array(part))
                        yield pa.RecordBatch.from_arrays([taken.column(0), *taken.columns[2:], full(d), full(s), pa.array(cell.astype(np.int32)), pa.array(to[np.arange(len(part)), cell])], [key, *features, "_d", "_s", "_cell", "_dist"])

    schema = ", ".join([f"`{key}` long", *[f"`{f}` double" for f in features]]) + ", _d long, _s long, _cell int, _dist double"
    return donors.select(key, "_pattern", *features).mapInArrow(emit, schema)


def _nearest(key: str, features: list[str], k: int):
    """Arrow cogroup function: the k nearest donors of one block for every missing cell of its visitors."""

    def find(rec, don):
        rows = []
        if rec.num_rows and don.num_rows:
            don = don.sort_by(key)
            d, s = don.column("_d")[0].as_py(), don.column("_s")[0].as_py()
            shared, has = _columns(s), _columns(d)
            dx = np.column_stack([don.column(f).to_numpy() for f in features])
            ids = don.column(key).to_numpy()
            rx_all, rid_all = np.column_stack([rec.column(f).to_numpy() for f in features]), rec.column(key).to_numpy()
            for low in range(0, len(rid_all), _TILE):
                rx, rid = rx_all[low : low + _TILE], rid_all[low : low + _TILE]
                total = np.zeros((len(rx), len(dx)))
                for j in shared:  # exact differences, not the cancelling expansion of the square
                    total += (rx[:, j, None] - dx[None, :, j]) ** 2
                dist = np.round(np.sqrt(total * len(features) / len(shared)), 9)
                dist[rid[:, None] == ids[None, :]] = np.inf  # a row is no donor to itself
                best = np.argsort(dist, axis=1, kind="stable")[:, :k]
                near = np.take_along_axis(dist, best, 1)
                i, c = np.nonzero(np.isfinite(near))
                for j in has:
                    need = np.isnan(rx[i, j])
                    at = best[i[need], c[need]]
                    rows.append((rid[i[need]], np.full(need.sum(), j), near[i[need], c[need]], ids[at], dx[at, j]))
        cells = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, float)]
        names = pa.array(features).take(pa.array(cells[1]))
        return pa.table([pa.array(cells[0]), names, *[pa.array(x) for x in cells[2:]]], names=[key, "feature", "distance", "donor", "value"])

    return find


def knn_candidates(receivers: DataFrame, donors: DataFrame, key: str, features: list[str], k: int = 5, block_rows: int = 1024) -> DataFrame:
    """(key, feature, distance, donor, value): the k nearest donors of each missing cell, ties by the donor's key.

    A donor needs the feature and one that the receiver has too; ``key`` is a whole number, unique on either side.
    ``block_rows`` donors form a block; a block and ``TASK_RECEIVERS`` of its visitors are the most that meet in a task.
    """
    c = F.col
    cols = [c(key).cast("long").alias(key), *[c(f).cast("double").alias(f) for f in features]]
    receivers = materialize(receivers.select(*cols).withColumn("_pattern", _pattern(features)), "receivers")
    donors = donors.select(*cols).withColumn("_pattern", _pattern(features)).filter("_pattern <> 0")
    spaces = _spaces(receivers, donors)
    pivots = _pivots(donors, key, features)
    where = ["_d", "_s", "_cell"]
    placed = grouped_index(_placed(donors, key, features, spaces, pivots), where, ["_dist", key], "_place")
    placed = materialize(placed.withColumn("_block", F.floor((c("_place") - 1) / block_rows)).drop("_place"), "donors")
    blocks = materialize(placed.groupBy(*where, "_block").agg(F.min("_dist").alias("_lo"), F.max("_dist").alias("_hi")), "annuli")
    schema = f"`{key}` long, feature string, distance double, donor long, value double"

    def search(visits: DataFrame) -> DataFrame:
        """The best of every visited block; visitors beyond TASK_RECEIVERS meet a copy of it."""
        at = [*where, "_block"]
        counts = visits.groupBy(*at).agg(F.ceil(F.count("*") / TASK_RECEIVERS).cast("long").alias("_parts"))
        salted = visits.join(counts, at).withColumn("_part", F.pmod(F.xxhash64(key), "_parts")).join(receivers.drop("_pattern"), key)
        copies = placed.join(counts, at).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), c("_parts") - 1)))
        sides = salted.select(*at, "_part", key, *features), copies.select(*at, "_part", key, *features)
        left, right = (side.groupBy(*at, "_part") for side in sides)
        return left.cogroup(right).applyInArrow(_nearest(key, features, k), schema)

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key, "feature").orderBy("distance", "donor"))  # cut map-side
        return found.withColumn("_rk", place).filter(c("_rk") <= k).drop("_rk")

    gap = F.greatest(c("_lo") - c("_at"), c("_at") - c("_hi"), F.lit(0.0))
    first = _visits(receivers, key, features, spaces, pivots).join(blocks, where)
    first = first.groupBy(key, *where).agg(F.min_by("_block", F.struct(gap, "_block")).alias("_block"))
    first = materialize(first, "visits")
    found = materialize(best(search(first)), "nearest")
    # the widest k-th distance over a row's missing features; too few so far leave it open
    limits = found.groupBy(key, "feature").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
    lacking = F.array(*[F.struct(F.lit(f).alias("feature"), c(f).isNull().alias("_lacks")) for f in features])
    cells = receivers.select(key, F.inline(lacking)).filter("_lacks").drop("_lacks")
    wide = cells.join(limits, [key, "feature"], "left").groupBy(key).agg(F.max(F.when(c("_n") >= k, c("_far")).otherwise(float("inf"))).alias("_limit"))
    open_ = _visits(receivers.join(wide, key), key, features, spaces, pivots, _ranges(blocks, pivots)).join(blocks, where)
    open_ = open_.filter((c("_lo") <= c("_to")) & (c("_hi") >= c("_from"))).select(key, *where, "_block")
    more = materialize(open_.join(first, [key, *where, "_block"], "left_anti"), "visits")
    return best(found.unionByName(search(more)))


def knn_impute(df: DataFrame, donors: DataFrame, key: str, features: list[str], k: int = 5, block_rows: int = 1024) -> DataFrame:
    """Fill missing cells with the mean of the k nearest donors that have the feature.

    A feature missing in every donor becomes 0; a cell without a comparable donor gets the donor mean.
    Only rows with a missing cell take part in the search.
    """
    present = [f for f in features if f in df.columns]
    gaps = F.lit(False)
    for f in present:
        gaps = gaps | F.col(f).isNull()
    receivers = df.filter(gaps)
    means = donors.agg(*[F.avg(f).alias(f"_m_{f}") for f in present])
    near = knn_candidates(receivers, donors, key, present, k, block_rows)
    wide = near.groupBy(key).agg(*[F.avg(F.when(F.col("feature") == f, F.col("value"))).alias(f"_k_{f}") for f in present])
    joined = df.join(wide, key, "left").crossJoin(F.broadcast(means))  # one row of means
    return joined.select(
        *[
            F.coalesce(F.col(c), F.col(f"_k_{c}"), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) if c in present else F.col(c)
            for c in df.columns
        ]
    )

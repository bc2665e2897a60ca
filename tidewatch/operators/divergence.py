"""Two-sample drift statistics of many windows against one reference.

All operators take long tables: reference ``(feature, value)`` and current ``(<window keys>, feature,
value)``. The reference is never replicated per window. It is collapsed to its distribution profile
(prefix counts and sums per distinct value) and the windows look positions up in it with one ordered
scan, so cost is linear in the rows of both sides. NULL values are dropped per feature.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import kolmogorov_p
from tidewatch.functions.runtime import SMALL, by_shuffle, materialize
from tidewatch.operators.ordered import asof_lookup, running_totals, with_next


def collapse(df: DataFrame, keys: list[str]) -> DataFrame:
    """Equal values become one row with a count; combined map-side before any shuffle."""
    return df.filter(F.col("value").isNotNull()).groupBy(*keys, "feature", "value").agg(F.count("*").alias("n"))


def distribution_profile(reference: DataFrame) -> DataFrame:
    """(feature, r_value, r_n, r_le, r_sum): the empirical distribution with prefix counts and sums.

    This is the persistable reference profile; build it once and pass it to every operator below.
    """
    run = running_totals(
        collapse(reference, []),
        ["feature"],
        ["value"],
        {"r_le": F.col("n"), "r_sum": F.col("value") * F.col("n")},
    )
    return run.select("feature", F.col("value").alias("r_value"), F.col("n").alias("r_n"), "r_le", "r_sum")


def profile_stats(profile: DataFrame) -> DataFrame:
    """One row per feature: size, sum and range of the reference."""
    return profile.groupBy("feature").agg(
        F.max("r_le").alias("r_total"),
        F.max_by("r_sum", "r_value").alias("r_sum_total"),
        F.min("r_value").alias("r_min"),
        F.max("r_value").alias("r_max"),
    )


def _positions(current: DataFrame, profile: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Distinct window values with their window ranks and reference prefix counts."""
    if bounded:  # one shuffle serves the collapse and the window's ranks
        current = current.filter(F.col("value").isNotNull()).repartition(*keys, "feature")
    cells = running_totals(
        collapse(current, keys),
        [*keys, "feature"],
        ["value"],
        {"c_le": F.col("n")},
        totals=True,
        bounded=bounded,
    )
    if bounded:
        cells = materialize(cells, "cells", **SMALL)  # the lookup reads its queries twice
    hit = asof_lookup(cells, profile, ["feature"], "value", "r_value", ["r_value", "r_n", "r_le", "r_sum"], keys)
    same = F.col("r_value") == F.col("value")
    return hit.select(
        *keys,
        "feature",
        "value",
        "n",
        "c_le",
        F.col("c_le_total").alias("c_total"),
        F.coalesce("r_le", F.lit(0)).alias("r_le"),
        (F.coalesce("r_le", F.lit(0)) - F.when(same, F.col("r_n")).otherwise(0)).alias("r_lt"),
        F.coalesce("r_sum", F.lit(0.0)).alias("r_sum"),
    )


def window_feature_grid(current: DataFrame, keys: list[str]) -> DataFrame:
    """Every (window, feature) pair, also those with no usable value."""
    return current.groupBy(*keys, "feature").agg(F.count("value").alias("c_n"))


def ks_test(
    current: DataFrame,
    profile: DataFrame,
    keys: list[str],
    p_thresh: float = 0.05,
    bounded: bool = False,
    correction: str | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, asymptotic p-value and flag per window and feature.

    An empty side gives p = 1. ``correction='bonferroni'`` divides the level by the features of the window.
    """
    pos = _positions(current, profile, keys, bounded)
    stats = F.broadcast(profile_stats(profile))  # one row per feature
    gap = F.greatest(
        F.col("c_le") / F.col("c_total") - F.col("r_le") / F.col("r_total"),
        F.col("r_lt") / F.col("r_total") - (F.col("c_le") - F.col("n")) / F.col("c_total"),
    )
    d = (
        pos.join(stats, "feature")
        .groupBy(*keys, "feature")
        .agg(
            F.greatest(F.max(gap), F.lit(0.0)).alias("statistic"),
            F.first("r_total").alias("n_ref"),
            F.first("c_total").alias("n_cur"),
        )
    )
    grid = window_feature_grid(current, keys).drop("c_n")
    out = grid.join(by_shuffle(d), [*keys, "feature"], "left")
    tested = F.col("statistic").isNotNull()
    p = F.when(tested, kolmogorov_p(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))).otherwise(1.0)
    out = out.select(
        *keys,
        "feature",
        F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
        F.coalesce("n_cur", F.lit(0)).alias("n_cur"),
        F.coalesce("statistic", F.lit(0.0)).alias("statistic"),
        p.alias("p_value"),
        F.when(tested, "ok").otherwise("empty").alias("status"),
    )
    if correction == "bonferroni":
        m = out.groupBy(*keys).agg(F.count("*").alias("_m"))
        out = out.join(m, keys) if keys else out.crossJoin(m)
        return out.withColumn("flagged", F.col("p_value") < F.lit(p_thresh) / F.col("_m")).drop("_m")
    return out.withColumn("flagged", F.col("p_value") < p_thresh)


def ks_share(ks: DataFrame, keys: list[str], level: float = 0.05, high: float = 0.3) -> DataFrame:
    """Share of features with a statistic above ``high`` and share significant at level / features."""
    m = F.count("*")
    totals = ks.groupBy(*keys).agg(
        m.alias("n_features"),
        F.count_if(F.col("statistic") > high).alias("n_high"),
        F.collect_list("p_value").alias("_p"),  # one entry per feature
    )
    sig = F.size(F.filter("_p", lambda p: p < F.lit(level) / F.col("n_features")))
    return totals.select(
        *keys,
        "n_features",
        "n_high",
        sig.cast("long").alias("n_significant"),
        (F.col("n_high") / F.col("n_features")).alias("share_high"),
        (sig / F.col("n_features")).alias("share_significant"),
    )


# Smoothing constant of each stability index variant.
PSI_EPSILON = {"detector": 1e-6, "index": 1e-10, "additive": 1e-6}


def _psi_term(r: Column, c: Column, n_r: Column, n_c: Column, eps: float, bins: int, variant: str) -> Column:
    if variant == "additive":
        a, b = r / n_r + F.lit(eps), c / n_c + F.lit(eps)
    else:
        a = (r + F.lit(eps)) / (n_r + F.lit(bins * eps))
        b = (c + F.lit(eps)) / (n_c + F.lit(bins * eps))
    return (b - a) * F.log(b / a)


def psi_cells(current: DataFrame, profile: DataFrame, keys: list[str], bins: int = 10, edges: str = "joint") -> DataFrame:
    """Bin counts of both sides per window and feature, as columns ``_r0.. _c0..``.

    ``edges='joint'`` spans reference and window (reference counts come from profile lookups at the inner
    edges); ``edges='reference'`` spans the reference only and is mergeable across windows and streams.
    Values are counted where they lie: only one row per window and feature is shuffled, unless there are so many
    windows that their edges do not fit a broadcast.
    """
    ref = F.broadcast(profile_stats(profile))  # one row per feature
    rows = current.filter(F.col("value").isNotNull())
    # every window and feature, also those with no usable value; used often, its size decides how the values meet it
    grid = current.groupBy(*keys, "feature").agg(
        F.min("value").alias("_cmin"), F.max("value").alias("_cmax"), F.count("value").alias("n_cur")
    )
    grid = materialize(grid, "psi-edges")
    lo = F.least("r_min", "_cmin") if edges == "joint" else F.col("r_min")
    hi = F.greatest("r_max", "_cmax") if edges == "joint" else F.col("r_max")
    span = grid.filter("n_cur > 0").join(ref, "feature").select(
        *keys, "feature", "n_cur", F.col("r_total").alias("n_ref"), lo.alias("_lo"), hi.alias("_hi")
    )
    inner = range(1, bins)

    def edge(k):
        return F.col("_lo") + F.lit(float(k)) * ((F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))

    slot = sum([(F.col("value") >= edge(k)).cast("int") for k in inner], F.lit(0))
    cur = (
        rows.join(span.select(*keys, "feature", "_lo", "_hi"), [*keys, "feature"])
        .select(*keys, "feature", slot.alias("_bin"))
        .groupBy(*keys, "feature")
        .agg(*[F.count_if(F.col("_bin") == k).alias(f"_c{k}") for k in range(bins)])
    )
    wanted = span.select(*keys, "feature", F.posexplode(F.array(*[edge(k) for k in inner])).alias("_k", "_edge"))
    below = asof_lookup(wanted, profile, ["feature"], "_edge", "r_value", ["r_value", "r_n", "r_le"], ["_k", *keys])
    under = F.coalesce(
        F.col("r_le") - F.when(F.col("r_value") == F.col("_edge"), F.col("r_n")).otherwise(0), F.lit(0)
    )
    cum = below.groupBy(*keys, "feature").agg(
        *[F.max(F.when(F.col("_k") == k - 1, under)).alias(f"_u{k}") for k in inner]
    )

    def ref_count(k):
        upper = F.col(f"_u{k + 1}") if k + 1 < bins else F.col("n_ref")
        return (upper - (F.col(f"_u{k}") if k > 0 else F.lit(0))).alias(f"_r{k}")

    both = by_shuffle(span).join(by_shuffle(cur), [*keys, "feature"]).join(by_shuffle(cum), [*keys, "feature"])
    return grid.select(*keys, "feature").join(by_shuffle(both), [*keys, "feature"], "left").select(
        *keys,
        "feature",
        F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
        F.coalesce("n_cur", F.lit(0)).alias("n_cur"),
        (F.col("_hi") - F.col("_lo") > 0).alias("_spread"),
        *[ref_count(k) for k in range(bins)],
        *[f"_c{k}" for k in range(bins)],
    )


def psi_score(
    cells: DataFrame, keys: list[str], bins: int = 10, variant: str = "detector", threshold: float = 0.2, min_rows: int = 1
) -> DataFrame:
    """Population stability index from bin counts. Constant and empty inputs give 0.

    ``detector`` and ``index`` renormalise the smoothed shares, ``additive`` does not.
    """
    enough, spread = _psi_usable(min_rows)
    return cells.select(
        *keys,
        "feature",
        _psi_value(bins, variant, min_rows).alias("psi"),
        F.when(~enough, "empty").when(~spread, "constant").otherwise("ok").alias("status"),
    ).withColumn("flagged", F.col("psi") > threshold)


def _psi_usable(min_rows: int) -> tuple[Column, Column]:
    return (F.col("n_ref") >= min_rows) & (F.col("n_cur") >= min_rows), F.coalesce("_spread", F.lit(False))


def _psi_value(bins: int, variant: str, min_rows: int = 1) -> Column:
    eps = PSI_EPSILON[variant]
    total = F.lit(0.0)
    for k in range(bins):
        total = total + _psi_term(
            F.col(f"_r{k}"), F.col(f"_c{k}"), F.col("n_ref"), F.col("n_cur"), eps, bins, variant
        )
    if variant == "index":
        total = F.greatest(total, F.lit(0.0))
    enough, spread = _psi_usable(min_rows)
    return F.when(enough & spread, total).otherwise(0.0)


def psi_both(cells: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """The detector variant (``psi``, ``flagged``) next to the index variant (``psi_index``)."""
    kept = cells.withColumn("psi_index", _psi_value(bins, "index"))
    return psi_score(kept, [*keys, "psi_index"], bins).select(*keys, "feature", "psi", "status", "flagged", "psi_index")


def psi(
    current: DataFrame,
    profile: DataFrame,
    keys: list[str],
    bins: int = 10,
    variant: str = "detector",
    threshold: float = 0.2,
    edges: str = "joint",
    min_rows: int = 1,
) -> DataFrame:
    """Population stability index over equal-width bins, per window and feature."""
    return psi_score(psi_cells(current, profile, keys, bins, edges), keys, bins, variant, threshold, min_rows)


def psi_status(score: Column) -> Column:
    """Report wording of a stability index."""
    return F.when(score > 0.25, "major").when(score > 0.1, "moderate").otherwise("stable")


def wasserstein(current: DataFrame, profile: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """First Wasserstein distance: the area between both distribution functions, exact.

    Between two neighbouring window values the window function is the constant c, and the area under the
    reference function is H(x) = (x C(x) - S(x)) / n from prefix counts C and sums S. Where the reference
    crosses c inside a gap, the crossing value comes from a second lookup by rank.
    """
    ref = F.broadcast(profile_stats(profile))  # one row per feature
    pos = _positions(current, profile, keys, bounded)
    pos = with_next(pos, [*keys, "feature"], "value", ["value", "r_le", "r_lt", "r_sum"], bounded).join(ref, "feature")
    # 1-based rank at which the reference reaches the window's level
    level = F.col("c_le") / F.col("c_total")
    pos = pos.withColumn("_rank", F.ceil(F.round(level * F.col("r_total"), 6)))
    # only a gap whose ends lie on both sides of the level needs the crossing value
    crosses = F.coalesce(
        (F.col("r_le") / F.col("r_total") < level) & (F.col("next_r_lt") / F.col("r_total") > level), F.lit(False)
    )
    columns = ["feature", "r_value", "r_le", "r_sum"]
    by_rank = profile.select(*columns).toDF("feature", "q_value", "q_le", "q_sum")
    pos = materialize(pos, "positions", **SMALL)  # read three times below
    needed = asof_lookup(
        pos.filter(crosses), by_rank, ["feature"], "_rank", "q_le", ["q_value", "q_le", "q_sum"], [*keys, "value"], forward=True
    )
    rest = pos.filter(~crosses)
    crossed = needed.unionByName(rest, allowMissingColumns=True)
    n = F.col("r_total").cast("double")

    def under(x, c, s):
        return (x * c - s) / n

    a, b, c, q = F.col("value"), F.col("next_value"), F.col("c_le") / F.col("c_total"), F.col("q_value")
    ha = under(a, F.col("r_le"), F.col("r_sum"))
    hb = under(b, F.col("next_r_le"), F.col("next_r_sum"))
    hq = under(q, F.col("q_le"), F.col("q_sum"))
    gap = (
        F.when(F.col("next_r_lt") / n <= c, c * (b - a) - (hb - ha))
        .when(F.col("r_le") / n >= c, (hb - ha) - c * (b - a))
        .otherwise(c * (q - a) - (hq - ha) + (hb - hq) - c * (b - q))
    )
    tail = (F.col("r_sum_total") - F.col("r_sum") - (n - F.col("r_le")) * a) / n
    first = F.col("c_le") == F.col("n")
    piece = F.when(b.isNotNull(), gap).otherwise(tail) + F.when(first, ha).otherwise(0.0)
    d = crossed.groupBy(*keys, "feature").agg(F.sum(piece).alias("w1"))
    grid = window_feature_grid(current, keys).drop("c_n")
    return grid.join(by_shuffle(d), [*keys, "feature"], "left").select(
        *keys, "feature", F.greatest(F.coalesce("w1", F.lit(0.0)), F.lit(0.0)).alias("w1")
    )


KL_EPS = 1e-10
KL_MIN_SAMPLES = 5
#: Fast Gauss transform: cell width and reach in bandwidths, power sums a cell, cells of a row (more than a reach both ways).
CELL, REACH, POWERS, BLOCK_CELLS = 0.5, 12.0, 29, 64


def _power_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lattice cells of half a bandwidth with the sums of exp(-u^2 / 2) u^k / k!, ``BLOCK_CELLS`` cells a row.

    ``rows`` has (keys, feature, value, _h); u is a value's distance from its cell's centre in bandwidths.
    """
    cell = F.floor(F.col("value") / (F.lit(CELL) * F.col("_h")))
    u = (F.col("value") - (F.col("_cell") + 0.5) * F.lit(CELL) * F.col("_h")) / F.col("_h")
    at = rows.select(*keys, "feature", "value", "_h", cell.alias("_cell")).withColumn("_u", u)
    at = at.withColumn("_e", F.exp(-F.col("_u") * F.col("_u") / 2))
    # independent terms: a chain of products would be expanded again and again when code is generated
    sums = [F.sum(F.col("_e") * F.pow("_u", F.lit(float(k))) / F.lit(float(factorial(k)))).alias(f"_s{k}") for k in range(POWERS)]
    cells = at.groupBy(*keys, "feature", "_cell").agg(*sums)
    packed = F.struct("_cell", F.array(*[F.col(f"_s{k}") for k in range(POWERS)]).alias("_s"))
    block = F.floor(F.col("_cell") / BLOCK_CELLS).alias("_block")
    return cells.groupBy(*keys, "feature", block).agg(F.collect_list(packed).alias("_cells"))  # at most BLOCK_CELLS


def _kernel_sums(names: list[str]):
    """Arrow map: sums over one block's cells at grid points near it, as (names, _k, _v) arrays."""

    def add(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            h, g0, step = (columns[n].to_numpy() for n in ("_h", "_g0", "_gw"))
            values, sizes = [], []
            for i in range(batch.num_rows):
                points = columns["_ks"][i].values.to_numpy()
                cells = columns["_cells"][i].values
                centre = (cells.field(0).to_numpy() + 0.5) * CELL * h[i]
                sums = cells.field(1).flatten().to_numpy().reshape(-1, POWERS)
                z = ((g0[i] + points * step[i])[:, None] - centre[None, :]) / h[i]
                total = np.zeros_like(z)
                for k in reversed(range(POWERS)):
                    total = total * z + sums[None, :, k]
                near = np.abs(z) <= REACH + CELL
                values.append((np.where(near, total, 0.0) * np.exp(-0.5 * z * z)).sum(1))
                sizes.append(len(points))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate(values) if values else np.zeros(0))
            found = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([*[columns[n] for n in names], columns["_ks"], found], [*names, "_k", "_v"])

    return add


def _densities(blocks: DataFrame, grid: DataFrame, keys: list[str], on: list[str], h: str, n: str, points: int, name: str) -> DataFrame:
    """(keys, feature, _k, ``name``): kernel density at every grid point that has a value within reach."""
    x = F.col("_g0") + F.col("_k") * F.col("_gw")
    ends = [F.floor((x + F.lit(sign * REACH) * F.col(h)) / (F.lit(CELL) * F.col(h)) / BLOCK_CELLS) for sign in (-1, 1)]
    # a reach is shorter than a block, so a point meets two blocks at most
    near = grid.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_block", F.explode(F.array_distinct(F.array(*ends))))
    of = [*keys, "feature"]
    near = near.groupBy(*of, "_block").agg(*[F.first(c).alias(a) for c, a in ((h, "_h"), (n, "_n"), ("_g0", "_g0"), ("_gw", "_gw"))], F.sort_array(F.collect_list("_k")).alias("_ks"))
    joined = near.join(blocks, [*on, "feature", "_block"]).select(*of, "_n", "_h", "_g0", "_gw", "_ks", "_cells")
    types = dict(joined.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*of, "_n", "_h")) + ", _k array<int>, _v array<double>"
    sums = joined.mapInArrow(_kernel_sums([*of, "_n", "_h"]), schema)
    rows = sums.select(*of, "_n", "_h", F.inline(F.arrays_zip("_k", "_v")))
    return rows.select(*of, "_k", (F.col("_v") / (F.col("_n") * F.col("_h") * F.lit(float(np.sqrt(2 * np.pi))))).alias(name))


def kl_kde(current: DataFrame, reference: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """KL(reference || window) of Gaussian kernel densities on a shared grid, per window and feature.

    Bandwidth by Scott's rule from the exact moments. Kernel sums are those over all values, by a fast Gauss
    transform: values fall into lattice cells of half a bandwidth, whose power sums give the kernel at any point
    (relative error below 1e-12 a cell; values more than ``REACH`` bandwidths away add less than 1e-31 of a kernel).
    Grid points meet the cells near them by an equi-join on blocks of cells, so heavy tails cost rows, not accuracy,
    and no group holds more than one block. Fewer than 5 samples give 0; constant inputs give 0, 5 or 10.
    """
    ref_rows = reference.filter(F.col("value").isNotNull()).select("feature", "value")
    cur_rows = current.filter(F.col("value").isNotNull()).select(*keys, "feature", "value")
    rs = F.broadcast(_moments(ref_rows, [], "_r"))  # one row per feature
    stats = materialize(_kl_stats(_moments(cur_rows, keys, "_c").join(rs, "feature"), keys, points), "kl-stats")
    grid = stats.filter("_guard is null")
    # one bandwidth per feature, one per window and feature; constant sides have guards
    ref_h = grid.groupBy("feature").agg(F.first("_rh").alias("_h"))
    ref_blocks = _power_blocks(ref_rows.join(F.broadcast(ref_h), "feature"), [])
    cur_blocks = _power_blocks(cur_rows.join(grid.select(*keys, "feature", F.col("_ch").alias("_h")), [*keys, "feature"]), keys)
    found = _kl_of(stats, _densities(ref_blocks, grid, keys, [], "_rh", "_rn", points, "p"), _densities(cur_blocks, grid, keys, keys, "_ch", "_cn", points, "q"), keys, points)
    whole = window_feature_grid(current, keys).drop("c_n")
    return whole.join(found, [*keys, "feature"], "left").select(*keys, "feature", F.coalesce("kl", F.lit(0.0)).alias("kl"))


#: Windows whose grid points meet the reference's cells in one group, and points evaluated at a time.
WINDOWS_TOGETHER, POINTS_TOGETHER = 128, 512


def _kernels_at(at: np.ndarray, x: np.ndarray, h: float, together: int = 10) -> np.ndarray:
    """Sums of exp(-((at - x) / h)^2 / 2) over ``x`` at the evenly spaced points ``at``.

    With s the step and u the distance of a point from x, in bandwidths, the kernel k points on is exp(-u^2 / 2) exp(-u s)^k
    exp(-(k s)^2 / 2): two exponentials serve ``together`` points. Wide steps, where a factor could overflow, are added up singly.
    """
    s = (at[1] - at[0]) / h
    back = together // 2
    wide = not (s * back <= 3 and (len(at) + together) * s * s * back <= 600)  # the points span the values
    starts = at if wide else at[0] + (np.arange(-(-len(at) // together)) * together + back) * (at[1] - at[0])
    total = np.zeros(len(starts) if wide else len(starts) * together)
    for start in range(0, len(x), 1024):
        u = (starts[:, None] - x[None, start : start + 1024]) / h
        here = np.exp(-0.5 * u * u)
        if wide:
            total += here.sum(1)
            continue
        sums = np.empty((len(starts), together))
        sums[:, back] = here.sum(1)
        up = np.exp(-s * u)
        for k, factor in ((1, up), (-1, 1 / up)):
            now = here.copy()
            for j in range(1, back + (k < 0) if together % 2 == 0 else back + 1):
                now *= factor
                sums[:, back + k * j] = now.sum(1)
        total += (sums * np.exp(-0.5 * ((np.arange(together) - back) * s) ** 2)).ravel()
    return total[: len(at)]


def _window_kernels(keys: list[str], types: dict, features: list[str], ends: dict, points: int):
    """Arrow group map of one window's rows: per feature its moments and the kernel density at its grid points."""

    def run(key, table):
        out = {"feature": list(features), **{f"_c{m}": [] for m in _MOMENTS}, "_q": []}
        for f in features:
            x = table.column(f).drop_null().to_numpy()
            n = len(x)
            made = [n, *([x.mean(), x.std(ddof=1) if n > 1 else None, x.std(), x.min(), x.max()] if n else [None] * 5)]
            for m, v in zip(_MOMENTS, made):
                out[f"_c{m}"].append(v)
            if n < KL_MIN_SAMPLES or f not in ends or not made[3] >= KL_EPS:
                out["_q"].append(None)
                continue
            low, high = min(x.min(), ends[f][0]), max(x.max(), ends[f][1])
            margin = 0.1 * (high - low + KL_EPS)
            at = low - margin + np.arange(points) * ((high + margin - (low - margin)) / (points - 1))
            h = made[2] * float(n) ** -0.2
            total = _kernels_at(at, x, h)
            out["_q"].append(total / (n * h * np.sqrt(2 * np.pi)))
        kinds = {"feature": pa.string(), "_cn": pa.int64(), "_q": pa.list_(pa.float64())}
        columns = {k: pa.array([v.as_py()] * len(features), table.schema.field(k).type) for k, v in zip(keys, key)}
        return pa.table(columns | {c: pa.array(v, kinds.get(c, pa.float64())) for c, v in out.items()})

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", feature string, _cn bigint, " + ", ".join(f"_c{m} double" for m in _MOMENTS[1:]) + ", _q array<double>"
    return run, schema


def _against_cells(keys: list[str], points: int):
    """Arrow cogroup map: KL of windows (their grids and densities) against the reference cells near them."""

    def run(windows, blocks):
        h = windows.column("_rh")[0].as_py()  # one feature
        g0, step, n = (windows.column(c).to_numpy() for c in ("_g0", "_gw", "_rn"))
        at = (g0[:, None] + np.arange(points)[None, :] * step[:, None]).ravel()
        p = np.zeros(len(at))
        if blocks.num_rows:
            cells = pa.concat_arrays([c.flatten() for c in blocks.column("_cells").chunks])
            number = cells.field(0).to_numpy()
            order = np.argsort(number)
            centre = (number[order] + 0.5) * CELL * h
            sums = np.ascontiguousarray(cells.field(1).flatten().to_numpy().reshape(-1, POWERS)[order].T)
            by = np.argsort(at)
            for start in range(0, len(by), POINTS_TOGETHER):
                some = by[start : start + POINTS_TOGETHER]
                reach = (REACH + CELL) * h
                low, high = np.searchsorted(centre, [at[some[0]] - reach, at[some[-1]] + reach])
                for first in range(low, high, BLOCK_CELLS):  # heavy tails: points far apart
                    cut = slice(first, min(first + BLOCK_CELLS, high))
                    z = (at[some][:, None] - centre[None, cut]) / h
                    total = np.zeros_like(z)
                    for k in reversed(range(POWERS)):
                        total *= z
                        total += sums[k, cut]
                    near = np.abs(z) <= REACH + CELL
                    p[some] += (np.where(near, total, 0.0) * np.exp(-0.5 * z * z)).sum(1)
        p = np.maximum(p.reshape(-1, points) / (n * h * np.sqrt(2 * np.pi))[:, None], KL_EPS)
        q = np.maximum(np.concatenate([c.flatten().to_numpy() for c in windows.column("_q").chunks]).reshape(-1, points), KL_EPS)
        kl = (p * np.log(p / q)).sum(1) / p.sum(1) + np.log(q.sum(1) / p.sum(1))
        columns = {k: windows.column(k) for k in [*keys, "feature"]}
        return pa.table(columns | {"kl": pa.array(np.maximum(kl, 0.0))})

    return run


def kl_windows(current: DataFrame, reference: DataFrame, keys: list[str], features: list[str], points: int = 100) -> DataFrame:
    """``kl_kde`` of windows whose size the caller has bounded; ``current`` is wide (keys, features), ``reference`` long.

    A window is one Arrow group whose kernels are added up directly, all features in one pass. The reference density
    is evaluated from its lattice cells for ``WINDOWS_TOGETHER`` windows at a time: a group of windows (by hash) meets
    each block of cells near its points once, so no block is copied per window and no task holds more than such a group.
    """
    c = F.col
    types = dict(current.dtypes)
    ref_rows = reference.filter(c("value").isNotNull()).select("feature", "value")
    rs = materialize(_moments(ref_rows, [], "_r"), "kl-reference")
    facts = rs.collect()  # one row per feature
    ends = {r["feature"]: (r["_rlo"], r["_rhi"]) for r in facts if r["_rsp"] >= KL_EPS}
    run, schema = _window_kernels(keys, types, features, ends, points)
    wide = current.select(*keys, *[c(f).cast("double").alias(f) for f in features])
    windows = materialize(wide.groupBy(*keys).applyInArrow(run, schema), "kl-windows", **SMALL)
    both = windows.join(F.broadcast(rs), "feature", "left").withColumn("_rn", F.coalesce("_rn", F.lit(0)))
    stats = _kl_stats(both, keys, points, "_q")
    grid = stats.filter("_guard is null")
    groups = windows.count() // (WINDOWS_TOGETHER * max(1, len(features))) + 1
    grid = grid.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    # a reach is shorter than a block, so a point meets two blocks at most
    ends_of = lambda k: [F.floor((c("_g0") + k * c("_gw") + F.lit(sign * REACH) * c("_rh")) / (F.lit(CELL) * c("_rh")) / BLOCK_CELLS) for sign in (-1, 1)]
    met = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.array(*ends_of(k)))))
    wanted = grid.select("feature", "_group", F.explode(met).alias("_block")).distinct()
    ref_h = F.broadcast(rs.filter(c("_rsp") >= KL_EPS).select("feature", _scott("_r").alias("_h")))  # one row per feature
    blocks = wanted.join(_power_blocks(ref_rows.join(ref_h, "feature"), []), ["feature", "_block"]).select(c("feature").alias("_of"), c("_group").alias("_in"), "_cells")
    left = grid.select("feature", "_group", *keys, "_rn", "_rh", "_g0", "_gw", "_q")
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", feature string, kl double"
    found = left.groupBy("feature", "_group").cogroup(blocks.groupBy("_of", "_in")).applyInArrow(_against_cells(keys, points), schema)
    fixed = stats.filter("_guard is not null").select(*keys, "feature", c("_guard").alias("kl"))
    return found.unionByName(fixed)


def kl_previous(current: DataFrame, window: str, keys: list[str] = (), points: int = 100) -> DataFrame:
    """KL(window before || window) as in ``kl_kde``; windows without one before (``window`` less 1) have no row.

    Each window is summarised once; its cells serve as its own and, tagged with the next number, as those of the next
    window's reference.
    """
    keys = [*keys, window]
    of = [*keys, "feature"]
    rows = current.filter(F.col("value").isNotNull()).select(*of, "value")
    later = lambda df: df.withColumn(window, F.col(window) + 1)
    own = materialize(_moments(rows, keys, "_c"), "kl-moments")
    before = later(own.withColumnsRenamed({f"_c{m}": f"_r{m}" for m in _MOMENTS}))
    stats = materialize(_kl_stats(own.join(before, of), keys, points), "kl-stats")
    grid = stats.filter("_guard is null")
    h = own.filter(F.col("_csp") >= KL_EPS).select(*of, _scott("_c").alias("_h"))
    blocks = materialize(_power_blocks(rows.join(h, of), keys), "kl-blocks")
    p = _densities(later(blocks), grid, keys, keys, "_rh", "_rn", points, "p")
    return _kl_of(stats, p, _densities(blocks, grid, keys, keys, "_ch", "_cn", points, "q"), keys, points)


_MOMENTS = ("n", "mu", "sd", "sp", "lo", "hi")


def _moments(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    made = F.count("*"), F.avg("value"), F.stddev_samp("value"), F.stddev_pop("value"), F.min("value"), F.max("value")
    return rows.groupBy(*keys, "feature").agg(*[c.alias(f"{prefix}{m}") for m, c in zip(_MOMENTS, made)])


def _scott(prefix: str) -> Column:
    """Bandwidth by Scott's rule."""
    return F.col(f"{prefix}sd") * F.pow(F.col(f"{prefix}n").cast("double"), F.lit(-0.2))


def _kl_stats(both: DataFrame, keys: list[str], points: int, *more: str) -> DataFrame:
    """Grid, bandwidths and sizes per window and feature; ``_guard`` is the answer where there is nothing to fit."""
    flat_r, flat_c = F.col("_rsp") < KL_EPS, F.col("_csp") < KL_EPS
    guard = (
        F.when((F.col("_rn") < KL_MIN_SAMPLES) | (F.col("_cn") < KL_MIN_SAMPLES), 0.0)
        .when(flat_r & flat_c & (F.abs(F.col("_rmu") - F.col("_cmu")) < KL_EPS), 0.0)
        .when(flat_r & flat_c, 10.0)
        .when(flat_r | flat_c, 5.0)
    )
    lo, hi = F.least("_rlo", "_clo"), F.greatest("_rhi", "_chi")
    margin = F.lit(0.1) * (hi - lo + F.lit(KL_EPS))
    return both.select(
        *keys, "feature", guard.alias("_guard"), (lo - margin).alias("_g0"), (((hi + margin) - (lo - margin)) / (points - 1)).alias("_gw"),
        _scott("_r").alias("_rh"), _scott("_c").alias("_ch"), F.col("_rn").cast("double").alias("_rn"), F.col("_cn").cast("double").alias("_cn"), *more,
    )


def _kl_of(stats: DataFrame, p: DataFrame, q: DataFrame, keys: list[str], points: int) -> DataFrame:
    """(keys, feature, kl) from the densities at the grid points that have a value within reach; the others are 0."""
    zero = F.lit(0.0)
    grid = stats.filter("_guard is null")
    empty = grid.select(*keys, "feature", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"), zero.alias("p"), zero.alias("q"))
    both = empty.unionByName(p.withColumn("q", zero)).unionByName(q.withColumn("p", zero))
    floor = lambda c: F.greatest(F.sum(c), F.lit(KL_EPS)).alias(c)
    at = both.groupBy(*keys, "feature", "_k").agg(floor("p"), floor("q"))
    sums = at.groupBy(*keys, "feature").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("_a"))
    kl = F.greatest(F.col("_a") / F.col("_p") + F.log(F.col("_q") / F.col("_p")), zero)
    fixed = stats.filter("_guard is not null").select(*keys, "feature", F.col("_guard").alias("kl"))
    return sums.select(*keys, "feature", kl.alias("kl")).unionByName(fixed)


def auto_drift(
    current: DataFrame, profile: DataFrame, keys: list[str], level: float = 0.05, bounded: bool = False
) -> DataFrame:
    """Drift flag per feature by a test chosen from the data.

    More than 5 distinct reference values: KS. Two values: two-proportion z. Else: chi-square on the joint
    counts (Wilson-Hilferty tail). Flag when p < level.
    """
    from tidewatch.functions.columns import normal_two_sided_p

    kinds = profile.groupBy("feature").agg(F.count("*").alias("_d"), F.max("r_value").alias("_top"))
    kind = F.when(F.col("_d") > 5, "ks").when(F.col("_d") <= 2, "z").otherwise("chi2")
    kinds = F.broadcast(kinds.select("feature", "_top", kind.alias("test")))  # one row per feature
    cur = current.join(kinds, "feature")
    ks = ks_test(cur.filter("test = 'ks'").select(*keys, "feature", "value"), profile, keys, level, bounded)
    ks = ks.select(*keys, "feature", F.lit("ks").alias("test"), "statistic", "p_value")

    cells = collapse(cur.filter("test != 'ks'").select(*keys, "feature", "value"), keys)
    totals = cells.groupBy(*keys, "feature").agg(F.sum("n").alias("n_cur"))
    ref = F.broadcast(profile_stats(profile).select("feature", F.col("r_total").alias("n_ref")))
    # categories: the few reference values of each such feature, for every window, plus unseen ones
    small = F.broadcast(  # at most 5 rows per feature by the rule above
        profile.join(kinds, "feature").filter("test != 'ks'").select("feature", F.col("r_value").alias("value"), "r_n")
    )
    known = totals.join(small, "feature").join(
        cells.select(*keys, "feature", "value", F.col("n").alias("c_n")), [*keys, "feature", "value"], "left"
    )
    unseen = cells.join(small.select("feature", "value"), ["feature", "value"], "left_anti").join(
        totals, [*keys, "feature"]
    )
    table = known.select(*keys, "feature", "value", "n_cur", "r_n", F.coalesce("c_n", F.lit(0)).alias("c_n")).unionByName(
        unseen.select(*keys, "feature", "value", "n_cur", F.lit(0).cast("long").alias("r_n"), F.col("n").alias("c_n"))
    ).join(ref, "feature").join(kinds, "feature")
    both = F.col("r_n") + F.col("c_n")
    expect_r = both * F.col("n_ref") / (F.col("n_ref") + F.col("n_cur"))
    expect_c = both * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur"))
    chi = F.pow(F.col("r_n") - expect_r, 2) / expect_r + F.pow(F.col("c_n") - expect_c, 2) / expect_c
    agg = table.groupBy(*keys, "feature", "test").agg(
        F.sum(chi).alias("_chi"),
        (F.count("*") - 1).cast("double").alias("_df"),
        F.sum(F.when(F.col("value") == F.col("_top"), F.col("r_n")).otherwise(0)).alias("_r1"),
        F.sum(F.when(F.col("value") == F.col("_top"), F.col("c_n")).otherwise(0)).alias("_c1"),
        F.first("n_ref").alias("n_ref"),
        F.first("n_cur").alias("n_cur"),
    )
    pooled = (F.col("_r1") + F.col("_c1")) / (F.col("n_ref") + F.col("n_cur"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_ref") + 1 / F.col("n_cur")))
    z = F.when(se > 0, (F.col("_c1") / F.col("n_cur") - F.col("_r1") / F.col("n_ref")) / F.nullif(se, F.lit(0.0))).otherwise(0.0)
    d = F.lit(2.0) / (F.lit(9.0) * F.nullif(F.col("_df"), F.lit(0.0)))
    wh = (F.pow(F.col("_chi") / F.nullif(F.col("_df"), F.lit(0.0)), F.lit(1.0 / 3.0)) - (1 - d)) / F.sqrt(d)
    upper = normal_two_sided_p(wh) / 2
    chi_p = F.coalesce(F.when(wh >= 0, upper).otherwise(1 - upper), F.lit(1.0))
    cat = agg.select(
        *keys,
        "feature",
        "test",
        F.when(F.col("test") == "z", F.abs(z)).otherwise(F.col("_chi")).alias("statistic"),
        F.when(F.col("test") == "z", normal_two_sided_p(z)).otherwise(chi_p).alias("p_value"),
    )
    return ks.unionByName(cat).withColumn("flagged", F.col("p_value") < level)


def detector_summary(method_tables: dict[str, DataFrame], keys: list[str], streams: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per window and method: drift found and flagged features (sorted).

    ``streams`` are methods on a whole stream: the windows (keys, once each or more often) in which they fired. They flag no features.
    """
    parts = []
    for name, df in method_tables.items():
        flagged = F.sort_array(F.collect_list(F.when(F.col("flagged"), F.col("feature"))))  # at most all features
        parts.append(
            df.groupBy(*keys).agg(flagged.alias("flagged_features")).select(
                *keys, F.lit(name).alias("method"), (F.size("flagged_features") > 0).alias("drift_detected"), "flagged_features"
            )
        )
    windows = next(iter(method_tables.values())).select(*keys).distinct()
    for name, fired in (streams or {}).items():
        hit = fired.select(*keys).distinct().withColumn("drift_detected", F.lit(True))
        parts.append(
            windows.join(hit, keys, "left").select(
                *keys, F.lit(name).alias("method"), F.coalesce("drift_detected", F.lit(False)).alias("drift_detected"),
                F.array().cast("array<string>").alias("flagged_features"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def any_drift(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any method fired in a window, and which ones; one entry per method."""
    fired = F.sort_array(F.collect_list(F.when(F.col("drift_detected"), F.col("method"))))
    return summary.groupBy(*keys).agg(
        F.bool_or("drift_detected").alias("any_drift_detected"), fired.alias("methods_reporting_drift")
    )

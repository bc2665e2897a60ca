"""Ordered computations that survive one group holding most of the rows.

A plain window function sends a whole group to one task. Here the rows are range-partitioned on
(group, order), so a hot group is cut into many contiguous blocks; each block is scanned on its own
and a small carry table brings in what the earlier blocks of the same group hold. A block can share
at most its first and its last group with neighbours, so the carry table never has more than two rows
per block: that is the proven bound behind its broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import to_col
from tidewatch.functions.runtime import SMALL, materialize

BLOCK = "_blk_no"
POS = "_blk_row"


def into_blocks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Range-partition and sort on (keys, order); write out so that block numbers cannot change."""
    cols = [F.col(k) for k in keys] + [to_col(o) for o in order]
    laid_out = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return materialize(
        laid_out.withColumn(BLOCK, F.spark_partition_id()).withColumn(
            POS, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "blocks",
        **SMALL,
    )


def row_index(df: DataFrame, order: list, name: str = "row_idx", total: str | None = None) -> DataFrame:
    """0-based position in a total order (unique per row); ``total`` also names a row-count column."""
    b = into_blocks(df, [], order)
    sizes = b.groupBy(BLOCK).agg(F.count("*").alias("_n"))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = sizes.select(
        BLOCK,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    extra = [F.col("_total").alias(total)] if total else []
    return b.join(F.broadcast(starts), BLOCK).select(
        *df.columns, (F.col("_start") + F.col(POS)).alias(name), *extra
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    totals: bool = False,
    following: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Inclusive prefix sums per group in the given order.

    ``totals`` adds ``<name>_total`` per group; ``following`` adds ``<col>_next``, the value on the next
    row of the group. ``bounded=True`` is for groups whose size the caller has bounded (for example
    count windows): they are scanned by an ordinary window function.
    """
    ordering = [to_col(o) for o in order]
    if bounded:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
        out = [F.sum(c).over(upto).alias(n) for n, c in sums.items()]
        if totals:
            out += [F.sum(c).over(whole).alias(f"{n}_total") for n, c in sums.items()]
        if following:
            out.append(F.lead(following).over(whole.orderBy(*ordering)).alias(f"{following}_next"))
        return df.select("*", *out)

    b = into_blocks(df, keys, order)
    parts = Window.partitionBy(BLOCK, *keys)
    upto = parts.orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = [F.sum(c).over(upto).alias(n) for n, c in sums.items()]
    if totals:
        local += [F.sum(c).over(parts).alias(f"{n}_total") for n, c in sums.items()]
    if following:
        local.append(F.lead(following).over(parts.orderBy(POS)).alias(f"{following}_next"))
    scanned = b.select("*", *local)

    per = [F.sum(c).alias(n) for n, c in sums.items()]
    if following:
        per.append(F.min_by(following, POS).alias("_first"))
    per_block = b.groupBy(*keys, BLOCK).agg(*per)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    carry += [F.sum(n).over(group).alias(f"_t_{n}") for n in sums]
    if following:
        carry.append(F.lead("_first").over(group.orderBy(BLOCK)).alias("_next_first"))
    spanning = (
        per_block.select(*keys, BLOCK, *carry, F.count("*").over(group).alias("_blocks"))
        .filter("_blocks > 1")
        .drop("_blocks")
    )
    joined = _with_carry(scanned, spanning, keys)
    result = [F.col(c) for c in df.columns]
    result += [(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums]
    if totals:
        result += [F.coalesce(F.col(f"_t_{n}"), F.col(f"{n}_total")).alias(f"{n}_total") for n in sums]
    if following:
        result.append(F.coalesce(F.col(f"{following}_next"), F.col("_next_first")).alias(f"{following}_next"))
    return joined.select(*result)


def _with_carry(scanned: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Join the few carry rows to their blocks; NULL is a group key like any other."""
    names = {c: f"_at_{c}" for c in (BLOCK, *keys)}
    carry = carry.withColumnsRenamed(names)
    same = F.lit(True)
    for c, at in names.items():
        same = same & F.col(c).eqNullSafe(F.col(at))
    return scanned.join(F.broadcast(carry), same, "left").drop(*names.values())


def with_next(df: DataFrame, keys: list[str], order: str, cols: list[str], bounded: bool) -> DataFrame:
    """Add ``next_<col>``: the values on the next row of the group."""
    packed = df.withColumn("_now", F.struct(*cols))
    if bounded:
        after = F.lead("_now").over(Window.partitionBy(*keys).orderBy(order))
        packed = packed.withColumn("_now_next", after)
    else:
        packed = running_totals(packed, keys, [order], {"_one": F.lit(1)}, following="_now").drop("_one")
    return packed.select(*df.columns, *[F.col(f"_now_next.{c}").alias(f"next_{c}") for c in cols])


def grouped_index(df: DataFrame, keys: list[str], order: list, name: str = "rn", totals: bool = False) -> DataFrame:
    """1-based row number inside each group (unique order)."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")}, totals=totals)


def last_known(df: DataFrame, keys: list[str], order: list, cols: list[str]) -> DataFrame:
    """Replace NULLs in ``cols`` by the last earlier non-NULL value of the same group."""
    b = into_blocks(df, keys, order)
    upto = Window.partitionBy(BLOCK, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in df.columns if c not in cols]
    scanned = b.select(BLOCK, *kept, *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in cols])
    per_block = b.groupBy(*keys, BLOCK).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(POS))).alias(c) for c in cols]
    )
    group = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = group.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *keys,
        BLOCK,
        F.row_number().over(group).alias("_nth"),
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in cols],
    ).filter("_nth > 1")
    joined = _with_carry(scanned, carry.drop("_nth"), keys)
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def asof_lookup(
    queries: DataFrame,
    table: DataFrame,
    keys: list[str],
    at: str,
    table_at: str,
    payload: list[str],
    ties: list[str],
    forward: bool = False,
) -> DataFrame:
    """For each query row the payload of the last table row at or before ``at`` (first at or after if ``forward``).

    Queries and table are unioned and scanned once in order, so neither side is replicated. ``ties``
    makes equal query positions distinct, so that a position shared by many rows can still be split.
    Payload columns are never NULL in the table and have names that the queries do not use. They stay flat:
    primitive columns keep the per-block aggregate a hash aggregate.
    """
    clash = set(payload) & set(queries.columns)
    if clash:
        raise ValueError(f"payload columns {sorted(clash)} already exist in the queries")
    # a position that is a double already is not carried twice
    held = dict(queries.dtypes)[at] == "double" and at not in keys
    place = at if held else "_at"
    left = queries.select(*queries.columns, *([] if held else [F.col(at).cast("double").alias(place)]), F.lit(1).alias("_side"))
    right = table.select(*keys, F.col(table_at).cast("double").alias(place), F.lit(0).alias("_side"), *payload)
    both = left.unionByName(right, allowMissingColumns=True)
    order = [F.col(place).desc() if forward else F.col(place), "_side", *ties]
    scanned = last_known(both, keys, order, payload).filter("_side = 1")
    return scanned.select(*queries.columns, *payload)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group by running counts over collapsed values.

    Unlike the built-in ``percentile`` no task holds all distinct values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_totals(counts, keys, [value], {"_upto": F.col("_n")}, totals=True)
    top = F.col("_upto_total") - 1
    aggs = []
    for name, q in probs.items():
        pos = top * F.lit(float(q))
        low, high = F.floor(pos), F.ceil(pos)
        aggs += [
            F.min(F.when(F.col("_upto") > low, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > high, F.col(value))).alias(f"_hi_{name}"),
            F.first(pos - low).alias(f"_w_{name}"),
        ]
    return run.groupBy(*keys).agg(*aggs).select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )

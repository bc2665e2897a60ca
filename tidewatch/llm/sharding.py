"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Keys fall on a ring of ``slots`` positions; each belongs to the next virtual node clockwise. A shard
holds at most ``(1 + slack) * rows / shards`` rows; what a full shard cannot take goes on clockwise to
the next virtual node whose shard has room. With slack 0 the capacities add up to the rows, so the
counts are at most one apart; a larger slack moves fewer rows when shards or rows come and go.

The walk needs only the number of rows on each ring slot: at most ``slots`` counts, whatever the input,
aggregated by Spark. The plan it yields (row ranks of a slot -> shard) goes back as a broadcast of at
most ``slots + virtual nodes`` segments. Rows are ranked within a ring slot, about rows / slots of them,
so no task sorts a whole shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import literal_rows


def virtual_nodes(shards: int, per_shard: int, slots: int) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise; two on one slot stay in the order of their shards."""
    place = lambda s, v: int.from_bytes(hashlib.md5(f"{s}|{v}".encode()).digest()[:8], "big") % slots
    return sorted((place(s, v), s) for s in range(shards) for v in range(per_shard))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold. Without slack they add up to the rows exactly."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(-(-rows * (1 + slack) // shards))] * shards


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (ring slot, first rank, end rank, shard, place of the first row in that shard), slot by slot."""
    room, filled = list(room), [0] * len(room)
    ahead = list(range(len(nodes)))  # a node's next one clockwise that may have room

    def open_from(i: int) -> int:
        path = []
        for _ in range(2 * len(nodes)):
            if room[nodes[i][1]]:
                break
            path.append(i)
            i = ahead[i] if ahead[i] != i else (i + 1) % len(nodes)
        for j in path:
            ahead[j] = i
        return i

    segments, at = [], 0
    for slot in sorted(counts):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        node, rank, left = at % len(nodes), 0, counts[slot]
        while left:
            node = open_from(node)
            shard = nodes[node][1]
            take = min(left, room[shard])
            segments.append((slot, rank, rank + take, shard, filled[shard]))
            room[shard], filled[shard] = room[shard] - take, filled[shard] + take
            rank, left = rank + take, left - take
    return segments


def assign(
    docs: DataFrame,
    key: Column,
    shards: int = 40,
    slack: float = 0.0,
    per_shard: int = 64,
    slots: int = 1 << 16,
    names: tuple[str, str] = ("shard", "slot"),
) -> DataFrame:
    """Add the shard and the row's gapless place in it. ``key``: decides the place on the ring.

    Every row gets a shard, NULL and repeated keys too (rows of one key are neighbours on the ring);
    an empty table stays empty. Columns of the same name as the two results are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    held = docs.columns
    # the original columns travel under one name, so none can clash with a working column
    on_ring = docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.xxhash64(key).alias("h"))
    on_ring = on_ring.withColumn("ring", F.col("h").bitwiseAND(F.lit(slots - 1)).cast("int"))
    counts = {r["ring"]: r["n"] for r in on_ring.groupBy("ring").agg(F.count("*").alias("n")).collect()}
    nodes = virtual_nodes(shards, per_shard, slots)
    plan = walk(counts, nodes, capacities(sum(counts.values()), shards, slack))
    segments = literal_rows(spark, plan, "at int, first long, last long, shard int, base long")
    ranked = on_ring.withColumn(
        "rank", F.row_number().over(W.partitionBy("ring").orderBy("h", F.xxhash64("row"))).cast("long") - 1
    )
    match = (F.col("ring") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked.join(F.broadcast(segments), match)
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in held],
        F.col("shard").alias(names[0]),
        (F.col("base") + F.col("rank") - F.col("first")).alias(names[1]),
    )


def ring_key(doc_id: Column, text: Column) -> Column:
    """The id; rows without one are told apart by their text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))


def query(spark, sf_dir) -> DataFrame:
    """op3: all documents over 40 shards whose row counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text").cast("binary")
    facts = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        ring_key(F.col("doc_id"), F.md5(text)).alias("ring_key"),
    )
    return assign(facts, F.col("ring_key"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

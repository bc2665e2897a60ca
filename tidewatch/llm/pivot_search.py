"""Exact top-k by inner product with a pivot-distance index.

Every vector gets one more component that brings all to one length, so that the largest inner product is the
smallest distance. A vector's key is its nearest pivot and the distance to it; vectors of one pivot are sorted by
that distance and cut into annuli of at most ``ANNULUS`` rows, stored as one matrix each. A query at distance d
from a pivot can only be within r of a vector of annulus [lo, hi] if lo - r <= d <= hi + r. Searching expands
annuli in waves: first the one that holds the query, which bounds r from above by its k-th hit; then all
that the triangle inequality still allows, in batches of queries per annulus. Hits are merged per query by
score, each annulus giving at most k. Pivots are a bounded sample; every vector is indexed and the result is
exact. Sums are exact integers while dimension * max^2 stays below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize

#: Pivots, and rows of one annulus.
PIVOTS = 64
ANNULUS = 256
#: Queries that search an annulus together.
TOGETHER = 512
#: Added to every bound: distances are rounded floats.
SLACK = 1e-6


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of rows with an id and finite components only; an empty vector is left out."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to one width."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    values = column.values.to_numpy()[column.offsets[0].as_py() :]
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values[: len(row)]
    return out


def build_index(rows: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, float]:
    """(annuli, pivots, common squared length). Annuli: pivot, lo, hi, ids array, m (matrix bytes)."""
    facts = rows.agg(F.max(F.size("v")).alias("w"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("r2")).first()
    width, length2 = facts["w"] or 1, facts["r2"] or 0.0
    # the ids with the smallest hashes, whatever the number of rows
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").toArrow()
    base = _matrix(chosen.column("v").combine_chunks(), width) if chosen.num_rows else np.zeros((1, width))
    base = np.hstack([base, np.sqrt(np.maximum(0, length2 - (base**2).sum(1)))[:, None]])
    norms = (base**2).sum(1)

    def keys(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width)
            extra = np.sqrt(np.maximum(0, length2 - (x**2).sum(1)))
            d2 = length2 + norms[None] - 2 * (x @ base[:, :-1].T + extra[:, None] * base[None, :, -1])
            near = d2.argmin(1)
            d = np.sqrt(np.maximum(0, d2[np.arange(len(x)), near]))
            rows_ = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(d), rows_], ["vec_id", "pivot", "d", "x"])

    def annuli(batches):
        held, pivot = [], None

        def flush():
            ids, d, x = ([r[i] for r in held] for i in range(3))
            return pa.RecordBatch.from_arrays(
                [pa.array([pivot], pa.int32()), pa.array([d[0]]), pa.array([d[-1]]), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(x)], pa.binary())],
                ["pivot", "lo", "hi", "ids", "m"],
            )

        for batch in batches:
            for vec_id, p, d, x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != pivot or len(held) == ANNULUS):
                    yield flush()
                    held = []
                pivot = p
                held.append((vec_id, d, x))
        if held:
            yield flush()

    keyed = materialize(rows.mapInArrow(keys, "vec_id long, pivot int, d double, x binary"), "pivot-keys")
    # a crowded pivot is cut by distance, equal distances by id
    sorted_ = keyed.repartitionByRange("pivot", "d", "vec_id").sortWithinPartitions("pivot", "d", "vec_id")
    index = sorted_.mapInArrow(annuli, "pivot int, lo double, hi double, ids array<long>, m binary")
    index = index.withColumn("annulus", F.xxhash64("pivot", "lo", "hi", F.element_at("ids", 1)))
    return materialize(index, "annuli"), base, length2


def _search(pairs: DataFrame, index: DataFrame, k: int, width: int, salts: int) -> DataFrame:
    """Best k of each (query, annulus) pair: query_id, vec_id, score. ``pairs``: query_id, q, annulus."""

    def scan(batches):
        for batch in batches:
            out = ([], [], [])
            for asked, qs, ids, m in zip(*(c.to_pylist() for c in batch.columns)):
                m = np.frombuffer(m, np.float64).reshape(-1, width)
                q = np.frombuffer(b"".join(qs), np.float64).reshape(-1, width)
                ids, asked = np.array(ids), np.array(asked)
                exact = np.abs(m).max(initial=0) * np.abs(q).max(initial=0) * width < 2**53
                scores = q @ m.T if exact else (q.astype(np.int64) @ m.T.astype(np.int64))
                for i, row in enumerate(scores):
                    order = np.lexsort((ids, -row))
                    order = order[ids[order] != asked[i]][:k]
                    out[0].append(np.full(len(order), asked[i])), out[1].append(ids[order]), out[2].append(row[order].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out] if out[0] else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    # a matrix travels once for about TOGETHER queries, not once for each
    salted = pairs.groupBy("annulus", F.pmod(F.xxhash64("query_id"), F.lit(salts)).alias("salt"))
    # both lists from one, so that they keep the same order
    together = salted.agg(F.collect_list(F.struct("query_id", "q")).alias("all"))
    found = together.join(index.select("annulus", "ids", "m"), "annulus").select(F.col("all.query_id"), F.col("all.q"), "ids", "m")
    return found.mapInArrow(scan, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products, ties to the smaller vec_id.

    ``vectors``, ``queries``: vec_id, embedding. A query is never its own candidate; rows of one id count as one
    vector each but all as "own". Rows that are NULL, empty or not finite take no part; shorter vectors count as
    filled up with zeros. With fewer than k candidates all are given; without any, none.
    """
    rows = usable(vectors, scale)
    index, base, length2 = build_index(rows, pivots)
    width, norms = base.shape[1] - 1, (base**2).sum(1)

    def aim(batches):
        """Distance of each query to each pivot; one row per pivot."""
        for batch in batches:
            x = np.zeros((batch.num_rows, width))
            mine = _matrix(batch.column(1), max(width, int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=0))))
            x[:] = mine[:, :width]
            # queries lie at height 0; their own length enters the distance
            d2 = (x**2).sum(1)[:, None] + norms[None] - 2 * (x @ base[:, :-1].T)
            d = np.sqrt(np.maximum(0, d2))
            ids = batch.column(0).to_numpy()
            body = pa.array([r.tobytes() for r in x], pa.binary())
            near = np.zeros(d.shape, bool)
            near[np.arange(len(x)), d.argmin(1)] = True
            take = pa.array(np.repeat(np.arange(len(x)), len(base)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, len(base))), pa.array(np.repeat((x**2).sum(1), len(base))), body.take(take), pa.array(np.tile(np.arange(len(base), dtype=np.int32), len(x))), pa.array(d.ravel()), pa.array(near.ravel())],
                ["query_id", "q2", "q", "pivot", "dq", "near"],
            )

    asked = materialize(usable(queries, scale).mapInArrow(aim, "query_id long, q2 double, q binary, pivot int, dq double, near boolean"), "queries")
    salts = 1 + asked.count() // len(base) // TOGETHER
    meta = index.select("pivot", "lo", "hi", F.size("ids").alias("rows"), "annulus")
    # wave 1: of the nearest pivot, the annulus nearest to the query's own distance
    gap = F.greatest(F.col("lo") - F.col("dq"), F.col("dq") - F.col("hi"), F.lit(0.0))
    home = asked.filter("near").join(meta, "pivot").groupBy("query_id").agg(F.min_by("annulus", F.struct(gap, -F.col("rows"), "annulus")).alias("annulus"), F.first("q").alias("q"), F.first("q2").alias("q2"))
    home = materialize(home, "home")
    first = materialize(_search(home.select("query_id", "q", "annulus"), index, k, width, salts), "hits")
    # squared distance of a hit: |q|^2 + length^2 - 2 * score
    worst = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    worst = worst.filter(F.col("n") >= k)
    reach = home.join(worst, "query_id", "left").select(
        "query_id", F.col("annulus").alias("done"),
        F.when(F.col("kth").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("q2") + length2 - 2 * F.col("kth")))).alias("r"),
    )
    # wave 2: every annulus within reach; a query without k hits yet reaches all
    near = F.col("r").isNull() | (gap <= F.col("r") * (1 + SLACK) + SLACK)
    rest = asked.join(reach, "query_id").join(meta, "pivot").filter(near & (F.col("annulus") != F.col("done")))
    second = _search(rest.select("query_id", "q", "annulus"), index, k, width, salts)
    hits = first.unionByName(second)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir) -> DataFrame:
    """op6: the five nearest by inner product of every 50th vector, among all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

"""The corpus pipeline: toxicity, near copies, decontamination, mixing, sharding; each stage on all that the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import decontamination, jaccard_join, mixing, sharding, toxicity

SHARDS = 40


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled ones among them, does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free(docs, "_toxicity")
    return toxicity.score(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id; documents without words all stay.

    Where ids are missing or repeated, rows are told apart by their place in the table instead.
    """
    columns = docs.columns
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull()))
    most, missing = ids.first()
    by_place = (most or 0) > 1 or missing
    if by_place:
        docs = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.monotonically_increasing_id().alias("doc_id")), "rows")
        docs = docs.select("row", "doc_id", F.col("row.text").alias("text"))
    found = jaccard_join.near_copies(docs.select("doc_id", "text"), words=5, t=80)
    stay = found.filter(F.col("label").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id")
    kept = docs.join(stay, "doc_id", "left_semi")
    return kept.select("row.*") if by_place else kept.select(*[F.col(f"`{c}`") for c in columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    columns = docs.columns
    _, hits = decontamination.found_windows(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    rk, id_ = _free(docs, "_rk"), _free(docs, "_id")
    hit = hits.select(F.col("rk").alias(rk), F.col("doc_id").alias(id_)).distinct()
    same = (F.xxhash64("doc_id", "text") == F.col(rk)) & F.col("doc_id").eqNullSafe(F.col(id_))
    return docs.join(hit, same, "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that the sources meet their targets."""
    columns = docs.columns
    key = mixing.document_key(F.col("doc_id"), F.col("text"))
    sizes = materialize(docs.select("source", mixing.word_count(F.col("text")).alias("size"), key.alias("key")), "mix-sizes")
    mixed = mixing.mix(sizes, mixing.weighted_targets(sizes, mixing.WEIGHTS))
    to, of, times, copy = (_free(docs, name) for name in ("_key", "_of", "_copies", "_copy"))
    copies = mixed.groupBy(F.col("key").alias(to), F.col("source").alias(of)).agg(F.max("copies").alias(times)).filter(F.col(times) > 0)
    taken = docs.join(copies, (key == F.col(to)) & F.col("source").eqNullSafe(F.col(of))).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return taken.select(*[F.col(f"`{c}`") for c in columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and place in it."""
    key = sharding.ring_key(F.col("doc_id"), F.md5(F.col("text").cast("binary")))
    return sharding.assign(docs, key, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity model is fitted, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

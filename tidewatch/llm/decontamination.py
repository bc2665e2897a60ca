"""Find benchmark passages in documents: a prefix-filtered join on rare shingles with exact windows.

An item is a set of windows of ``window`` consecutive words (a shorter item is one window). A window is
contained in a document only if every one of its shingles is there in order, so one shingle is a
sufficient prefix, and the rarest is the cheapest. Steps, all DataFrame operations:

1. document shingles that any item has, with their positions (one scan of the texts; the item shingles
   are broadcast when their counted number is within ``broadcast_rows``, else joined by shuffle);
2. corpus frequency of those shingles; the rarest of each window is its prefix; windows of which some
   shingle occurs nowhere are dropped;
3. occurrences of the prefix give candidate windows, kept within the document by position and length;
4. a candidate is confirmed when all its shingles stand at their exact places.

Shingles are compared by 64-bit hash; a window is confirmed by up to ``window - shingle + 1`` of them at
consecutive places. Row counts follow the shingles that documents really share with items; no pair of
documents is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm.common import ascii_lower

#: Stands for a document's own row among its shingle hashes.
DOCUMENT = 0
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words of letters, digits and everything beyond ASCII. NULL text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def shingle_at(words: Column, at: Column, k: int) -> Column:
    """Hash of k words from a 0-based place; beyond the end the missing words are skipped."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _shingles(places: Column, k: int) -> Column:
    return F.transform(places, lambda i: shingle_at(F.col("words"), i, k))


def _hashes(words: Column, k: int) -> Column:
    return F.transform(words, lambda w, i: shingle_at(words, i, k))


def _document_hashes(words: Column, lengths: list[int]) -> Column:
    """Number of words n, and hashes: DOCUMENT, then n shingle hashes for each length in turn."""
    own = F.array(F.lit(DOCUMENT))
    # bound to a lambda variable, the words are computed once for all their uses
    facts = lambda ws: F.struct(F.size(ws).alias("n"), F.concat(own, *[_hashes(ws, k) for k in lengths]).alias("all"))
    return F.get(F.transform(F.array(words), facts), F.lit(0))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct (item_id, w, len, k, toks): window text, words in it, shingle length, shingle hashes in order."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    words = words.filter((F.size("words") > 0) & F.col("item_id").isNotNull())
    words = words.withColumn("len", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)
    cut = words.select("item_id", "len", F.explode(starts).alias("at"), "words")
    cut = cut.select("item_id", "len", F.slice("words", F.col("at"), F.col("len")).alias("words"))
    cut = cut.withColumn("k", F.least("len", F.lit(shingle)))
    toks = None
    for k in range(1, shingle + 1):
        places = F.sequence(F.lit(0), F.col("len") - k)
        each = _shingles(places, k)
        toks = F.when(F.col("k") == k, each) if toks is None else toks.when(F.col("k") == k, each)
    return cut.select("item_id", F.concat_ws(" ", "words").alias("w"), "len", "k", toks.alias("toks")).distinct()


def found_windows(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, broadcast_rows: int = 1_000_000):
    """(documents, hits): ``rk, doc_id, n_words`` per document row and ``rk, doc_id, start, len, item_id`` per occurrence.

    ``docs``: doc_id, text; ``items``: item_id, text. NULL or wordless texts have no words and no hits; items
    without words or id match nothing. ``rk`` tells rows of one id apart by text; equal rows share their hits.
    """
    spark = docs.sparkSession
    windows = materialize(item_windows(items, window, shingle), "decon-windows")
    wanted = windows.select(F.explode("toks").alias("tok")).distinct().unionByName(
        spark.range(1).select(F.lit(DOCUMENT).cast("long").alias("tok"))
    )
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most ``shingle`` values
    n_wanted = wanted.count()

    texts = docs.select("doc_id", "text").withColumn("rk", F.xxhash64("doc_id", "text"))
    texts = texts.select("doc_id", "rk", _document_hashes(words_of(F.col("text")), lengths).alias("f"))
    seen = texts.select("doc_id", "rk", F.col("f.n").alias("n_words"), F.posexplode("f.all").alias("p", "tok"))
    seen = seen.join(F.broadcast(wanted) if n_wanted <= broadcast_rows else wanted, "tok")
    seen = materialize(seen, "decon-seen")
    documents = seen.filter("p = 0").select("doc_id", "rk", "n_words")
    # place of the shingle: the hashes of each length follow one another, n_words at a time
    seen = seen.filter("p > 0").withColumn("pos", (F.col("p") - 1) % F.col("n_words")).drop("p").distinct()

    frequency = seen.groupBy("tok").agg(F.count("*").alias("tf"))
    single = windows.select("w", "len", "k", "toks").distinct()
    placed = single.select("w", "len", "k", F.posexplode("toks").alias("off", "tok"))
    ranked = placed.join(frequency, "tok").groupBy("w", "len", "k").agg(
        F.count("*").alias("present"), F.min_by(F.struct("off", "tok"), F.struct("tf", "tok", "off")).alias("rare")
    )
    prefix = ranked.filter(F.col("present") == F.col("len") - F.col("k") + 1)
    prefix = materialize(prefix.select("w", "len", "k", "rare.off", "rare.tok"), "decon-prefix")

    at = seen.join(prefix, "tok").withColumn("start", F.col("pos") - F.col("off"))
    at = at.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    candidate = at.select("doc_id", "rk", "w", "len", "k", "start")
    steps = candidate.join(single.select("w", "toks"), "w")
    steps = steps.select("doc_id", "rk", "w", "len", "k", "start", F.posexplode("toks").alias("off", "tok"))
    steps = steps.withColumn("pos", F.col("start") + F.col("off"))
    there = seen.select("rk", F.col("doc_id").alias("d"), "tok", "pos")
    met = steps.join(there, ["rk", "tok", "pos"]).filter(F.col("doc_id").eqNullSafe(F.col("d")))
    sure = met.groupBy("doc_id", "rk", "w", "len", "k", "start").agg(F.count("*").alias("n"))
    sure = sure.filter(F.col("n") == F.col("len") - F.col("k") + 1)
    hits = sure.join(windows.select("w", "item_id"), "w").select("doc_id", "rk", "start", "len", "item_id")
    return documents, materialize(hits, "decon-hits")


def summarize(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per document: words, words inside any hit, items hit and the digest of their sorted ids."""
    spans = hits.select("doc_id", "rk", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = W.partitionBy("rk", "doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("rk", "doc_id").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("rk", "doc_id", "item_id").distinct().groupBy("rk", "doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    for part, value in ((covered, "n_hit"), (named, "items")):
        part = part.select(F.col("rk").alias("rk2"), F.col("doc_id").alias("d2"), value)
        same = (F.col("rk") == F.col("rk2")) & F.col("doc_id").eqNullSafe(F.col("d2"))
        documents = documents.join(part, same, "left").drop("rk2", "d2")
    ids = F.coalesce(F.concat_ws(",", "items"), F.lit(""))
    return documents.select(
        "doc_id",
        "rk",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def query(spark, sf_dir) -> DataFrame:
    """op8: every document against every benchmark item, windows of 10 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return summarize(*found_windows(docs, items, window=10)).drop("rk")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
l AS (SELECT *, least(len(words), 10) AS n FROM b WHERE len(words) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM l, unnest(generate_series(1, len(words) - n + 1)) AS s(i)),
dw AS (
  SELECT r, doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM d, (SELECT DISTINCT n FROM bw) AS k(n), unnest(generate_series(1, len(words) - n + 1)) AS s(i)),
hits AS (SELECT DISTINCT r, i, n, item_id FROM dw JOIN bw USING (n, w)),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS s(p) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

"""Mix sources to target weights with Pareto order sampling.

A source whose target is f times its size gives floor(f) whole copies of every document for certain; the words
left are sampled. Every document has its own inclusion probability: proportional to its length class (the power
of two not above its words), scaled so that the expected words are those left. Where that reaches 1 the document
is certain, and the others are scaled again to what stays. A document's rank is the odds of a random number that
depends on its id alone, divided by its inclusion odds; documents enter in rank order while their words fit, so
the size of the sample, counted in words, is fixed.

What the first document that does not fit leaves open is filled the same way from the documents small enough. If
a round would fill less than half of what is open, the document that blocks it, which is larger than that, is
taken instead. So every round halves the words open: after ``rounds`` rounds a source lacks less than its longest
document / 2 ** (rounds - 1), or less than every document it did not take.

Running sums never sort a source in one task: ranks fall into about sqrt(rows) bins of equal width in log rank,
the bins of a source are summed first (combined map-side), and only the rows of the bin that crosses the target
are sorted. Both levels hold about sqrt(rows) rows; length classes are at most 63 a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm.common import SPACED_WORD

#: 13 hexadecimal digits: 52 bits.
DIGITS = 13


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def uniform(key, seed: str):
    """A number in (0, 1) that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), key).cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def weighted_targets(sizes: DataFrame, weights: list[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per source: words, target. Weights repeat over the sources in code-point order, NULL last.

    Targets divide ``share`` of all words by weight; a source stops at ``most`` times its words and the
    excess is shared again by weight. With the sources in order of cap / weight the capped ones come
    first, so the level is found from running sums, without rounds. One row per source is sorted.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    rows = by_source.withColumn("place", place).withColumn("w", weight)
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("w"), "place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("words_left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("weight_left"),
    )
    level = F.col("words_left") / F.col("weight_left")
    capped = F.col("cap") / F.col("w") <= level
    # the first source that is not capped sets the level of all after it
    rows = rows.withColumn("step", F.row_number().over(order))
    first = F.min(F.when(~capped, F.struct("step", level.alias("v")))).over(everything)
    rows = rows.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("step") < F.col("first.step")), F.col("cap")).otherwise(F.col("first.v") * F.col("w"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def inclusion(units: DataFrame) -> DataFrame:
    """One row per source: ``top``, the largest length class that is not certain, and ``scale``, probability / class.

    ``units``: source, size, w (length class), room (words to sample). Classes above ``top`` are certain.
    """
    classes = units.groupBy("source", "w").agg(F.sum("size").alias("words"), F.max("room").alias("room"))
    down = W.partitionBy("source").orderBy(F.desc("w"))
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("words") * F.col("w").cast("double")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    classes = classes.withColumn("scale", (F.col("room") - larger) / mass).filter(F.col("scale") * F.col("w") < 1)
    return classes.groupBy("source").agg(F.max("w").alias("top"), F.max_by("scale", "w").alias("scale"))


def _fill(open_: DataFrame, bins: int) -> DataFrame:
    """The units that enter: in rank order while the words fit into the room of their source, or the one that blocks them."""
    fits = open_.withColumn("bin", F.floor(F.log("q") * bins).cast("long"))
    sums = fits.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("room").alias("room"))
    upto = W.partitionBy("source").orderBy("bin")
    sums = sums.withColumn("upto", F.sum("words").over(upto))
    # bins that fit whole, and the first that does not
    sums = sums.filter(F.col("upto") - F.col("words") < F.col("room"))
    sums = sums.select(F.col("source").alias("s"), F.col("bin").alias("b"), (F.col("upto") - F.col("words")).alias("before"), (F.col("upto") <= F.col("room")).alias("inside"))
    sums = materialize(sums, "mix-bins")

    def rows(kind):
        return fits.join(sums.filter(kind), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))

    running = F.sum("size").over(W.partitionBy("source").orderBy("q", "key").rowsBetween(W.unboundedPreceding, 0))
    edge = materialize(rows(~F.col("inside")).withColumn("cum", F.col("before") + running).select("source", "key", "size", "room", "cum"), "mix-edge")
    before = F.col("cum") - F.col("size")
    blocking = edge.filter((F.col("cum") > F.col("room")) & (before * 2 < F.col("room"))).filter(before <= F.col("room"))
    alone = blocking.select(F.col("source").alias("a"))
    prefix = rows(F.col("inside")).select("source", "key", "size").unionByName(edge.filter(F.col("cum") <= F.col("room")).select("source", "key", "size"))
    prefix = prefix.join(alone, F.col("source").eqNullSafe(F.col("a")), "left_anti")
    return prefix.unionByName(blocking.select("source", "key", "size"))


def mix(docs: DataFrame, targets: DataFrame, seed: str = "mix", rounds: int = 6) -> DataFrame:
    """Copies per document. ``docs``: key (string, not NULL), source, size; ``targets``: source, source_size, target.

    Returns key, source, size, source_size, target, copies: whole copies plus at most one sampled. Rows of a
    source that repeat a key are one unit of all their words: they share its fate and never exceed the room.
    A source without words, and a document without, takes no sampled copy; empty input gives an empty result.
    """
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(times)).withColumn("room", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan.withColumnRenamed("source", "s"), "mix-plan")
    here = F.col("source").eqNullSafe(F.col("s"))
    units = docs.groupBy("source", "key").agg(F.sum("size").alias("size")).filter(F.col("size") > 0)
    units = units.join(plan.select("s", "room"), here).filter(F.col("room") > 0).drop("s")
    units = materialize(units.withColumn("w", F.expr("shiftleft(1L, length(bin(size)) - 1)")), "mix-units")
    levels = materialize(inclusion(units).withColumnRenamed("source", "s"), "mix-levels")
    units = units.join(levels, here, "left").drop("s")
    certain = F.col("top").isNull() | (F.col("w") > F.col("top"))
    chosen = [materialize(units.filter(certain).select("source", "key", "size"), "mix-taken")]
    p, u = F.col("scale") * F.col("w"), uniform(F.col("key"), seed)
    open_ = units.filter(~certain & (F.col("scale") > 0)).withColumn("q", (u / (1 - u)) / (p / (1 - p))).select("source", "key", "size", "room", "q")
    bins = max(1, math.isqrt(units.count()) // 8)
    for _ in range(rounds):
        used = chosen[-1].groupBy("source").agg(F.sum("size").alias("used")).withColumnRenamed("source", "s")
        gone = chosen[-1].select(F.col("source").alias("g"), F.col("key").alias("k"))
        open_ = open_.join(gone, F.col("source").eqNullSafe(F.col("g")) & (F.col("key") == F.col("k")), "left_anti")
        open_ = open_.join(used, here, "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0))).drop("s", "used")
        open_ = materialize(open_.filter(F.col("size") <= F.col("room")), "mix-open")
        if open_.isEmpty():
            break
        chosen.append(materialize(_fill(open_, bins), "mix-taken"))
    taken = chosen[0]
    for more in chosen[1:]:
        taken = taken.unionByName(more)
    taken = taken.select(F.col("source").alias("g"), F.col("key").alias("k"), F.lit(1).alias("hit"))
    rows = docs.join(plan, here).join(taken, F.col("source").eqNullSafe(F.col("g")) & (F.col("key") == F.col("k")), "left")
    copies = F.col("whole") + F.when(F.col("size") > 0, F.coalesce("hit", F.lit(0))).otherwise(0)
    return rows.select("key", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def document_key(doc_id, text):
    """The id as text; rows without one are told apart by their text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(F.md5(text.cast("binary")), F.lit("none"))))


#: Weights that repeat over the sources in order.
WEIGHTS = [1.0, 2.0, 3.0]


def query(spark, sf_dir) -> DataFrame:
    """op2: all documents mixed to weights 1, 2, 3 by source; words taken per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text")).alias("key"))
    sizes = materialize(sizes, "mix-sizes")
    mixed = mix(sizes.drop("doc_id"), weighted_targets(sizes, WEIGHTS))
    back = F.when(F.col("key").startswith("text:"), None).otherwise(F.col("key")).cast("long")
    return mixed.select(back.alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w, 3.0::DOUBLE * source_size AS cap FROM by_source),
ordered AS (
  SELECT *, row_number() OVER o AS step, (SELECT sum(source_size) FROM by_source) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    (SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM weighed WINDOW o AS (ORDER BY cap / w, source IS NULL, encode(source))),
level AS (
  SELECT arg_min(words_left / weight_left, step) AS v, min(step) AS step FROM ordered WHERE cap / w > words_left / weight_left),
targets AS (
  SELECT source, source_size, (CASE WHEN v IS NULL OR ordered.step < level.step THEN cap ELSE v * w END)::DOUBLE AS target FROM ordered, level),
sized AS (
  SELECT doc_id, docs.source, size, source_size, target, floor(target / greatest(source_size, 1))::INT AS whole,
    (('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    target - floor(target / greatest(source_size, 1)) * source_size AS room,
    CASE WHEN size > 0 THEN (1::BIGINT << (length(bin(size)) - 1))::DOUBLE END AS w
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
classes AS (
  SELECT source, w, sum(size)::DOUBLE AS words, max(room) AS room FROM sized WHERE size > 0 AND room > 0 GROUP BY source, w),
scales AS (
  SELECT source, w, (room - coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(words * w) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM classes),
levels AS (
  SELECT source, max(w) AS top, arg_max(scale, w) AS scale FROM scales WHERE scale * w < 1 GROUP BY source),
marked AS (
  SELECT s.*, scale, coalesce(size > 0 AND room > 0 AND (top IS NULL OR w > top), false) AS certain
  FROM sized s LEFT JOIN levels l ON s.source IS NOT DISTINCT FROM l.source),
r0 AS MATERIALIZED (
  SELECT doc_id, source, size, source_size, target, whole, certain::INT AS chosen,
    CASE WHEN NOT certain AND size > 0 AND scale > 0 THEN (u / (1 - u)) / (scale * w / (1 - scale * w)) END AS q,
    room - coalesce(sum(size) FILTER (certain) OVER (PARTITION BY source), 0) AS room
  FROM marked)
"""


def _oracle(rounds: int = 6) -> str:
    sql = ORACLE
    for i in range(rounds):
        sql += f""",
c{i} AS MATERIALIZED (SELECT doc_id, source, size, room, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS cum
  FROM r{i} WHERE chosen = 0 AND q IS NOT NULL AND size <= room),
b{i} AS (SELECT doc_id, source FROM c{i} WHERE cum > room AND (cum - size) * 2 < room),
h{i} AS MATERIALIZED (SELECT doc_id, source, size FROM c{i} c WHERE doc_id IN (SELECT doc_id FROM b{i})
  OR (cum <= room AND NOT EXISTS (SELECT 1 FROM b{i} b WHERE b.source IS NOT DISTINCT FROM c.source))),
r{i + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (chosen, room), greatest(chosen, (h.doc_id IS NOT NULL)::INT) AS chosen, room - coalesce(used, 0) AS room
  FROM r{i} r LEFT JOIN h{i} h USING (doc_id)
  LEFT JOIN (SELECT source, sum(size) AS used FROM h{i} GROUP BY source) s ON s.source IS NOT DISTINCT FROM r.source)"""
    return sql + f"\nSELECT doc_id, size, source_size, target, ((whole + chosen) * size)::BIGINT AS taken FROM r{rounds}"


ORACLE_SQL = _oracle()

"""Ranked lexical search by pipelined term partitioning.

Query terms are dealt to owners by their document counts, rare ones first, with about equal numbers of postings.
Documents lie in blocks, items in bundles. A bundle travels with the sparse accumulators of a block from owner to
owner: each stage cogroups them with the owner's postings of the block and adds whole-number contributions. After a
stage an item keeps the documents that can still be among its best of the block: score so far plus the most that
its later terms can add, against the k-th best score so far. Where even all later terms together stay below that, no
new document enters. Both bounds are exact, so nothing that belongs to the result is lost; the block's best meet in
one ranking per item, cut map-side.

Terms are learnt from the items only: documents are read once per ``SENT_TERMS`` distinct item terms, which are what
is broadcast. Every item meets every block (a stated query set against all rows, in blocks), nothing else multiplies.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import word_hash
from tidewatch.llm.common import UPPER, discard
from tidewatch.operators.ordered import row_index, running_totals

#: Documents of a block, items of a bundle, owners of each slice of terms.
BLOCK_DOCS, BUNDLE, OWNERS = 4096, 256, 4
#: Terms known to a task at a time (sent to every executor); more are taken in several readings of the documents.
SENT_TERMS = 1 << 18
#: Bytes that are no part of a term become blanks; only A-Z are lower-cased.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_STATE = {
    "item": "long", "item_id": "long", "t_end": "int", "t_id": "int", "t_w": "long", "t_most": "long", "t_owner": "int",
    "n": "long", "doc_id": "long", "a_end": "int", "a_doc": "short", "a_score": "long", "floor": "long",
}
_TYPES = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16()}


def item_terms(items: DataFrame, key: str) -> DataFrame:
    """Distinct (key, term) of all items; rows that repeat a key are one item."""
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, UPPER.lower())
    return items.select(F.col(key), F.explode(F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).alias("term")).distinct()


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """One row per block of documents: ids, term counts, and postings (term, place, tf) of the known terms, by term."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def emit(batches):
        known = {t: i for i, t in enumerate(sent.value)}
        task, held, number, many = TaskContext.get().partitionId(), [], 0, max(len(known), 1)

        def flush():
            ids, n, term, place, tf = (np.concatenate(x) if i else pa.concat_arrays(x) for i, x in enumerate(zip(*held)))
            order = np.argsort(term, kind="stable")
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + number]), "some": pa.array([int((n > 0).sum())]), "words": pa.array([int(n.sum())]), "n": pa.array([n]),
                "doc_id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "term": pa.array([term[order].astype(np.int32)]), "place": pa.array([place[order].astype(np.int16)]), "tf": pa.array([tf[order].astype(np.int32)]),
            })

        rows = 0
        for batch in batches:
            for at, texts in word_hash.chunks(batch.column(1), 1 << 20):
                while texts:
                    now, texts = texts[: BLOCK_DOCS - rows], texts[BLOCK_DOCS - rows :]
                    words = [t.translate(_TERM_BYTES).split() for t in now]
                    n = np.array([len(w) for w in words], np.int64)
                    ids = np.fromiter((i for w in words for i in map(known.get, w, repeat(-1))), np.int64, n.sum())
                    key = np.repeat(np.arange(len(now)) + rows, n) * many + ids
                    key, tf = np.unique(key[ids >= 0], return_counts=True)
                    held.append((batch.column(0).slice(at, len(now)), n, key % many, key // many, tf))
                    rows, at = rows + len(now), at + len(now)
                    if rows == BLOCK_DOCS:
                        yield flush()
                        held, rows, number = [], 0, number + 1
        if held:
            yield flush()

    schema = "block long, some long, words long, n array<long>, doc_id array<long>, term array<int>, place array<short>, tf array<int>"
    return docs.mapInArrow(emit, schema)


def _document_counts(batches):
    """(id, df, tf): documents that hold each term and its most occurrences in one, per block."""
    for batch in batches:
        for i in range(batch.num_rows):
            term, tf = (batch.column(c)[i].values.to_numpy() for c in (0, 1))
            if len(term):
                ids, first, df = np.unique(term, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(df), pa.array(np.maximum.reduceat(tf, first).astype(np.int64))], ["id", "df", "tf"])


def _owned(owner: np.ndarray, mine: int):
    """The postings of one owner, with their ids in all slices."""

    def pick(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                term, place, tf = (batch.column(c)[i].values.to_numpy() for c in (1, 2, 3))
                keep = owner[term] == mine
                yield pa.RecordBatch.from_pydict({"block": batch.column(0).slice(i, 1), **{n: pa.array([x[keep]]) for n, x in (("term", term), ("place", place), ("tf", tf))}})

    return pick


def _stage(mine: int, first_id: int, total: int, words: int, k: int):
    """Arrow cogroup function: one bundle's accumulators of one block through one owner."""

    def go(state: pa.Table, postings: pa.Table) -> pa.Table:
        if not state.num_rows:  # no items at all
            return pa.schema([("bundle", pa.int32()), ("block", pa.int64()), *[(c, pa.list_(_TYPES[t])) for c, t in _STATE.items()]]).empty_table()
        held = {c: state.column(c).combine_chunks()[0].values for c in _STATE}
        item, t_end, t_id, t_w, t_most, t_owner, n, a_end, a_doc, a_score, floor = (held[c].to_numpy() for c in _STATE if c not in ("item_id", "doc_id"))
        term, place, tf = (postings.column(c).combine_chunks()[0].values.to_numpy().astype(np.int64) for c in ("term", "place", "tf"))
        of_item = np.repeat(np.arange(len(item)), np.diff(t_end, prepend=0))
        acc = np.zeros((len(item), len(n)), np.int64)
        acc[np.repeat(np.arange(len(item)), np.diff(a_end, prepend=0)), a_doc] = a_score
        left = lambda which: np.bincount(of_item[which], t_most[which].astype(np.float64), len(item)).astype(np.int64)
        shut = (left(t_owner >= mine) < floor)[:, None] & (acc == 0)
        m = 50 + (50 * n * total) // max(words, 1)
        base = (1_000_000_000 * tf) // (1000 * tf + 20 * m[place])
        now = np.flatnonzero(t_owner == mine)
        now = now[np.argsort(t_id[now], kind="stable")]
        ids, first, count = np.unique(t_id[now], return_index=True, return_counts=True)
        low, high = np.searchsorted(term, ids - first_id), np.searchsorted(term, ids - first_id, side="right")
        for f, c, a, b in zip(first.tolist(), count.tolist(), low.tolist(), high.tolist()):
            if a < b:
                acc[np.ix_(of_item[now[f : f + c]], place[a:b])] += t_w[now[f]] * base[a:b]
        acc[shut] = 0
        if acc.shape[1] >= k:
            floor = np.maximum(floor, np.partition(acc, acc.shape[1] - k, axis=1)[:, acc.shape[1] - k])
        keep = (acc > 0) & (acc + left(t_owner > mine)[:, None] >= floor[:, None])
        at, doc = np.nonzero(keep)
        held |= {"a_end": pa.array(np.cumsum(keep.sum(1)).astype(np.int32)), "a_doc": pa.array(doc.astype(np.int16)), "a_score": pa.array(acc[at, doc]), "floor": pa.array(floor)}
        lists = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in held.items()}
        return pa.table({"bundle": state.column("bundle"), "block": state.column("block"), **lists})

    return go


def _best(batches):
    """(item, item_id, doc_id, score) of the accumulators that are left."""
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns))
        for i in range(batch.num_rows):
            item, item_id, doc_id, a_end, a_doc, a_score = (column[c][i].values for c in ("item", "item_id", "doc_id", "a_end", "a_doc", "a_score"))
            of_item = pa.array(np.repeat(np.arange(len(item)), np.diff(a_end.to_numpy(), prepend=0)))
            yield pa.RecordBatch.from_arrays([item.take(of_item), item_id.take(of_item), doc_id.take(a_doc), a_score], ["item", "item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "item_id") -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (``key``, text): item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores rank by ascending doc_id, NULL last. Rows of one item key are one item of
    all their terms, NULL keys too. NULL or empty texts hold no term: such an item gets no rows, such a document
    counts for nothing. Repeated documents are ranked each on their own. Other columns are not looked at.
    """
    c = F.col
    docs = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("binary").alias("text"))
    wanted = materialize(item_terms(items.select(c(key).cast("long").alias("item_id"), "text"), "item_id"), "item-terms")
    vocabulary = materialize(row_index(wanted.select("term").distinct(), ["term"], "id"), "terms")
    parts, counts = [], None
    for first_id in range(0, max(vocabulary.count(), 1), SENT_TERMS):
        mine = vocabulary.filter((c("id") >= first_id) & (c("id") < first_id + SENT_TERMS)).orderBy("id").toArrow()  # at most SENT_TERMS
        blocks = materialize(_postings(docs, [t.encode() for t in mine.column("term").to_pylist()]), "postings")
        df = blocks.select("term", "tf").mapInArrow(_document_counts, "id long, df long, tf long").groupBy("id").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"))
        df = df.withColumn("id", c("id") + first_id)
        parts.append((first_id, blocks))
        counts = df if counts is None else counts.union(df)
    total, words = parts[0][1].agg(F.coalesce(F.sum("some"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    # owners: terms by document count, cut where the postings so far pass equal shares; each slice has owners of its own
    w = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * c("df") + 1))).cast("long")
    stats = running_totals(counts.withColumn("slice", F.floor(c("id") / SENT_TERMS)), ["slice"], ["df", "id"], {"so_far": c("df")}, totals=True)
    owner = (c("slice") * OWNERS + F.least(F.floor((c("so_far") - c("df")) * OWNERS / c("so_far_total")), F.lit(OWNERS - 1))).cast("int")
    most = w * F.expr("(1000000000 * tf) div (1000 * tf + 1000)")  # m is at least 50
    stats = materialize(stats.select("id", owner.alias("owner"), w.alias("w"), most.alias("most")).filter("w > 0"), "term-stats")

    # bundles: items with their terms, weights and owners
    known = wanted.join(vocabulary, "term").join(stats, "id").select("item_id", F.struct("id", "w", "most", "owner").alias("t"))
    by_item = row_index(known.groupBy("item_id").agg(F.collect_list("t").alias("t")), ["item_id"], "item")  # the words of one item
    ended = F.size("t").cast("int").alias("n_terms")
    bundles = by_item.select((c("item") / BUNDLE).cast("int").alias("bundle"), F.struct("item", "item_id", ended, "t").alias("i"))
    bundles = bundles.groupBy("bundle").agg(F.sort_array(F.collect_list("i")).alias("i"))  # at most BUNDLE items
    terms = F.flatten(c("i.t"))
    ends = F.transform(F.sequence(F.lit(1), F.size("i")), lambda j: F.aggregate(F.slice(c("i.n_terms"), F.lit(1), j), F.lit(0), lambda a, x: a + x))
    bundles = materialize(bundles.select(
        "bundle", c("i.item").alias("item"), c("i.item_id").alias("item_id"), ends.alias("t_end"), terms["id"].cast("array<int>").alias("t_id"),
        terms["w"].alias("t_w"), terms["most"].alias("t_most"), terms["owner"].alias("t_owner"),
    ), "bundles")
    n_bundles = bundles.count()
    state = parts[0][1].select("block", "n", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")) if n_bundles else parts[0][1].select("block", "n", "doc_id", F.lit(0).alias("bundle")).filter("false")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    zeros = lambda kind: F.transform("item", lambda _: F.lit(0).cast(kind))
    state = state.join(bundles, "bundle").withColumns({"a_end": zeros("int"), "a_doc": none("short"), "a_score": none("long"), "floor": zeros("long")})
    state = state.select("bundle", "block", *_STATE)

    schema = "bundle int, block long, " + ", ".join(f"{n} array<{t}>" for n, t in _STATE.items())
    for first_id, blocks in parts:
        here = first_id // SENT_TERMS
        rows = stats.filter((c("id") >= first_id) & (c("id") < first_id + SENT_TERMS)).select("id", "owner").toArrow()  # at most SENT_TERMS
        of = np.full(SENT_TERMS, -1, np.int32)
        of[rows.column("id").to_numpy() - first_id] = rows.column("owner").to_numpy()
        for mine in range(here * OWNERS, (here + 1) * OWNERS):
            own = blocks.select("block", "term", "place", "tf").mapInArrow(_owned(of, mine), "block long, term array<int>, place array<short>, tf array<int>")
            own = own.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(max(n_bundles, 1) - 1))))
            both = state.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block"))
            state = both.applyInArrow(_stage(mine, first_id, total, words, k), schema)
    best = materialize(state.mapInArrow(_best, "item long, item_id long, doc_id long, score long"), "best")
    for _, blocks in parts:
        discard(blocks)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place).filter(c("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir) -> DataFrame:
    """op12: the 50 best documents of each benchmark item."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return search(read("documents"), read("benchmark"), 50)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
total AS (SELECT count(*) AS total, sum(n)::BIGINT AS words FROM size),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * total + 2) / (2 * df + 1)))::BIGINT AS w FROM df, total),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // words))))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""

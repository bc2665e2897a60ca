"""N-gram Jaccard join by grouped prefixes, down to the connected groups of near copies.

Sets are distinct word shingles as 64-bit hashes. Equal sets form a class; classes of one size with identical
prefixes form a group, and only groups enter the join:

1. order: shingles by hash, the frequent ones last. Frequent shingles come from counts over every text;
   any order gives exact results, this one keeps shared passages out of the prefixes;
2. prefix: two sets of similarity t share a shingle among the first ``n - ceil(2tn/(1+t)) + 1`` of the smaller
   and the first ``n - ceil(tn) + 1`` of the larger. Prefix rows are range-partitioned by (shingle, size), so a
   shingle of very many groups is cut over tasks; rows whose shingle no other group has drop out there, except one
   row of each group of several classes, which stands for the pairs inside it;
3. first pass: neighbours by size among the groups of a shingle, and members of a group with its first, are
   verified: a number of pairs linear in the rows. Their links give provisional components; a few more such passes
   take the members of a shingle in other orders;
4. second pass: all pairs that share a prefix shingle, pass the size and position bounds and still lie in
   different components. A list is cut into blocks and pairs of blocks are compared inside a task, which lets only pairs
   out that the sketches of their sets allow too, so a crowded list costs no join rows;
5. group pairs are expanded to their member classes; 256 counts per class rule out most pairs that cannot reach the
   similarity, the others are verified on the whole sets.

All pairs that could link two components are verified, so the components are those of the full join.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import word_hash
from tidewatch.llm.common import discard
from tidewatch.llm.components import components

#: Shingles counted together in a task before rare ones are let go; sets what "frequent" can see, not results.
COUNT_BLOCK = 1 << 22
#: Most frequent shingles that get a place of their own in the order: bounds what is broadcast (8 bytes each).
FREQUENT = 1 << 20
#: Linear passes over the lists in other orders, and how far apart they compare, before all remaining pairs are taken.
LINEAR_PASSES, REACH = 3, 12
#: Rows of a crowded list that meet as one block in the second pass; sets how the work is cut, not its result.
BLOCK_ROWS = 2048
#: Documents whose ids are broadcast to fetch their texts (32 bytes each); more are fetched by a shuffled join.
SENT_IDS = 1 << 20


def shingle_sets(texts: list[bytes], words: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, set size of each text): distinct word shingles, sorted by hash; fewer words are one shingle."""
    hashes, counts = word_hash.word_hashes(texts, lower)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    all_ = word_hash.windows(hashes, words)
    whole = np.flatnonzero(np.arange(len(all_)) + words <= ends[text[: len(all_)]])
    values = all_[whole]
    sizes = np.bincount(text[whole], minlength=len(counts))
    ends_, out, parts = np.cumsum(sizes), np.zeros(len(counts), np.int64), []
    for i, n in enumerate(sizes.tolist()):
        if n:
            mine = np.sort(values[ends_[i] - n : ends_[i]])
            mine = mine[np.append(True, mine[1:] != mine[:-1])]
        elif counts[i]:
            own = hashes[ends[i] - counts[i] : ends[i]]
            mine = word_hash.mix(word_hash.windows(own, len(own)) + np.uint64(len(own)))
        else:
            continue
        out[i] = len(mine)
        parts.append(mine)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), out


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The most frequent shingles over all texts, rarest first; at most FREQUENT."""

    def count(batches):
        held, total = [], 0

        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], ["s", "n"])

        for batch in batches:
            for _, texts in word_hash.chunks(batch.column(0)):
                held.append(shingle_sets(texts, words)[0])
                total += len(held[-1])
                if total >= COUNT_BLOCK:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()
    return top.column("s").to_numpy()[::-1].copy()


def bounds(t: int) -> tuple:
    """Exact integer bounds for a similarity of t percent: prefixes (long, short) and overlap of two sizes."""
    long = lambda n: n - -(-t * n // 100) + 1
    short = lambda n: n - -(-2 * t * n // (100 + t)) + 1
    overlap = lambda n, m: -(-t * (n + m) // (100 + t))
    return long, short, overlap


def _prefixes(docs: DataFrame, words: int, t: int, frequent: np.ndarray) -> DataFrame:
    """Each row's n, class (128-bit set hash as two longs), prefix and sketch: shingles in each of 256 hash ranges."""
    place = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))
    rank = docs.sparkSession.sparkContext.broadcast(np.argsort(frequent))
    long = bounds(t)[0]

    def emit(batches):
        known, ranks = place.value, rank.value
        for batch in batches:
            for at, texts in word_hash.chunks(batch.column(1)):
                values, sizes = shingle_sets(texts, words)
                # two independent sums over the set
                cells = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
                starts = np.cumsum(sizes) - sizes
                some = sizes > 0
                for cell, salt in zip(cells, (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                    if len(values):
                        cell[some] = np.add.reduceat(word_hash.mix(values ^ np.uint64(salt)), starts[some])
                late = np.zeros(len(values), np.int64)
                if len(known) and len(values):
                    spot = np.minimum(np.searchsorted(known, values.view(np.int64)), len(known) - 1)
                    hit = known[spot] == values.view(np.int64)
                    late[hit] = ranks[spot[hit]] + 1
                prefix, offsets, sketches = [], [0], []
                cell = (values >> np.uint64(56)).astype(np.int64)
                for n, first in zip(sizes.tolist(), starts.tolist()):
                    mine, mark, p = values[first : first + n], late[first : first + n], long(n) if n else 0
                    if mark.any():
                        usual = mine[mark == 0]
                        mine = np.concatenate([usual, mine[mark > 0][np.argsort(mark[mark > 0])]]) if p > len(usual) else usual
                    prefix.append(mine[:p])
                    offsets.append(offsets[-1] + p)
                    sketches.append(np.minimum(np.bincount(cell[first : first + n], minlength=256), 255).astype(np.uint8).tobytes())
                prefix = np.concatenate(prefix).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes.astype(np.int64)), pa.array(cells[0].view(np.int64)), pa.array(cells[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(prefix)), pa.array(sketches, pa.binary())],
                    ["doc_id", "n", "c1", "c2", "prefix", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(emit, "doc_id long, n long, c1 long, c2 long, prefix array<long>, sketch binary")


def _neighbours(rows: DataFrame, *order: str) -> DataFrame:
    """Prefix rows (s, g, n, p, held) sorted by shingle and ``order``: those held or whose shingle a neighbour shares, each with the row before it."""

    def scan(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, g, n, p = (batch.column(i).to_numpy() for i in range(4))
            held = batch.column(4).to_numpy(zero_copy_only=False)
            if last is not None:
                s, g, n, p, held = (np.concatenate([[x], y]) for x, y in zip(last, (s, g, n, p, held)))
            same = s[1:] == s[:-1]
            shared = np.zeros(len(s), bool)
            shared[1:] |= same
            shared[:-1] |= same
            # the ends of a batch may go on in the next batch or task
            shared[-1] = True
            if last is None:
                shared[0] = True
            before = np.full(len(s), -1, np.int64)
            before[1:][same] = g[:-1][same]
            n_before, p_before = np.roll(n, 1), np.roll(p, 1)
            keep = shared | held
            if last is not None:
                keep[0] = False  # given with its own batch
            last = [x[-1] for x in (s, g, n, p, held)]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (s, g, n, p, before, n_before, p_before)], ["s", "g", "n", "p", "g0", "n0", "p0"])

    ordered = rows.repartitionByRange("s", *order).sortWithinPartitions("s", *order).select("s", "g", "n", "p", "held")
    return ordered.mapInArrow(scan, "s long, g long, n long, p long, g0 long, n0 long, p0 long")


def _beside(rows: DataFrame, reach: int) -> DataFrame:
    """Pairs of rows (s, g, n, p, label) of one shingle and different labels, at most ``reach`` apart by (s, o)."""

    def scan(batches):
        for batch in batches:
            s, g, n, p, label = (batch.column(i).to_numpy() for i in range(5))
            out = []
            for d in range(1, reach + 1):
                at = np.flatnonzero((s[d:] == s[:-d]) & (label[d:] != label[:-d]))
                out.append([x[i] for i in (at + d, at) for x in (g, n, p)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["g", "n", "p", "g0", "n0", "p0"])

    ordered = rows.repartitionByRange("s", "o").sortWithinPartitions("s", "o").select("s", "g", "n", "p", "label")
    return ordered.mapInArrow(scan, "g long, n long, p long, g0 long, n0 long, p0 long")


def _across(rows: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of classes of different components in one pair of blocks of a list that bounds and sketches allow.

    Rows of a pair of blocks follow one another; each is compared with the one d places on, for d = 1, 2, ... while
    any two are still in the same blocks, so only pairs that may link leave the task.
    """
    names = ["s", "u", "v", "side", "k", "n", "p", "label", "sketch"]

    def possible(n, p, n2, p2):
        need = -(-t * (n + n2) // (100 + t))
        most = 1 + np.minimum(n - p - 1, n2 - p2 - 1)
        small = np.minimum(n, n2)
        small_p = np.where(n < n2, p, np.where(n2 < n, p2, np.maximum(p, p2)))
        short = small - -(-2 * t * small // (100 + t)) + 1
        return (100 * small >= t * np.maximum(n, n2)) & (most >= need) & (small_p < short)

    def pairs(table):
        s, u, v, side, k, n, p, label = (table.column(i).to_numpy() for i in range(8))
        marks = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, 256)
        group = np.concatenate([[0], np.cumsum((s[1:] != s[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1]))])
        out, i, d = [], np.arange(len(k)), 1
        while len(i):
            i = i[i + d < len(k)]
            i = i[group[i] == group[i + d]]
            j = i + d
            d += 1
            ok = (label[i] != label[j]) & ((u[i] == v[i]) | (side[i] != side[j])) & possible(n[i], p[i], n[j], p[j])
            x, y = i[ok], j[ok]
            if len(x):
                least = np.minimum(marks[x], marks[y])
                most, both = least.sum(1, dtype=np.int64), n[x] + n[y]
                keep = (100 * most >= t * (both - most)) | (least == 255).any(1)  # a full cell may hold more than it says
                out.append(np.stack([np.minimum(k[x], k[y])[keep], np.maximum(k[x], k[y])[keep]], 1))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def scan(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not len(table):
                continue
            # the last pair of blocks may go on in the next batch
            ends = [table.column(i).to_numpy() for i in range(3)]
            last = np.flatnonzero(np.any([x != x[-1] for x in ends], axis=0))
            first = int(last[-1]) + 1 if len(last) else 0
            held = table.slice(first)
            if first:
                yield pairs(table.slice(0, first))
        if held is not None and len(held):
            yield pairs(held)

    ordered = rows.select(*names).repartition("s", "u", "v").sortWithinPartitions("s", "u", "v")
    return ordered.mapInArrow(scan, "a long, b long")


def _possible(t: int, n, p, n2, p2):
    """Size and position bounds of two rows of one shingle, and the role of the smaller set's short prefix."""
    need = F.ceil((F.lit(t) * (n + n2)) / F.lit(100.0 + t) - F.lit(1e-9))
    most = F.lit(1) + F.least(n - p - 1, n2 - p2 - 1)
    small, small_p = F.least(n, n2), F.when(n < n2, p).when(n2 < n, p2).otherwise(F.greatest(p, p2))
    short = small - F.ceil(F.lit(2 * t) * small / F.lit(100.0 + t) - F.lit(1e-9)) + 1
    # of two sets of one size either may take the short prefix, so both do
    return (F.least(n, n2) * 100 >= F.greatest(n, n2) * t) & (most >= need) & (small_p < short)


def _plausible(pairs: DataFrame, sketches: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of classes whose sketches allow the similarity: no two sets share more than the smaller counts."""
    left = sketches.select(F.col("k").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("k").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("y"))

    def test(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (3, 5))
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            # a full cell may hold more than it says
            keep = (100 * most >= t * (n - most)) | ((x == 255) & (y == 255)).any(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "x", "n2", "y")
    return joined.mapInArrow(test, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets reach the similarity."""
    left = sets.select(F.col("k").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("k").alias("b"), F.col("set").alias("y"))

    def test(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(v[i].as_buffer(), np.uint64) for v in (xs, ys))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= t * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(test, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(k, set) of wanted classes, from the text of one row of each."""
    one = members.join(wanted, "k").groupBy("k").agg(F.min_by(F.struct("doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("d"), F.first("c1").alias("c1"))
    one = one.select(F.coalesce("d.doc_id", F.lit(-1)).alias("key"), F.col("d.doc_id").isNull().alias("no_id"), "k", "c1")
    source = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), F.col("doc_id").isNull().alias("no_id"), "text")
    one = materialize(one, "wanted")
    few = one.count() <= SENT_IDS
    source = source.join(F.broadcast(one) if few else one, ["key", "no_id"]).select("k", "text", "c1")

    def emit(batches):
        for batch in batches:
            for at, texts in word_hash.chunks(batch.column(1)):
                values, sizes = shingle_sets(texts, words)
                ends = np.cumsum(sizes)
                ks, sets = [], []
                for i, (k, c1) in enumerate(zip(batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(2).slice(at, len(texts)).to_pylist())):
                    mine = values[ends[i] - sizes[i] : ends[i]]
                    own = int(word_hash.mix(mine ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) if len(mine) else 0
                    if own == c1:  # a row of the same id may hold another text
                        ks.append(k)
                        sets.append(mine.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(sets, pa.binary())], ["k", "set"])

    return source.mapInArrow(emit, "k long, set binary")


def near_copies(docs: DataFrame, words: int = 5, t: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, class key and component_id.

    Rows link when 100 * intersection >= t * union of their shingle sets. component_id is the smallest doc_id
    reachable, itself included; an empty set links with nothing. NULL ids are never the smallest; a component
    of such rows alone has a NULL component_id. ``c1, c2`` name the class of equal sets, ``label`` the
    component (NULL for empty sets). Rows repeat as in the input.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = materialize(_prefixes(docs, words, t, _frequent(docs, words)), "sets")
    filled = rows.filter("n > 0").withColumn("k", F.xxhash64("c1", "c2", "n")).withColumn("g", F.xxhash64("n", "prefix"))
    members = filled.select("doc_id", "n", "c1", "c2", "k")
    held = materialize(filled.select("k", "n", "g").distinct(), "classes")
    groups = filled.groupBy("g", "n").agg((F.min("k") < F.max("k")).alias("several"), F.first("prefix").alias("prefix"))
    shingles = groups.select("g", "n", "several", F.posexplode("prefix").alias("p", "s")).withColumn("p", F.col("p").cast("long"))
    # the members of a group share their whole prefix, so its first shingle is enough to pair them
    shingles = shingles.withColumn("held", F.col("several") & (F.col("p") == 0)).drop("several")
    index = materialize(_neighbours(shingles, "n", "g"), "index")

    # first pass: neighbours in a shingle's list, and each group's members with its first
    c = F.col
    heads = held.groupBy("g").agg(F.min("k").alias("head"))
    next_to = index.filter(c("g0") != -1).filter(_possible(t, c("n"), c("p"), c("n0"), c("p0"))).select("g", "g0").distinct()
    pairs = next_to.join(heads, "g").join(heads.select(c("g").alias("g0"), c("head").alias("head0")), "g0").select(c("head").alias("a"), c("head0").alias("b"))
    inner = held.join(heads, "g").filter("k <> head").select(c("head").alias("a"), c("k").alias("b"))
    first = materialize(pairs.unionByName(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sketches = filled.groupBy("k", "n").agg(F.first("sketch").alias("sketch"))
    ends = lambda pairs: pairs.select(c("a").alias("k")).unionByName(pairs.select(c("b").alias("k"))).distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        likely = materialize(_plausible(pairs, sketches.join(ends(pairs), "k", "left_semi"), t), "likely")
        sets = materialize(_sets(docs, members, ends(likely), words), "class-sets")
        links = materialize(_verified(likely, sets, t), "links")
        discard(sets)
        return links

    links = verify(first)
    found = components(links)

    base = materialize(index.select("s", "g", "n", "p").join(held.select("g", "k"), "g").select("s", c("k").alias("g"), "n", "p"), "lists")
    discard(index)

    def open_lists() -> DataFrame:
        """Rows of shingles whose classes still lie in different components."""
        named = base.join(found, c("g") == c("node"), "left").select("s", "g", "n", "p", F.coalesce("label", "g").alias("label"))
        several = named.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("s")
        return materialize(named.join(several, "s"), "open-lists")

    # more linear passes, each with the members of a list in another order
    tested = first
    for step in range(LINEAR_PASSES):
        lists = open_lists()
        # sizes stay close, so that most neighbours pass the bounds; the rest of the order changes from pass to pass
        jitter = F.pmod(F.xxhash64("g", F.lit(step)), F.lit(1000)) / F.lit(1000.0)
        beside = _beside(lists.withColumn("o", c("n") * (1 + jitter * F.lit((100 - t) / 500.0))), REACH)
        beside = beside.filter(_possible(t, c("n"), c("p"), c("n0"), c("p0")))
        beside = beside.select(F.least("g", "g0").alias("a"), F.greatest("g", "g0").alias("b")).distinct()
        beside = materialize(beside.join(tested, ["a", "b"], "left_anti"), "pairs")
        discard(lists)
        tested = tested.unionByName(beside)
        more = verify(beside)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = components(links)

    # second pass: whatever still lies in different components, list by list in blocks
    lists = open_lists().withColumnRenamed("g", "k")
    blocks = lists.groupBy("s").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    cut = lists.join(blocks, "s").withColumn("side", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    cut = cut.select("s", F.least("side", "other").alias("u"), F.greatest("side", "other").alias("v"), "side", "k", "n", "p", "label")
    marked = cut.join(sketches.join(lists.select("k").distinct(), "k", "left_semi").select("k", "sketch"), "k")
    rest = materialize(_across(marked, t).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    discard(lists)
    links = links.unionByName(verify(rest))
    found = components(links)

    lone = members.join(found, c("k") == c("node"), "left").withColumn("label", F.coalesce("label", "k"))
    smallest = lone.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = lone.select("doc_id", "n", "c1", "c2", "label").join(smallest, "label")
    empty = rows.filter("n = 0").select("doc_id", "n", "c1", "c2", F.lit(None).cast("long").alias("label"), c("doc_id").alias("component_id"))
    return linked.unionByName(empty).select("doc_id", c("n").alias("n_shingles"), "component_id", "c1", "c2", "label")


def query(spark, sf_dir) -> DataFrame:
    """op1: near copies of all documents, 4-word shingles, similarity 85 %."""
    out = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, t=85)
    return out.select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY 1, 2
"""

"""Near copies by fast similarity sketches, banding and exact verification.

A sketch has ``COORDINATES`` bins. Round i throws every shingle of a set into one bin by a hash of its own; a bin
keeps the smallest value of the first round that reached it. From round ``COORDINATES`` on, round i throws all
shingles into bin i - COORDINATES, so after twice as many rounds every bin of a non-empty set is full, however few
shingles it has, and a set of many shingles needs one or two rounds. Two sets agree in a bin with probability equal
to their Jaccard similarity, with concentration bounds like those of independent draws.

1. equal sets form a class; each class has a sketch and ``BANDS`` buckets, one for every ``ROWS`` bins;
2. each bucket's members are paired with its smallest class, then, where several components are left, with its
   largest: a number of pairs linear in the rows. Pairs pass the size bound and the sketch, then the whole sets decide;
3. buckets that still hold several components are cut into blocks of bounded bytes; each pair of blocks is one Arrow
   group, which tests all its pairs of different components on the whole sets and emits only links that join two
   components. A pair of several common buckets is tested in the first.

A pair of similarity 0.85 misses all bands with probability below 1e-8, and the sketch test with a probability below
1e-7; pairs above it with less. Everything else is exact up to equal 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import word_hash
from tidewatch.llm.common import discard
from tidewatch.llm.components import components
from tidewatch.llm.jaccard_join import shingle_sets

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Standard deviations below the threshold at which a sketch rules a pair out.
SLACK = 6
#: Bytes of sets and members that meet as one block; sets how the work is cut, not its result.
BLOCK_BYTES, BLOCK_ROWS = 1 << 24, 2048
#: Rows whose keys are broadcast to fetch their texts (32 bytes each); more are fetched by a shuffled join.
SENT_KEYS = 1 << 20

_VALUE = np.uint64((1 << 40) - 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(values: np.ndarray, sizes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """(sets x coordinates) sketches of non-empty sets, given one after another as 64-bit hashes."""
    t = coordinates
    salts = word_hash.multipliers(2 * t, 5)
    out = np.full((len(sizes), t), _EMPTY, np.uint64)
    live = np.arange(len(sizes))
    for i in range(2 * t):
        if not len(live):
            break
        at = np.repeat(np.arange(len(live)), sizes[live])
        h = word_hash.mix(values ^ salts[i])
        bins = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24) if i < t else np.full(len(h), i - t, np.uint64)
        best = np.full(len(live) * t, _EMPTY, np.uint64)
        np.minimum.at(best, at * t + bins.astype(np.int64), (h & _VALUE) | np.uint64(i << 40))
        mine = np.minimum(out[live], best.reshape(len(live), t))  # the round is in the high bits, so earlier rounds stay
        out[live] = mine
        more = (mine == _EMPTY).any(1)
        if not more.all():
            values = values[more[at]]
            live = live[more]
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets x bands) bucket keys."""
    weights = word_hash.multipliers(bands * rows, 6)
    sums = (word_hash.mix(sketches) * weights).reshape(len(sketches), bands, rows).sum(2, dtype=np.uint64)
    return word_hash.mix(sums + np.arange(bands, dtype=np.uint64))


def short(sketches: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate, enough to compare sketches."""
    return (word_hash.mix(sketches) >> np.uint64(48)).astype(np.uint16)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """Per row of (doc_id, text, key): n, set hash (c1, c2), bucket keys, 16-bit sketch."""

    def emit(batches):
        for batch in batches:
            for at, texts in word_hash.chunks(batch.column(1)):
                values, sizes = shingle_sets(texts, words)
                some = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[some]
                sums = np.zeros((2, len(sizes)), np.uint64)
                bands, marks = np.zeros((len(sizes), BANDS), np.int64), np.zeros((len(sizes), COORDINATES), np.uint16)
                if len(some):
                    for j, salt in enumerate(word_hash.multipliers(2, 7)):
                        sums[j, some] = np.add.reduceat(word_hash.mix(values ^ salt), starts)
                    made = sketch(values, sizes[some])
                    bands[some], marks[some] = band_keys(made).view(np.int64), short(made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(sizes.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())), pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["doc_id", "key", "n", "c1", "c2", "bands", "sketch"],
                )

    return docs.mapInArrow(emit, "doc_id long, key long, n long, c1 long, c2 long, bands array<long>, sketch binary")


def _set_hash(values: np.ndarray) -> int:
    return int(word_hash.mix(values ^ word_hash.multipliers(2, 7)[0]).sum(dtype=np.uint64).view(np.int64))


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(k, set) of the wanted classes, from the text of one row of each."""
    one = materialize(classes.join(wanted, "k", "left_semi").select("k", "c1", "key"), "sketch-wanted")
    few = one.count() <= SENT_KEYS
    source = docs.select("key", "text").join(F.broadcast(one) if few else one, "key").select("k", "text", "c1")

    def emit(batches):
        for batch in batches:
            for at, texts in word_hash.chunks(batch.column(1)):
                values, sizes = shingle_sets(texts, words)
                ends = np.cumsum(sizes)
                ks, sets = [], []
                for i, (k, c1) in enumerate(zip(batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(2).slice(at, len(texts)).to_pylist())):
                    mine = values[ends[i] - sizes[i] : ends[i]]
                    if len(mine) and _set_hash(mine) == c1:
                        ks.append(k)
                        sets.append(mine.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(sets, pa.binary())], ["k", "set"])

    # rows that repeat an id and its text have one key and give the set more than once
    return source.mapInArrow(emit, "k long, set binary").groupBy("k").agg(F.first("set").alias("set"))


def _like(t: int) -> int:
    """Bins in which sketches of similarity t percent agree, less the slack."""
    j = t / 100
    return int(COORDINATES * j - SLACK * (COORDINATES * j * (1 - j)) ** 0.5)


def _likely(pairs: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of classes that sizes and sketches allow."""
    left = classes.select(F.col("k").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("x"))
    right = classes.select(F.col("k").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("y"))
    least = _like(t)

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, COORDINATES) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    near = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * t
    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, t: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= t * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets reach the similarity."""
    left, right = sets.select(F.col("k").alias("a"), F.col("set").alias("x")), sets.select(F.col("k").alias("b"), F.col("set").alias("y"))

    def test(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                keep[i] = _linked(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3)), t)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _joining(t: int):
    """Arrow group function: links that join components among the rows of one pair of blocks of a bucket."""
    least = _like(t)

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("label", "ascending"), ("k", "ascending")])
        k, band, side = (table.column(c).to_numpy() for c in ("k", "band", "side"))
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("set").chunk(0)]
        n = np.array([len(s) for s in sets])
        _, root = np.unique(table.column("label").to_numpy(), return_inverse=True)
        across = side.min() != side.max()
        found = []
        for i in range(1, len(k)):
            ok = (root[:i] != root[i]) & (100 * np.minimum(n[:i], n[i]) >= t * np.maximum(n[:i], n[i]))
            if across:
                ok &= side[:i] != side[i]
            at = np.flatnonzero(ok)
            same = marks[at] == marks[i]
            close = same.sum(1) >= least
            at, same = at[close], same[close]
            # only in the first bucket that both share
            first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1)
            at = at[first == band[0]]
            if not len(at):
                continue
            ends = np.cumsum(n[at])
            hit = np.isin(np.concatenate([sets[j] for j in at]), sets[i], assume_unique=False)
            common = np.add.reduceat(hit.astype(np.int64), ends - n[at])
            for j in at[100 * common >= t * (n[at] + n[i] - common)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    found.append((k[j], k[i]))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return find


def near_copies(docs: DataFrame, words: int = 5, t: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows link when 100 * intersection >= t * union of their sets of distinct word shingles (fewer words: the whole
    sequence as one). component_id is the smallest doc_id reachable, itself included; a set without words, of NULL or
    empty text, links with nothing. NULL ids are never the smallest; a component of such rows alone has a NULL
    component_id. ``kept`` says that doc_id is component_id (NULL equals NULL). Rows repeat as in the input; other columns are not looked at.
    """
    c = F.col
    docs = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("binary").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    rows = materialize(_sketched(docs, words), "sketches")
    filled = rows.filter("n > 0").withColumn("k", F.xxhash64("c1", "c2", "n"))
    classes = filled.groupBy("k").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.min("c1").alias("c1"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "sketch-classes")
    members = classes.select("k", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo < hi").select("bucket", "lo", "hi")
    buckets = materialize(members.join(shared, "bucket"), "sketch-buckets")

    def verify(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs asked for, those that link)."""
        pairs = materialize(pairs.filter("a < b").distinct(), "sketch-pairs")
        likely = materialize(_likely(pairs, classes, t), "sketch-likely")
        ends = likely.select(c("a").alias("k")).union(likely.select(c("b").alias("k"))).distinct()
        sets = materialize(_sets(docs, classes, ends, words), "sketch-sets")
        links = materialize(_verified(likely, sets, t), "sketch-links")
        discard(sets)
        discard(likely)
        return pairs, links

    def still_open(found: DataFrame) -> DataFrame:
        """Members of buckets that hold several components."""
        named = buckets.join(found, c("k") == c("node"), "left").select(*buckets.columns, F.coalesce("label", "k").alias("label"))
        several = named.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
        return materialize(named.join(several.select("bucket"), "bucket"), "sketch-open")

    tested, links = verify(buckets.select(c("lo").alias("a"), c("k").alias("b")))
    rest = still_open(components(links))
    again = rest.select(c("k").alias("a"), c("hi").alias("b")).join(tested, ["a", "b"], "left_anti")
    links = links.union(verify(again)[1])
    discard(tested)
    discard(rest)

    rest = still_open(components(links))
    discard(buckets)
    sets = materialize(_sets(docs, classes, rest.select("k").distinct(), words), "sketch-sets")
    info = classes.select("k", "n", "sketch").join(sets, "k")
    weights = rest.join(classes.select("k", "n"), "k").groupBy("bucket").agg(F.sum(c("n") * 8).alias("bytes"), F.count("*").alias("rows"))
    blocks = weights.select("bucket", F.greatest(F.ceil(c("bytes") / BLOCK_BYTES), F.ceil(c("rows") / BLOCK_ROWS)).cast("int").alias("blocks"))
    cut = rest.select("bucket", "band", "k", "label").join(blocks, "bucket").withColumn("side", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), c("blocks") - 1)))
    met = met.select("bucket", F.least("side", "other").alias("u"), F.greatest("side", "other").alias("v"), "band", "side", "label", "k")
    joined = met.join(info, "k").select("bucket", "u", "v", "band", "side", "label", "k", "sketch", "set")
    links = links.union(materialize(joined.groupBy("bucket", "u", "v").applyInArrow(_joining(t), "a long, b long").distinct(), "sketch-links"))
    found = components(links)
    discard(sets)
    discard(rest)

    lone = filled.select("doc_id", "n", "k").join(found, c("k") == c("node"), "left").withColumn("label", F.coalesce("label", "k"))
    smallest = lone.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = lone.select("doc_id", "n", "label").join(smallest, "label").select("doc_id", "n", "component_id")
    empty = rows.filter("n = 0").select("doc_id", "n", c("doc_id").alias("component_id"))
    return linked.union(empty).select("doc_id", c("n").alias("n_shingles"), "component_id", c("doc_id").eqNullSafe(c("component_id")).alias("kept"))


def query(spark, sf_dir) -> DataFrame:
    """op11: near copies of all documents, 3-word shingles, similarity 85 %."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, t=85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY 1, 2
"""

"""Remove passages that already stand in an earlier document: windows found by level-wise doubling.

A window of ``window`` words can only repeat if its parts repeat. Levels run over lengths that about double,
``window`` last (7, 13, 25, 50). At length k a window is represented by its smallest k-word hash, so equal windows
share it; only windows whose representative occurs in two documents go on to the next length, and a document
shrinks to the stretches such windows cover. The last level compares the windows themselves. Candidates are
rows (hash, document): each level is one aggregate, combined map-side, and one join that AQE can split for
passages that very many documents share. Words travel as 64-bit hashes; no document pairs are formed.

The document id says which document is earlier; the row key (a hash of id and text) says to which row a place belongs,
so rows without id, or of one repeated id, keep their places apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import word_hash
from tidewatch.llm.common import discard

#: Stands for a NULL id: the last of all documents.
NO_ID = (1 << 63) - 1
#: Repeated representatives that are sent to every task (8 bytes each); more go by a join on the document.
SENT_MARKS = 1 << 23


def levels(window: int, shortest: int = 12) -> list[int]:
    """Lengths ending at the window, each at most twice the one before."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _smallest(values: np.ndarray, m: int) -> np.ndarray:
    """Minimum of m values from each place on."""
    have = 1
    while 2 * have <= m:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    rest = m - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _representatives(hashes: np.ndarray, counts: np.ndarray, k: int, window: int):
    """(place, text index, smallest k-word hash) of every window that lies inside one text."""
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    low = _smallest(word_hash.windows(hashes, k), window - k + 1)
    text = np.repeat(np.arange(len(counts)), counts)[: len(low)]
    ends = np.cumsum(counts)
    inside = np.arange(len(low)) + window <= ends[text]
    place = np.flatnonzero(inside)
    return place, text[place], low[place].view(np.int64)


def _texts(batch, lower=False):
    """(start, documents, row keys, word hashes, words per row, first word of each row in its text) of slices of a batch."""
    docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    if batch.schema.names[2] == "words":
        first = batch.column(3).to_numpy()
        held, total, at = [], 0, 0
        for i, value in enumerate(batch.column(2)):
            held.append(np.frombuffer(value.as_buffer(), np.uint64))
            total += len(held[-1])
            if total >= 1 << 18 or i + 1 == batch.num_rows:
                counts = np.array([len(h) for h in held], np.int64)
                yield at, docs[at : i + 1], keys[at : i + 1], np.concatenate(held), counts, first[at : i + 1]
                held, total, at = [], 0, i + 1
        return
    for at, texts in word_hash.chunks(batch.column(2)):
        hashes, counts = word_hash.word_hashes(texts, lower)
        yield at, docs[at : at + len(texts)], keys[at : at + len(texts)], hashes, counts, np.zeros(len(texts), np.int64)


def _marks(source: DataFrame, k: int, window: int) -> DataFrame:
    """(doc, rk, mark) of every window's representative, once per document slice; (doc, rk, mark, place) at the last level."""
    last = k == window

    def emit(batches):
        for batch in batches:
            for _, docs, keys, hashes, counts, first in _texts(batch):
                place, text, low = _representatives(hashes, counts, k, window)
                if not last:  # neighbours share their representative
                    new = np.ones(len(low), bool)
                    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                    place, text, low = place[new], text[new], low[new]
                columns = [pa.array(docs[text]), pa.array(keys[text]), pa.array(low)]
                if last:
                    starts = np.cumsum(counts) - counts
                    columns.append(pa.array((place - starts[text] + first[text]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "rk", "mark", "place"][: len(columns)])

    return source.mapInArrow(emit, "doc long, rk long, mark long" + ", place int" * last)


def _shrink(source: DataFrame, k: int, window: int, sent=None) -> DataFrame:
    """Stretches of documents covered by windows whose representative repeats: doc, rk, words, first.

    Repeated representatives are ``sent`` (a broadcast sorted array) or stand in each row's last column, marks.
    """

    def emit(batches):
        for batch in batches:
            marks = batch.column(batch.num_columns - 1) if sent is None else None
            for at, docs, keys, hashes, counts, first in _texts(batch):
                starts, out = np.cumsum(counts) - counts, ([], [], [], [])
                place, text, low = _representatives(hashes, counts, k, window)
                if sent is not None and len(low):
                    known = sent.value
                    hit = known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
                    place, text, low = place[hit], text[hit], low[hit]
                bounds = np.searchsorted(text, np.arange(len(docs) + 1))
                for i in range(len(docs)):
                    a, b = bounds[i], bounds[i + 1]
                    if a == b:
                        continue
                    alive = place[a:b]
                    if sent is None:
                        alive = alive[np.isin(low[a:b], marks[at + i].values.to_numpy())]
                        if not len(alive):
                            continue
                    cut = np.flatnonzero(np.diff(alive) > window) + 1
                    for run in np.split(alive, cut):
                        out[0].append(docs[i])
                        out[1].append(keys[i])
                        out[2].append(hashes[run[0] : run[-1] + window].tobytes())
                        out[3].append(int(run[0] - starts[i] + first[i]))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["doc", "rk", "words", "first"])

    return source.mapInArrow(emit, "doc long, rk long, words binary, first long")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc, rk, places): places of windows whose words also start in a document of smaller id. ``docs``: doc, rk, text."""
    source, old = docs, None
    for k in levels(window)[:-1]:
        marks = materialize(_marks(source, k, window), "substring-marks")
        twice = marks.groupBy("mark").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("mark")
        twice = materialize(twice, "substring-repeats")
        if 0 < twice.count() <= SENT_MARKS:
            known = np.sort(twice.toArrow().column("mark").to_numpy())
            shrunk = _shrink(source, k, window, docs.sparkSession.sparkContext.broadcast(known))
        else:
            kept = marks.join(twice, "mark").groupBy(F.col("doc").alias("d"), F.col("rk").alias("r")).agg(F.collect_set("mark").alias("marks"))
            shrunk = _shrink(source.join(kept, (F.col("doc") == F.col("d")) & (F.col("rk") == F.col("r"))).select(*source.columns, "marks"), k, window)
        source = materialize(shrunk, "substring-stretches")
        for table in (marks, twice, old):
            if table is not None:
                discard(table)
        old = source
    every = _marks(source, window, window)
    first = every.groupBy("mark").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("mark", "a")
    later = every.join(first, "mark").filter("a < doc")
    return later.groupBy("doc", "rk").agg(F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space) of every row of ``docs`` (doc_id, text).

    Windows are judged on the input. NULL and empty texts have no words; rows of one id never remove each other's
    words; rows without id count as one last document. An empty table gives an empty result.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("binary").alias("text"))
    docs = docs.select("doc", F.xxhash64("doc", "text").alias("rk"), "text")
    found = repeated_windows(docs, window).withColumnsRenamed({"doc": "d", "rk": "r"})

    def cut(batches):
        for batch in batches:
            docs_, places = batch.column(0), batch.column(2)
            for at, texts in word_hash.chunks(batch.column(1)):
                n_words, n_removed, kept = [], [], []
                for i, text in enumerate(texts):
                    words = text.split()
                    n_words.append(len(words))
                    mine = places[at + i]
                    if mine.is_valid:
                        spot = mine.values.to_numpy()
                        edge = np.zeros(len(words) + window + 1, np.int64)
                        np.add.at(edge, spot, 1)
                        np.add.at(edge, spot + window, -1)
                        gone = np.cumsum(edge)[: len(words)] > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                ids = docs_.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept"])

    joined = docs.join(found, (F.col("doc") == F.col("d")) & (F.col("rk") == F.col("r")), "left").select("doc", "text", "places")
    out = joined.mapInArrow(cut, "doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def query(spark, sf_dir) -> DataFrame:
    """op9: every document without the 50-word passages of earlier documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM d, unnest(generate_series(1, len(words) - 49)) AS s(i)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, p FROM w JOIN f USING (h), unnest(generate_series(i, i + 49)) AS s(p) WHERE first < doc_id),
each AS (SELECT doc_id, p, words[p] AS word FROM d, unnest(generate_series(1, len(words))) AS s(p)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

"""Score texts with a class-based bigram model whose classes come from exchange clustering.

P(word | history) = P(class | class before) * P(word | class), mixed with the plain word frequency.

1. Texts are coded once, in chunks of a few MB: the distinct words of a chunk as 64-bit hashes (most frequent first)
   and tokens as places in that list. All later passes read the codes.
2. Word counts: one row per chunk and word, summed by word over all training texts.
3. Exchange: the ``head`` most frequent words start in round-robin classes. A pass over the codes counts, for each of
   them, the classes before and after it; half of the words at a time move to the class under which those are
   likeliest. The counts have head * 2 * classes cells, whatever the corpus.
4. All other words join the class that their neighbours vote for, chunk by chunk, the votes summed by word. The same pass
   counts the class transitions of all training tokens.
5. Every chunk gets the counts and classes of its own words by a join on the word (never a whole vocabulary in one task),
   and its texts are scored.

A word unknown to training has the share that words seen once have in each class; the history after it stays the
class before it. The probabilities of all known words, the unknown word and the end sum to 1 after any history.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import word_hash
from tidewatch.llm.common import held_back

#: Text of a chunk.
CHUNK_CHARS = 8 << 20
#: Words that take part in the exchange, classes and passes.
HEAD, CLASSES, PASSES = 4096, 32, 8
#: Share of the class model against plain frequency; weight of class frequency in transitions.
CLASS_SHARE, KAPPA = 0.95, 10.0
#: Words whose counts travel in one row.
BLOCK = 256

_CODED = "doc_ids array<long>, held array<boolean>, sizes array<long>, vocab array<long>, train array<long>, codes binary"


def _pack(codes: np.ndarray) -> bytes:
    """Three byte planes: the upper ones are nearly empty and compress well."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def code_texts(docs: DataFrame) -> DataFrame:
    """Chunks of coded texts (see above). ``docs``: doc_id, text, held. Code 0 is the end of a text, i + 1 word i."""

    def emit(batches):
        def chunk(ids, held, texts):
            hashes, counts = word_hash.word_hashes(texts, True)
            vocab, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            codes = rank[place] + 1
            training = np.repeat(~np.array(held, bool), counts)
            train = np.bincount(codes[training] - 1, minlength=len(vocab)) if len(codes) else np.zeros(0, np.int64)
            full = np.insert(codes, np.cumsum(counts), 0)
            row = [[ids], [held], [(counts + 1).tolist()], [vocab[order].view(np.int64)], [train], [_pack(full)]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["doc_ids", "held", "sizes", "vocab", "train", "codes"])

        ids, held, texts, total = [], [], [], 0
        for batch in batches:
            for doc_id, h, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                ids.append(doc_id), held.append(h), texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                total += len(texts[-1]) + 8
                if total >= CHUNK_CHARS:
                    yield chunk(ids, held, texts)
                    ids, held, texts, total = [], [], [], 0
        if ids:
            yield chunk(ids, held, texts)

    # a chunk's number holds only for rows that are written once and read back
    coded = docs.select("doc_id", "text", "held").mapInArrow(emit, _CODED)
    return coded.select(F.monotonically_increasing_id().alias("chunk"), "*")


def _rows(batch: pa.RecordBatch):
    """Rows of a batch with their lists as arrays and the codes as bytes."""
    for i in range(batch.num_rows):
        values = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
        yield {n: v.as_buffer() if n == "codes" else v.values.to_numpy(zero_copy_only=False) for n, v in values.items()}


def _training(row: dict):
    """(codes of training texts laid end to end, each led by an end code)."""
    codes, sizes, held = _unpack(row["codes"]), row["sizes"], row["held"].astype(bool)
    keep = np.repeat(~held, sizes)
    return np.concatenate([[0], codes[keep]])


def _head_classes(row: dict, head: np.ndarray, place: np.ndarray, classes: np.ndarray):
    """(class, head word) of every code of a chunk; -1 for words outside the head. Code 0 has the last class."""
    vocab = row["vocab"]
    if not len(head) or not len(vocab):
        word = np.full(len(vocab), -1)
    else:
        spot = np.minimum(np.searchsorted(head, vocab), len(head) - 1)
        word = np.where(head[spot] == vocab, place[spot], -1)
    cls = np.where(word >= 0, classes[word], -1) if len(classes) else np.full(len(vocab), -1)
    return np.concatenate([[CLASSES], cls]), np.concatenate([[-1], word])


def _contexts(coded: DataFrame, head: np.ndarray, place: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """head x 2 x (classes + 1) counts: classes before and after each head word in the training texts."""
    wide, n_head = CLASSES + 1, len(head)

    def count(batches):
        total = np.zeros((n_head, 2, wide), np.int64)
        for batch in batches:
            for row in _rows(batch):
                codes = _training(row)
                cls, word = (x[codes] for x in _head_classes(row, head, place, classes))
                for side, (w, c) in enumerate(((word[1:], cls[:-1]), (word[:-1], cls[1:]))):
                    both = (w >= 0) & (c >= 0)
                    total[:, side] += np.bincount(w[both] * wide + c[both], minlength=n_head * wide).reshape(n_head, wide)
        for b in range(0, n_head, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK]), pa.array([total[b : b + BLOCK].tobytes()])], ["block", "cells"])

    def add(table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("cells"))
        return pa.table({"block": table.column("block")[:1], "cells": pa.array([cells.tobytes()], pa.binary())})

    parts = coded.select("held", "sizes", "vocab", "codes").mapInArrow(count, "block long, cells binary")
    done = parts.groupBy("block").applyInArrow(add, "block long, cells binary").toArrow().sort_by("block")
    return np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in done.column("cells")]).reshape(n_head, 2, wide)


def _log_transitions(counts: np.ndarray) -> np.ndarray:
    """log P(class | class before), smoothed by class frequency."""
    share = (counts.sum(0) + 0.1) / (counts.sum() + 0.1 * len(counts))
    return np.log((counts + KAPPA * share) / (counts.sum(1, keepdims=True) + KAPPA))


def _votes(log_p: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Log likelihood of contexts under each class: rows of counts of classes before and after."""
    prior = np.log(np.exp(log_p).mean(0))[:CLASSES]
    return left @ (log_p[:, :CLASSES] - prior) + right @ log_p[:CLASSES].T


def exchange(coded: DataFrame, head: np.ndarray, passes: int) -> np.ndarray:
    """Class of each head word (``head``: hashes, most frequent first)."""
    n = len(head)
    order = np.argsort(head)
    sorted_head, classes = head[order], np.arange(n) % CLASSES
    for step in range(passes if n else 0):
        contexts = _contexts(coded, sorted_head, order, classes)
        transitions = np.zeros((CLASSES + 1, CLASSES + 1))
        np.add.at(transitions, (classes,), contexts[:, 1])
        transitions[CLASSES] = 0
        np.add.at(transitions[CLASSES], classes, contexts[:, 0, CLASSES])
        votes = _votes(_log_transitions(transitions), contexts[:, 0].astype(float), contexts[:, 1].astype(float))
        # a word's own contexts speak for its class; ties and silent words stay
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), classes]
        move = (gain > 1e-9) & (np.arange(n) % 2 == step % 2)
        classes = np.where(move, best, classes)
        if step and not move.any():
            break
    return classes


def _join_classes(coded: DataFrame, head: np.ndarray, classes: np.ndarray) -> DataFrame:
    """Rows (h, cls, vote) for every word of a chunk, and (pair, n) rows of class transitions."""
    order = np.argsort(head)
    sorted_head = head[order]
    contexts = _contexts(coded, sorted_head, order, classes) if len(head) else np.zeros((0, 2, CLASSES + 1))
    transitions = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(transitions, (classes,), contexts[:, 1])
    np.add.at(transitions[CLASSES], classes, contexts[:, 0, CLASSES])
    log_p = _log_transitions(transitions)
    prior = np.log(np.exp(log_p).mean(0))[:CLASSES]
    before, after = log_p[:, :CLASSES] - prior, np.ascontiguousarray(log_p[:CLASSES].T)

    def vote(batches):
        pairs = np.zeros((CLASSES + 1) ** 2, np.int64)
        for batch in batches:
            for row in _rows(batch):
                codes = _training(row)
                cls, word = _head_classes(row, sorted_head, order, classes)
                n = len(cls)
                scores = np.zeros((n, CLASSES), np.float32)
                token = cls[codes]
                for own, context, table in ((codes[1:], token[:-1], before), (codes[:-1], token[1:], after)):
                    for c in range(CLASSES + 1):
                        hit = np.bincount(own[context == c], minlength=n)
                        at = np.flatnonzero(hit)
                        scores[at] += hit[at, None] * table[c].astype(np.float32)
                best = scores.argmax(1)
                margin = scores[np.arange(n), best] - np.partition(scores, -2, axis=1)[:, -2]
                best = np.where(cls >= 0, cls, best)
                full = best[codes]
                pairs += np.bincount(full[:-1] * (CLASSES + 1) + full[1:], minlength=len(pairs))
                vocab, train = row["vocab"], row["train"]
                some = train > 0
                weight = np.where(word[1:] >= 0, 1e12, 1e-3 + margin[1:].astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(vocab[some]), pa.array(best[1:][some].astype(np.int32)), pa.array(weight[some])], ["h", "cls", "vote"])
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(np.full(len(seen), -1, np.int32)), pa.array(pairs[seen].astype(np.float64))], ["h", "cls", "vote"])

    return coded.select("held", "sizes", "vocab", "train", "codes").mapInArrow(vote, "h long, cls int, vote double")


def score_texts(docs: DataFrame, head_words: int = HEAD, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text, held).

    Rows with ``held`` false train the model. NULL and empty texts have the end token alone. Without training rows
    every token is unknown and both scores are 0. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "held")
    coded = materialize(code_texts(docs), "coded")
    spots = coded.select("chunk", F.posexplode(F.arrays_zip("vocab", "train")).alias("i", "w")).select("chunk", "i", F.col("w.vocab").alias("h"), F.col("w.train").alias("n"))
    counts = materialize(spots.filter("n > 0").groupBy("h").agg(F.sum("n").alias("c")), "word-counts")
    totals = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = coded.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_train, n_types = totals["n"] + ends, totals["v"] + (ends > 0)

    top = counts.orderBy(F.desc("c"), "h").limit(head_words).toArrow()
    head = top.column("h").to_numpy()
    classes = exchange(coded, head, passes)
    votes = materialize(_join_classes(coded, head, classes).groupBy("h", "cls").agg(F.sum("vote").alias("vote")), "votes")
    pairs = votes.filter("cls = -1").toArrow()  # at most (classes + 1)^2 cells
    transitions = np.zeros((CLASSES + 1) ** 2)
    transitions[pairs.column("h").to_numpy()] = pairs.column("vote").to_numpy()
    transitions = transitions.reshape(CLASSES + 1, CLASSES + 1)
    chosen = votes.filter("cls >= 0").groupBy("h").agg(F.max_by("cls", F.struct("vote", "cls")).alias("cls"))
    words = materialize(counts.join(chosen, "h", "left").select("h", "c", F.coalesce("cls", F.lit(0)).alias("cls")), "words")
    sums = words.groupBy("cls").agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    mass, once = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in sums:
        mass[r["cls"]], once[r["cls"]] = r["n"], r["once"]
    mass[CLASSES] = ends
    unseen = np.clip((once + 0.5) / (mass + 1.0), 1e-9, 0.5)
    unseen[CLASSES] = 0.0
    move = np.exp(_log_transitions(transitions))
    # a class without words gives its share to the others
    move[:, mass == 0] = 0.0
    move /= np.maximum(move.sum(1, keepdims=True), 1e-300)
    lost = move @ unseen
    base_of = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1)))

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = next(_rows(left.select(["doc_ids", "held", "sizes", "codes"]).combine_chunks().to_batches()[0]))
        size = left.column("n_words")[0].as_py() + 1
        c, cls = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        spot = right.column("i").to_numpy() + 1
        c[spot], cls[spot] = right.column("c").to_numpy(), right.column("cls").to_numpy()
        c[0], cls[0] = ends, CLASSES if ends else -1
        codes, sizes = _unpack(row["codes"]), row["sizes"]
        k, n = cls[codes], c[codes]
        known = n > 0
        # history: the class of the last known token of the text, at first the end
        first = np.cumsum(sizes) - sizes
        at = np.where(known, np.arange(len(codes)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], at[:-1]]))
        before = np.where(last >= np.repeat(first, sizes), k[np.maximum(last, 0)], CLASSES)
        kk = np.maximum(k, 0)
        by_class = np.where(known, move[before, kk] * (1 - unseen[kk]) * n / np.maximum(mass[kk], 1), lost[before])
        base = base_of(n)
        full = np.log10(CLASS_SHARE * by_class + (1 - CLASS_SHARE) * 10.0**base) if n_train else np.zeros(len(codes))
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": left.column("doc_ids").combine_chunks().flatten(), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": sizes,
            "n_known": add(known.astype(np.int64)), "train_tokens": np.full(len(sizes), n_train, np.int64), "base_score": add(base), "score": add(full),
        })

    looked = spots.select(F.col("chunk").alias("of"), "i", "h").join(words, "h").select("of", "i", "c", "cls")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = coded.select("chunk", "doc_ids", "held", "sizes", F.size("vocab").alias("n_words"), "codes")
    return texts.groupBy("chunk").cogroup(looked.groupBy("of")).applyInArrow(score, schema)


def query(spark, sf_dir) -> DataFrame:
    """op5: log10 probability of every document, learnt from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.select("doc_id", "text", held_back(F.col("doc_id"), 5, 1).alias("held")))

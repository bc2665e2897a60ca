"""Toxicity of documents: restore disguised words by a noisy channel, then score the restored text.

* Character model: counts of letter triples over every document (words with their borders), smoothed. Its table
  has a fixed number of cells, whatever the corpus.
* Channel: a token that looks disguised (digits or signs among letters, a letter three times, single letters with
  gaps) becomes a lattice: each sign may stand for letters, be an insertion, a repeat or a word border. A Viterbi
  pass under the character model picks the restored words. Plain tokens are left as they are.
* Score: a rule list of words and word beginnings, learnt from labelled rows. Rules are taken greedily: the one
  that covers most toxic documents not yet covered, if precise enough, until none adds enough. A document's score
  is the smoothed precision of its best rule, or the rest rate.

The rules are fitted on at most ``fit_rows`` labelled documents (chosen by a hash of the id); all counts of the
character model and all scores cover every whole text. The rule list and the model are the only things sent out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.runtime import materialize
from tidewatch.llm import word_hash
from tidewatch.llm.common import held_back

#: Symbols of the character model: border, a to z, any letter beyond ASCII.
SYMBOLS = 28
#: Labelled documents that fit the rules, at most about so many.
FIT_ROWS = 20_000
#: Bytes of tokens, with about so many more for each, whose score a worker remembers before it starts afresh.
CACHE_BYTES, TOKEN_BYTES = 1 << 26, 150
#: Features and rows that a task holds while it counts.
HELD_FEATURES = 1 << 17
#: A rule covers at least so many toxic documents not covered before, with at least this precision.
SUPPORT, PRECISION = 4, 0.7
#: A feature that others make needless in the sample is a rule all the same from this support, share of the toxic
#: documents and precision on. The share keeps out words that only copies of one document have.
STRONG_SUPPORT, STRONG_SHARE, STRONG_PRECISION = 10, 0.04, 0.99
BEGINNINGS = (4, 5, 6)
#: Letters that digits and signs stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
GAPS = " .-_*~'`"
#: Log chances of the channel: a letter stands for itself, for a sign; one of three or more alike is a repeat, one of
#: two is; a gap is an insertion, another sign is; a gap is a border.
SELF, STANDS, REPEAT, TWICE, GAP, INSERT, BORDER = log(0.95), log(0.3), log(0.4), log(0.002), log(0.3), log(0.00002), log(0.3)

_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else 27 if b >= 128 else 0 for b in range(256)], np.int32)
_DISGUISED = re.compile(r"[a-z][0-9@$!|+*_.\-~'`]+[a-z]|(?<![a-z0-9])[0-9@$|+]+[a-z]{2}|[a-z]{2}[013457@$|]+(?![a-z0-9])|([a-z])\1\1")
_SPACED = re.compile(rb"(?<![a-z0-9@$!])(?:[a-z0-9@$!|][ .\-_*~]{1,3}){2,}[a-z0-9@$!|](?![a-z0-9@$!])")


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol triples over all texts."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, texts in word_hash.chunks(batch.column(0)):
                s = _SYMBOL[np.frombuffer(b" ".join([b"", *texts, b""]).lower(), np.uint8)]
                s = s[(s > 0) | (np.roll(s, 1) > 0)]  # one border between words
                s = np.concatenate([[0], s, [0]]).astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "cell long, n long")
    table = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS ** 3 cells
    out = np.zeros(SYMBOLS**3)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def character_model(counts: np.ndarray) -> np.ndarray:
    """Log chance of a symbol after two others: triples backed by pairs backed by single symbols."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(0) + 5 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def restore(token: str, model: np.ndarray) -> str:
    """Most likely words behind a lower-case token (or spaced letters), words parted by spaces. Letters beyond ASCII stay."""
    # a path is its score and its last letter with the path before; paths that merge share what lies behind them
    paths = {(0, 0): (0.0, None)}
    before = ""
    for i, ch in enumerate(token):
        options = []
        if "a" <= ch <= "z" or ord(ch) > 127:
            options.append((ch, SELF))
        else:
            options += [(letter, STANDS - log(len(LEET[ch]))) for letter in LEET.get(ch, "")]
            options.append(("", GAP if ch in GAPS else INSERT))
            if ch in GAPS or ch not in LEET:
                options.append((" ", BORDER))
        if ch == before:
            options.append(("", REPEAT if ch * 3 in token[max(0, i - 2) : i + 3] else TWICE))
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (p, q), (score, text) in paths.items():
            for letter, chance in options:
                if letter == "":
                    key, value = (p, q), score + chance
                elif letter == " ":
                    key, value = (q, 0), score + chance + model[p, q, 0]
                    if q == 0:
                        key, value = (p, q), score + chance
                else:
                    symbol = ord(letter) - 96 if "a" <= letter <= "z" else 27
                    key, value = (q, symbol), score + chance + model[p, q, symbol]
                if key not in step or value > step[key][0]:
                    step[key] = (value, (letter, text) if letter else text)
        paths, before = step, ch
    ends = [(score + model[p, q, 0], text) for (p, q), (score, text) in paths.items()]
    best = max(score for score, _ in ends)
    return max(_spelled(text) for score, text in ends if score == best)


def _spelled(text: tuple | None) -> str:
    """Letters of a path of ``restore``, which holds them last first."""
    out = []
    while text:
        letter, text = text
        out.append(letter)
    return "".join(reversed(out))


@dataclass
class Model:
    """``rules``: feature -> score; ``rest``: score without a rule; ``letters``: the character model."""

    letters: np.ndarray
    rules: dict[str, float] = field(default_factory=dict)
    rest: float = 0.0


def features(word: str) -> list[str]:
    return [f"={word}"] + [word[:n] for n in BEGINNINGS if len(word) > n] + ([word] if len(word) in BEGINNINGS else [])


def _words(token: bytes, letters: np.ndarray) -> set[str]:
    """Words of a lower-case token, and what is restored of it if it looks disguised."""
    words = set(token.translate(_WORDS).decode("utf-8", "ignore").split())
    text = token.decode("utf-8", "ignore").strip(".,;:?\"'()[]{}<>%&#")
    if _DISGUISED.search(text):
        words |= set(restore(text.rstrip("!*$"), letters).split())
    return words


def document_words(text: bytes, letters: np.ndarray) -> set[str]:
    low = text.decode("utf-8", "ignore").lower().encode()
    words = set()
    for token in set(low.split()):
        words |= _words(token, letters)
    for run in _SPACED.findall(low):
        words |= set(restore(run.decode(), letters).split())
    return words


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on ``docs`` (doc_id, text) joined with ``labels`` (doc_id, toxic) outside the held-out quarter.

    A document with several labels is toxic if any is; NULL labels and ids are left out. Without usable rows the model
    has no rules and scores everything with 0.
    """
    letters = character_model(character_counts(docs))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_back(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.filter((F.xxhash64("doc_id").bitwiseAND((1 << 20) - 1)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(known, "doc_id").select("doc_id", "text", "toxic")

    def gather(batches):
        """Counts of features, a bounded number at a time; toxic documents also give (feature, document) rows."""
        counts: Counter = Counter()
        out: tuple = ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())

        def flush():
            for f, n in counts.items():
                out[0].append(f), out[1].append(None), out[2].append(0), out[3].append(n)
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["f", "doc", "toxic", "n"])
            counts.clear()
            for v in out:
                v.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, toxic = batch.column(0)[i].as_py(), batch.column(1)[i], batch.column(2)[i].as_py()
                words = document_words(text.as_buffer().to_pybytes() if text.is_valid else b"", letters)
                mine = {f for w in words for f in features(w)}
                if toxic:
                    for f in mine:
                        out[0].append(f), out[1].append(doc_id), out[2].append(1), out[3].append(1)
                else:
                    counts.update(mine)
                out[0].append(""), out[1].append(doc_id), out[2].append(int(bool(toxic))), out[3].append(1)
                if len(counts) + len(out[0]) >= HELD_FEATURES:
                    yield flush()
        yield flush()

    seen = materialize(rows.mapInArrow(gather, "f string, doc long, toxic long, n long"), "toxic-features")
    total = seen.filter("f = ''").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).first()
    if not total["t"]:
        return Model(letters)
    counts = seen.filter("f <> ''").groupBy("f").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
    counts = counts.filter((F.col("t") >= SUPPORT) & (F.col("t") >= F.lit(PRECISION) * F.col("n")))
    pairs = seen.filter("f <> '' AND toxic = 1").select("f", "doc").join(counts, "f").toPandas()  # of the bounded sample
    return Model(letters, *_rules(pairs, total["n"], total["t"]))


def _rules(pairs, n_docs: int, n_toxic: int) -> tuple[dict[str, float], float]:
    """Greedy cover of toxic documents; equal covers prefer the most precise, then the longest feature."""
    docs_of = {f: set(g) for f, g in pairs.groupby("f")["doc"]}
    facts = pairs.drop_duplicates("f").set_index("f")[["n", "t"]].to_dict("index")
    rules, covered, touched = {}, set(), 0
    while docs_of:
        best = max(docs_of, key=lambda f: (len(docs_of[f]) * facts[f]["t"] / facts[f]["n"], f[0] == "=", len(f), f))
        fresh = docs_of.pop(best)
        if len(fresh) < SUPPORT:
            break
        rules[best] = (facts[best]["t"] + 0.5) / (facts[best]["n"] + 1.0)
        covered |= fresh
        touched += len(fresh) + facts[best]["n"] - facts[best]["t"]
        docs_of = {f: d - fresh for f, d in docs_of.items() if len(d - fresh) >= SUPPORT}
    for f, x in facts.items():
        if f not in rules and x["t"] >= max(STRONG_SUPPORT, STRONG_SHARE * n_toxic) and x["t"] >= STRONG_PRECISION * x["n"]:
            rules[f] = (x["t"] + 0.5) / (x["n"] + 1.0)
    rest = (n_toxic - len(covered) + 0.5) / (max(n_docs - touched, n_toxic - len(covered)) + 1.0)
    return rules, rest


class Scorer:
    """Scores texts; remembers what it found of each token."""

    def __init__(self, model: Model):
        self.model, self.seen, self.held = model, {}, 0

    def _token(self, token: bytes) -> float:
        rules = self.model.rules
        return max((rules[f] for w in _words(token, self.model.letters) for f in features(w) if f in rules), default=0.0)

    def __call__(self, text: bytes) -> float:
        seen, best = self.seen, 0.0
        low = text.decode("utf-8", "ignore").lower().encode()
        for token in set(low.split()):
            score = seen.get(token)
            if score is None:
                if self.held >= CACHE_BYTES:
                    seen.clear()
                    self.held = 0
                score = seen[token] = self._token(token)
                self.held += len(token) + TOKEN_BYTES
            if score > best:
                best = score
        for run in _SPACED.findall(low):
            for word in restore(run.decode(), self.model.letters).split():
                best = max(best, *(self.model.rules.get(f, 0.0) for f in features(word)))
        return best or self.model.rest


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` (with a column text) and the score of each row, 0 to 1; NULL and empty texts get the rest rate.

    A column of the result's name is replaced; all others pass through.
    """
    docs = docs.drop(name)
    text_at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer(t.as_buffer().to_pybytes()) if t.is_valid else shared.value.rest for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


#: Scores from here on are toxic.
THRESHOLD = 0.3


def query(spark, sf_dir) -> DataFrame:
    """op10: toxicity of every document, learnt from the labelled rows outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        held_back(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

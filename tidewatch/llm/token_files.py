"""Tokenize documents and store the ids in Simple-8b files in ascending id order.

Texts are range-partitioned by doc_id and sorted; each task tokenizes, packs and writes its range, so the
ids are never shuffled. A file row is a segment of whole documents: their ids and lengths, and one payload
with a header, the word offset of each block and the words. Reading decodes segment by segment; the number of
ids before a document is a sum over ranges, over segments of its range and inside its segment.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.runtime import scratch_dir
from tidewatch.llm import simple8b

SCHEMA = "part int, seq long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
MAGIC = b"S8B1"
#: Ids in a segment before the next begins; a document is never cut.
SEGMENT = 1 << 18
#: Characters of text tokenized together.
BATCH_CHARS = 1 << 21
#: Distinct pieces kept by a worker before it starts afresh: bounds its memory.
CACHE = 1_000_000

# Plain pieces: Latin letters, then punctuation that no rule of the tokenizer joins with letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:%$*&#@()\[\]{}\-_+=~^/\\\"]*)\Z")


class _Codes(dict):
    """Numbers pieces in the order in which they are first asked for; ``fresh`` lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        code = self[piece] = len(self)
        self.fresh.append(piece)
        return code


class PieceEncoder:
    """Token ids of white-space separated pieces, remembered by piece.

    The tokenizer never joins text across ASCII white space, so a text's ids are its pieces' ids in turn.
    Plain pieces go to the BPE model directly; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = str.maketrans(_byte_letters())
        self.clear()

    def clear(self):
        self.index = _Codes()
        self.parts: dict[str, list[int]] = {}
        self.sizes, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _part(self, text: str) -> list[int]:
        if not text:
            return []
        found = self.parts.get(text)
        if found is None:
            mapped = text.encode().decode("latin-1").translate(self.letters)
            found = self.parts[text] = [t.id for t in self.model.tokenize(mapped)]
        return found

    def _learn(self, pieces: list[bytes]):
        """Encode new pieces together: one decode, one array of ids."""
        sizes, flat, part = [], [], self._part
        plain, whole, known = _PLAIN.match, self.whole.encode, self.parts
        for text in b" ".join(pieces).decode().split(" "):
            found = plain(text)
            if found:
                letters, signs = found.groups()
                letters = letters.lower()
                ids = known.get(letters) or part(letters)
                if signs:
                    ids = ids + (known.get(signs) or part(signs))
            else:
                ids = whole(text, add_special_tokens=False).ids
            sizes.append(len(ids))
            flat += ids
        sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])

    def __call__(self, texts: list[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text), each text closed by ``end_id``."""
        if len(self.index) > CACHE:
            self.clear()
        pieces, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            mine = text.split()
            counts[i] = len(mine)
            pieces += mine
        codes = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if self.index.fresh:
            self._learn(self.index.fresh)
            self.index.fresh = []
        sizes = self.sizes[codes]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(counts)
        lengths = bounds[last] - bounds[last - counts] + (end_id is not None)
        # a piece's ids stand after those of earlier pieces and one end id for each earlier text
        to = bounds[:-1] + (np.repeat(np.arange(len(texts)), counts) if end_id is not None else 0)
        out = np.full(int(lengths.sum()), 0 if end_id is None else end_id, np.uint32)
        inner = np.arange(int(sizes.sum())) - np.repeat(bounds[:-1], sizes)
        out[np.repeat(to, sizes) + inner] = self.ids[np.repeat(self.starts[codes], sizes) + inner]
        return out, lengths


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabets: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def pack(ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    head = struct.pack("<4sIQQ", MAGIC, simple8b.BLOCK, len(ids), len(words))
    return head + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    magic, block, n, n_words = struct.unpack_from("<4sIQQ", payload)
    if magic != MAGIC or block != simple8b.BLOCK:
        raise ValueError("not a Simple-8b payload of this version")
    at = struct.calcsize("<4sIQQ") + 4 * -(-n // block)
    return simple8b.decode(np.frombuffer(payload, "<u8", n_words, at), n)


def _text_chunks(batch: pa.RecordBatch):
    """(ids, texts) slices of bounded length; a NULL text is empty."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_buffer().to_pybytes() if text.is_valid else b""
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2) -> None:
    """Write doc_id, text as Simple-8b segments. ``tokenizer``: a tokenizers file that every executor can open.

    NULL and empty texts have only the end id; rows of one id follow one another; NULL ids come first.
    """

    def segments(batches):
        encode, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lengths, held, size = [], [], [], 0

        def flush():
            nonlocal ids, lengths, held, size, seq
            row = [[part], [seq], [size], [ids], [np.concatenate(lengths).tolist()], [pack(np.concatenate(held))]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "seq", "n_ids", "doc_ids", "lengths", "payload"]
            ids, lengths, held, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for some, texts in _text_chunks(batch):
                tokens, counts = encode(texts, end_id)
                ids += some
                lengths.append(counts)
                held.append(tokens)
                size += len(tokens)
                if size >= SEGMENT:
                    yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(segments, SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, seq, place, ids of every stored document."""
    return _documents(spark.read.parquet(path), lambda ids: ids.tolist(), "ids array<long>", pa.list_(pa.int64()))


def _documents(stored: DataFrame, value, column: str, kind: pa.DataType) -> DataFrame:
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = unpack(row["payload"]).astype("<u4"), np.array(row["lengths"], np.int64)
                before = np.cumsum(lengths) - lengths
                values = [value(ids[b : b + n]) for b, n in zip(before, lengths)]
                same = lambda v, t: pa.array(np.full(len(lengths), v), t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), same(row["part"], pa.int32()), same(row["seq"], pa.int64()), pa.array(before), pa.array(lengths), pa.array(values, kind)],
                    ["doc_id", "part", "seq", "before", "n_tokens", column.split()[0]],
                )

    return stored.mapInArrow(read, f"doc_id long, part int, seq long, before long, n_tokens long, {column}")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian 32-bit ids), from the files."""
    stored = spark.read.parquet(path)
    crc = _documents(stored, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32 long", pa.int64())
    sizes = stored.select("part", "seq", "n_ids")
    inner = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    # one row per written range
    ranges = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    sizes = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("offset"))
    base = sizes.join(ranges, "part").select("part", "seq", (F.col("base") + F.col("offset")).alias("base"))
    return crc.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir) -> DataFrame:
    """op4: every document tokenized, stored and read back."""
    import public_tokenizers

    path = f"{scratch_dir(spark)}/tidewatch-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), path)
    return token_index(spark, path)

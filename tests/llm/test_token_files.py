import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import simple8b
from tidewatch.llm.token_files import PieceEncoder, query, read_token_files, token_index, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**31, 2**60, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 1023, 1024, 1025, 5000])
def test_round_trip(top, n):
    rng = np.random.default_rng(n)
    values = np.minimum(rng.exponential(top / 3 + 0.5, n), float(top) * 0.99).astype(np.uint64)
    if n > 3:
        values[2], values[3] = top, 0
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, n) == values).all()
    for block in range(len(offsets)):
        part = simple8b.decode_block(words, offsets, block, n)
        assert (part == values[block * 1024 : (block + 1) * 1024]).all()


def test_small_values_share_words():
    words, _ = simple8b.encode(np.ones(1020, np.uint64))
    assert len(words) == 17


TEXTS = [None, "", " \n\t", "Hello, WORLD! it's they'll 12ab3", "é É é Σας ΑΣ naïve ½ x²", "a b c\u0085d\x1ce", "<|endoftext|> a<|startoftext|>b <|", "....?!x--y 'tis 'S", "🙂🙃 ‍ ﬁ İI ı", "word " * 3000, "x" * 5000, "don't.Stoṕ ́ a ́b"]


def test_pieces_equal_the_tokenizer():
    plain = Tokenizer.from_file(PATH)
    ids, lengths = PieceEncoder(PATH)([(t or "").encode() for t in TEXTS], 2)
    at = 0
    for text, n in zip(TEXTS, lengths):
        assert ids[at : at + n].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]
        at += n


def test_files(spark, tmp_path):
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    write_token_files(docs, PATH, str(tmp_path / "f"))
    got = token_index(spark, str(tmp_path / "f")).orderBy("start").collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted(((-1 if i is None else i), i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows)
    start = 0
    assert [r.doc_id for r in got] == [w[1] for w in want]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    full = {(r.doc_id, tuple(r.ids)) for r in read_token_files(spark, str(tmp_path / "f")).collect()}
    assert full == {(i, tuple(ids)) for _, i, ids in want}


def test_empty_table(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "e"))
    assert token_index(spark, str(tmp_path / "e")).count() == 0


def test_query_matches_plain_tokenizer(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    plain, start = Tokenizer.from_file(PATH), 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)

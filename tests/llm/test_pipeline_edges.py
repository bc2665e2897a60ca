"""Stages of the pipeline on NULLs, repeated ids, empty tables and columns named like working columns."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
TEXT = " ".join(f"w{i}" for i in range(80))
ROWS = [(1, TEXT, "a"), (1, TEXT + " more", "a"), (2, None, None), (None, TEXT, "b"), (3, "", "b"), (4, "quiet words about nothing at all", None)]


@pytest.fixture(scope="module")
def odd(spark):
    names = ["row", "_rk", "_id", "_key", "_copies", "_copy", "_toxicity", "shard_"]
    rows = [(*r, *range(10 * i, 10 * i + len(names))) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_columns_and_rows(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    rows = out.collect()
    assert out.columns[: len(odd.columns)] == odd.columns
    given = {tuple(r) for r in odd.collect()}
    assert {tuple(r)[: len(odd.columns)] for r in rows} <= given
    # near copies: one of the three rows with the long text stays
    least = {"ngram_jaccard_join": 4, "mixing": 1}.get(name, len(ROWS))
    assert len(rows) == least if name == "ngram_jaccard_join" else len(rows) >= least
    assert stage(spark, odd.filter("false"), SF).count() == 0

"""One doc_id over several texts: rows are documents of their own, and no text is lost with another one's copy."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from folioloom.llm import neardup, queries

A, B, C = (
    " ".join(f"{w}{i}" for i in range(12) for w in words)
    for words in (("the", "quick", "brown"), ("ships", "on", "the", "sea"), ("one", "more", "text", "of", "words"))
)
NEAR_A = A + " again"
#: Text A of doc 4 has no copy; text B of doc 4 is one of doc 2's. Doc 9 holds two texts that are near copies.
ROWS = [(2, B), (4, A), (4, B), (9, C), (9, C + " indeed"), (4, A), (11, ""), (12, None), (13, "one two"), (13, "one two three")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_components(docs):
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.components(docs).collect())
    assert got == [(2, 2, True), (4, 2, False), (4, 4, True), (4, 4, True), (9, 9, True), (9, 9, True), (11, 11, True), (12, 12, True), (13, 13, True), (13, 13, True)]


def test_components_equal_sql(docs, tmp_path):
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = db.sql(queries.oracle_sql()["op5_neardup"])
    got = neardup.components(docs).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("schemes", [(neardup.OP5,), (neardup.OP5, neardup.STAGE)])
def test_unique(docs, schemes):
    got = sorted((r["doc_id"], r["text"]) for r in neardup.unique(docs, schemes).collect() if r["text"] is not None)
    assert got[:3] == [(2, B), (4, A), got[2]] and got[2][0] == 9 and got[3:] == [(11, ""), (13, "one two"), (13, "one two three")]
    again = sorted((r["doc_id"], r["text"]) for r in neardup.unique(docs, schemes).collect() if r["text"] is not None)
    assert got == again


def test_pipeline_stage(spark, docs):
    found = corpus_pipeline.neardup_stage(spark, docs, "")
    assert {r["text"] for r in found.collect()} >= {A, B, "", None} and found.columns == docs.columns


def test_schemes_join(spark):
    """a~b by the first scheme only and b~c by the second only are one group of the stage."""
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "x " + " ".join(words[:-1])), (4, NEAR_A)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.unique(df, (neardup.OP5, neardup.STAGE)).collect()) == [1, 4]


def test_common():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 50), dtype=np.uint64)) for _ in range(2))
        assert neardup.common(a, b) == len(set(a.tolist()) & set(b.tolist()))

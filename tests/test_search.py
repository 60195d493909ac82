"""The approximate vector index, and BM25 with dynamic pruning, against the exact searches."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import ann, pruned, retrieval
from folioloom.sources import snapshots

DIR = "/root/testdata/sf0.01"


def hits(df):
    return {(r["query"], r["rank"]): (r["doc"], r["score"]) for r in df.collect()}


def same(found, expected):
    got, want = hits(found), hits(expected)
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert {k: x[1] for k, x in got.items()} == pytest.approx({k: x[1] for k, x in want.items()}, abs=2e-6)


def test_recall_of_cells(spark, tmp_path):
    """At least nine of ten of the true best 20; the given vectors have no clusters, so many cells are needed. Those with
    clusters need few."""
    v = spark.read.parquet(f"{DIR}/embeddings.parquet")
    path = str(tmp_path / "v")
    ann.build(v, path)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    true = {(r["query"], r["doc"]) for r in retrieval.dense(v, asked).collect()}
    found = {(r["query"], r["doc"]) for r in ann.search(spark, path, asked).collect()}
    recall = len(true & found) / len(true)
    assert recall >= 0.9, recall
    assert len(ann.centres_of(spark, path, snapshots.version(spark, path))) == round(v.count() ** 0.5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 32)).repeat(50, axis=0) + rng.normal(size=(2000, 32)) * 0.2
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc long, v array<double>")
    centres, part = ann.trained(rows, 45)
    assert len(centres) == 45 and part <= 0.1


def test_cells_follow_changes(spark, tmp_path):
    rng = np.random.default_rng(3)
    path = str(tmp_path / "v")
    rows = {i: x / np.linalg.norm(x) for i, x in enumerate(rng.normal(size=(300, 8)))}
    frame = lambda items: spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in items], "vec_id long, embedding array<double>, label int")
    ann.build(frame(rows.items()).unionByName(spark.createDataFrame([(900, None, 0), (901, [], 0), (902, [float("nan")] * 8, 0)], "vec_id long, embedding array<double>, label int")), path, cells=9)
    new = {i: x / np.linalg.norm(x) for i, x in zip((5, 6, 400), rng.normal(size=(3, 8)), strict=True)}
    ann.upsert(frame(new.items()), path)
    ann.remove(spark, path, spark.createDataFrame([(i,) for i in (*range(10, 60), 1, 2, 3, 4, 7, 999)], "doc long"))
    rows = {i: x for i, x in (rows | new).items() if i not in (*range(10, 60), 1, 2, 3, 4, 7)}
    asked = spark.createDataFrame([(f"q{i}", rows[i].tolist()) for i in (0, 5, 400)], "query string, vector array<double>")
    exact = hits(retrieval.dense(frame(rows.items()), asked, 6, F.col("label") != 1))
    assert hits(ann.search(spark, path, asked, 6, probes=9, where=F.col("label") != 1)) == exact
    some = ann.search(spark, path, asked, 6, probes=2)
    assert some.filter("rank = 0").count() == 3 and {r["doc"] for r in some.filter("rank = 0").collect()} == {0, 5, 400}
    assert ann.search(spark, path, asked.limit(0)).count() == 0


@pytest.mark.parametrize("documents", [8, 64])
def test_pruned_equals_all_postings(spark, documents):
    rng = random.Random(documents)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=rng.choice((0, 3, 20, 200)))) for _ in range(500)] + ["w0 w1"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = [(1, "w0 w1 w2 w350"), (2, "w0 w0 w0"), (3, "none"), (4, " ".join(rng.choices(words, k=30))), (5, "w0 w1 w2 w3 w390 w391 w392"), (6, "")]
    asked = spark.createDataFrame(queries, "item_id int, text string")
    index = retrieval.index_of(docs)
    found = pruned.search(pruned.blocks_of(index, documents), asked, 7)
    same(found.hits, retrieval.bm25(index, asked, 7))


def test_pruned_reads_less(spark):
    """Questions of a rare word and many frequent ones: most of the frequent words' postings stay unread."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(10)]
    texts = [" ".join([*common, *(rng.choice(common) for _ in range(30)), f"r{i % 700}"]) for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join([*common, f"r{i}", f"r{i + 1}"])) for i in range(4)], "item_id int, text string")
    index = retrieval.index_of(docs)
    found = pruned.search(pruned.blocks_of(index, 64), asked, 5)
    same(found.hits, retrieval.bm25(index, asked, 5))
    read = {r["step"]: r["n"] for r in found.read.groupBy("step").agg(F.sum("postings").alias("n")).collect()}
    assert read["first"] + read["second"] + read["third"] < 0.5 * read["all"], read


def test_cells_of_queries_by_one_sort():
    """All pairs of queries and cells were compared once for each cell."""
    rng = np.random.default_rng(1)
    vectors, centres = rng.normal(size=(50, 8)), rng.normal(size=(12, 8))
    near = np.argsort(-np.round(vectors @ centres.T, 9), axis=1, kind="stable")[:, :5]
    found = ann.asked_cells(vectors, centres, 5)
    assert sorted(found) == np.unique(near).tolist()
    assert all(np.array_equal(own, np.flatnonzero((near == c).any(axis=1))) for c, own in found.items())


def test_postings_are_shuffled_by_document(spark, monkeypatch):
    """Every posting was a row of two shuffles on its way into a block, and of one more for each query that read it."""
    seen = {}
    kept = pruned.materialized
    monkeypatch.setattr(pruned, "materialized", lambda df, name: (seen.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(50)], "doc_id long, text string")
    blocks = pruned.blocks_of(retrieval.index_of(docs), 8)
    assert seen["blocks"].count("Exchange") == 1 and seen["blocks"].index("Generate") < seen["blocks"].index("Exchange")
    pruned.search(blocks, spark.createDataFrame([(1, "a c1")], "item_id int, text string"), 5)
    assert "REPARTITION_BY_COL" not in seen["pruned-scores"] and "partial_sum" in seen["pruned-scores"]

"""Question pipelines over a few chunks, with models that can be read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import evaluation, retrieval
from folioloom.operators.providers import Providers, hashed_embedding
from folioloom.plans import pipelines

CHUNK = "chunk string, document string, section string, page int, text string, chunk_level int"
TEXTS = [
    ("a1", "a", "method", 1, "The alpha model reads long inputs with windows.", 0), ("a2", "a", "result", 2, "Alpha reaches 91 points on the test.", 0),
    ("b1", "b", "method", 1, "The beta model keeps a table of words.", 0), ("b2", "b", "abstract", 1, "Beta is a study of tables and words.", 0),
    ("b9", "b", "method", 1, "Summary of beta: tables.", 1), ("c1", "c", "references", 9, "Vaswani and others on attention.", 0),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(TEXTS, CHUNK)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query int, query_text string")


def test_compare(spark, chunks):
    queries = asked(spark, "alpha model against beta model", "one", "three", "no such document")
    targets = spark.createDataFrame([(0, ["b", "a"]), (1, ["a"]), (2, ["a", "b", "c"]), (3, ["a", "zz"])], "query int, targets array<string>")
    got = {r["query"]: r for r in pipelines.compare(chunks, queries, targets).collect()}
    assert {q: r["error"] for q, r in got.items()} == {0: None, 1: "insufficient_docs", 2: "too_many_docs", 3: "insufficient_contexts"}
    assert "beta" in got[0]["context_a"] and "alpha" not in got[0]["context_a"].lower() and "alpha" in got[0]["context_b"].lower()
    assert got[0]["prompt"].startswith("Compare") and got[0]["answer"] and not got[1]["answer"] and "[1] " in got[0]["sources"]


def test_hybrid_within_stays_in_documents(spark, chunks):
    queries = asked(spark, "tables and words", "windows")
    targets = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], "query int, document string")
    rows = pipelines.hybrid_within(chunks, queries, targets, 20, where=F.col("section") == "method").collect()
    assert {(r["query"]["query"], r["query"]["document"], r["doc"]) for r in rows} == {(0, "a", "a1"), (0, "b", "b1"), (0, "b", "b9"), (1, "a", "a1")}


def test_summary_of_a_document(spark, chunks):
    out = pipelines.summary(chunks, asked(spark, "summarize beta"), targets=spark.createDataFrame([(0, "b")], "query int, document string")).first()
    assert out["error"] is None and out["context"].startswith("Beta is a study") and "Summary of beta" in out["context"] and "lpha" not in out["context"]


def test_citations_are_fetched_and_searched(spark, chunks):
    works = spark.createDataFrame([("c", "reference", 1, "Attention", "id:1"), ("c", "reference", 2, "Unknown work", "ti:x"), ("c", "patent", 1, "Lens", "US1")], "doc string, kind string, no int, title string, key string")
    known = spark.createDataFrame([("id:1", "Attention Is All You Need", "https://arxiv.org/pdf/1", True, None), ("US1", None, None, False, "timeout")], "key string, title string, pdf_url string, fetched boolean, fetch_error string")
    taken = spark.createDataFrame([("https://arxiv.org/pdf/1", "application/pdf", "%PDF-1.4", "transformer heads " * 40), ("https://arxiv.org/pdf/2", "text/html", "<html>", "no " * 90)], "url string, content_type string, head string, text string")
    said = {(r["kind"], r["no"]): r for r in pipelines.tracked(works, known, taken)[0].collect()}
    assert said["reference", 1]["fetched"] and said["reference", 1]["has_pdf"] and said["reference", 1]["title"] == "Attention Is All You Need"
    assert said["reference", 2]["fetch_error"] == "arxiv_not_found" and said["patent", 1]["fetch_error"] == "timeout" and said["patent", 1]["title"] == "Lens"
    queries = spark.createDataFrame([(0, "transformer heads", "c")], "query int, query_text string, document string")
    out = pipelines.citation_qa(chunks, queries, works, known, taken).first()
    assert out["newly_indexed"] == 1 and "c__cited__1" in out["sources"] and len(out["citations"]) == 3


def test_expansion(spark):
    wrote = Providers(write=lambda p: F.when(F.startswith(p, F.lit("Translate")), "what is it?").otherwise(F.concat(F.lit("passage on "), F.substring_index(p, "\n\n", -1))))
    queries = asked(spark, "무엇인가?", "what?")
    got = {r["query"]: tuple(r)[2:] for r in pipelines.expansion(queries, models=wrote).collect()}
    assert got == {0: ("what is it?", "passage on what is it?", "passage on what is it?"), 1: (None, "passage on what?", "passage on what?")}
    assert {r["search_text"] for r in pipelines.expansion(queries, "ko", wrote).collect()} == {"passage on 무엇인가?", "passage on what?"}
    assert [r["search_text"] for r in pipelines.expansion(queries).orderBy("query").collect()] == ["무엇인가?", "what?"]


def test_excerpts(spark, chunks):
    papers = spark.createDataFrame([("a",), ("c",)], "paper string")
    found = pipelines.excerpts(chunks, papers)
    rows = {(r["label"], r["paper"], r["section"], r["n"], r["preview"]) for r in found.collect()}
    assert ("main", "a", "method", 1, TEXTS[0][4]) in rows and ("citation-only", "c", "references", 1, TEXTS[5][4]) in rows
    assert {r[2] for r in rows if r[:2] == ("citation-only", "a")} == {"general"} and {r[2] for r in rows if r[:2] == ("main", "c")} == {"general"}
    text = {r["paper"]: r["context"] for r in pipelines.sampled_context(found).collect()}
    assert text["a"].startswith("[Main excerpts") and "[main | a | method | 1]\nThe alpha" in text["a"] and "[Citation-only excerpts" in text["a"]


def test_no_answer_reasons(spark, chunks):
    out = pipelines.simple_qa(chunks.limit(0), asked(spark, "q")).first()
    assert out["error"] == "no_search_results" and out["answer"] is None


@pytest.mark.parametrize("block", [10_000, 3])
def test_dense_equals_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 8)).round(2)
    rows[100:140] = rows[7]  # ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)] + [(999, None)], "vec_id int, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", rows[i].tolist()) for i in range(10)], "query string, vector array<double>")
    got = {(r["query"], r["rank"]): (r["doc"], r["score"]) for r in retrieval.dense(vectors, queries, 7, F.col("vec_id") != 3).collect()}
    for i in range(10):
        scores = np.round(rows @ rows[i], 6)
        best = sorted((n for n in range(300) if n != 3), key=lambda n: (-scores[n], n))[:7]
        assert [got[f"q{i}", k] for k in range(7)] == [(n, pytest.approx(scores[n])) for n in best]


def test_index_equals_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "sea sea ship"), (2, "ship"), (3, ""), (4, None)], "doc_id int, text string")
    asked_ = spark.createDataFrame([(1, "sea ship"), (2, "none")], "item_id int, text string")
    index = retrieval.index_of(docs)
    retrieval.save_index(index, str(tmp_path / "i"))
    loaded = retrieval.load_index(spark, str(tmp_path / "i"))
    rows = lambda x, **k: sorted(map(tuple, retrieval.bm25(x, asked_, 3, **k).collect()))
    assert rows(docs) == rows(index) == rows(loaded) and len(rows(docs)) == 2 and rows(docs, zeros=True) == rows(loaded, zeros=True)


def test_embeddings_are_unit(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert [round(sum(x * x for x in r["v"]), 9) for r in rows] == [1.0, 0.0, 0.0] and len(rows[0]["v"]) == 16


def test_results_are_kept(spark, tmp_path):
    planned = spark.createDataFrame([("m", "p", 0, "c0"), ("m", "p", 1, "c1")], "mode string, paper string, config_no int, config string")
    samples = spark.createDataFrame([("m", "p", "c0", 0.5, None), ("m", "p", "c0", None, "refused"), ("m", "p", "c1", None, "down")], "mode string, paper string, config string, faithfulness double, error string")
    found = evaluation.run_results(samples, planned, ["faithfulness"])
    evaluation.save_results(found, str(tmp_path / "r"))
    evaluation.save_results(found.filter("config = 'c0'").withColumn("status", F.lit("failed")), str(tmp_path / "r"))
    rows = {r["config"]: r for r in evaluation.load_results(spark, str(tmp_path / "r")).collect()}
    assert rows["c0"]["status"] == "completed" and rows["c0"]["average"] == {"faithfulness": 0.5} and rows["c0"]["n_samples"] == 1
    assert rows["c1"]["status"] == "failed" and rows["c1"]["error"] == "down"
    assert [r["config"] for r in evaluation.remaining(planned, evaluation.load_results(spark, str(tmp_path / "r")), ["mode", "paper", "config"]).collect()] == ["c1"]


def test_texts_that_nothing_found_are_not_shuffled(spark, chunks):
    """All chunks with their texts were dealt by id and sorted to meet a few hits, three times for an answer."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held, queries = pipelines.searchable(chunks), asked(spark, "tables and words")
        targets = spark.createDataFrame([(0, ["b", "a"])], "query int, targets array<string>")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc" not in plan(pipelines.reranked(pipelines.hybrid(held, queries), held.chunks, queries))
        assert all("hashpartitioning(doc" not in plan(f) and "Scan parquet" in plan(f) and "/chunks-" not in plan(f) for f in (pipelines.simple_qa(held, queries), pipelines.quiz(held, queries), pipelines.compare(held, queries, targets)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_batch_is_embedded_together():
    """Each row's words were sorted, counted and hashed by expressions; now each distinct word of a batch once."""
    import pyarrow as pa

    from folioloom.operators import providers

    rows = providers.bucket_counts(pa.array([["a", "b", "a"], [], None, ["é"] * 5], pa.list_(pa.string())), 16).to_pylist()
    at = lambda w: int(providers.hashlib.md5(w.encode()).hexdigest()[:6], 16) % 16
    assert at("a") != at("b") and rows[0][at("a")] == pytest.approx(2 / 5**0.5) and rows[0][at("b")] == pytest.approx(1 / 5**0.5)
    assert rows[1] == rows[2] == [0.0] * 16 and rows[3][at("é")] == 1.0 and providers.bucket_counts(pa.array([], pa.list_(pa.string())), 16).to_pylist() == []


def test_cited_works_are_found_once(spark, chunks):
    """Works were looked for anew for the catalogue, the new chunks and the listed citations."""
    works = spark.createDataFrame([("c", "reference", 1, "Attention", "id:1")], "doc string, kind string, no int, title string, key string")
    known = spark.createDataFrame([("id:1", "Attention", "https://arxiv.org/pdf/1", True, None)], "key string, title string, pdf_url string, fetched boolean, fetch_error string")
    taken = spark.createDataFrame([("https://arxiv.org/pdf/1", "application/pdf", "%PDF-1.4", "transformer heads " * 40)], "url string, content_type string, head string, text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    pipelines.citation_qa(chunks, spark.createDataFrame([(0, "heads", "c")], "query int, query_text string, document string"), works.withColumn("title", counted("title")), known, taken).collect()
    assert seen.value == 1

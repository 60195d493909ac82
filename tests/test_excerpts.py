"""Excerpts of papers need two searches, however many sections and labels there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import retrieval
from folioloom.plans import pipelines


def test_excerpts_search_twice(spark, monkeypatch):
    """One search for all sections, one for the papers for which a label found nothing; the latter asks for these only."""
    rows = [("a_0", "a", "method", 1, "alpha method algorithm", 0), ("b_0", "b", "references", 1, "beta reference author", 0), ("c_0", "c", "unknown", 1, "gamma", 0)]
    chunks = spark.createDataFrame(rows, "chunk string, document string, section string, page int, text string, chunk_level int")
    asked, search = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda index, queries, *a, **b: asked.append(queries.count()) or search(index, queries, *a, **b))
    found = pipelines.excerpts(chunks, chunks.select(F.col("document").alias("paper")))
    got = {(r["label"], r["paper"]): r["section"] for r in found.collect()}
    assert asked == [6, 4]
    assert got == {("main", "a"): "method", ("citation-only", "a"): "general", ("main", "b"): "general", ("citation-only", "b"): "references", ("main", "c"): "general", ("citation-only", "c"): "general"}


def test_excerpts_embed_the_papers_only(spark):
    """All chunks were embedded, though the dense lists are made inside the papers."""
    rows = [(f"{d}_0", d, "method", 1, f"{d} method algorithm", 0) for d in "abc"]
    chunks = spark.createDataFrame(rows, "chunk string, document string, section string, page int, text string, chunk_level int")
    held = pipelines.searchable_within(chunks, chunks.filter("document = 'b'").select("document"))
    assert [r["chunk"] for r in held.chunks.filter("embedding IS NOT NULL").collect()] == ["b_0"]
    assert held.index.documents.count() == 3

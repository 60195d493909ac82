"""Whole question pipelines over many questions: route, retrieve, rerank, compress, answer, cite."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.functions import prompts
from folioloom.functions import text as T
from folioloom.operators import chunking, citations, context, retrieval, routing, sections
from folioloom.operators.providers import Providers
from folioloom.operators.tables import materialized, small

SECTION_BOOST, DEFAULT_BOOST = 0.15, 0.1
#: Vectors that a broadcast may hold (64 numbers each: about 64 MB).
VECTOR_ROWS = 100_000
SUMMARY_SECTIONS = ("abstract", "introduction", "method", "result", "conclusion")
#: What a summary is searched and reranked by.
SUMMARY_SEARCH, SUMMARY_QUERY = "summarize the paper main contributions results", "논문 전체 요약: 목적, 방법론, 결과, 의의"


def expansion(queries: DataFrame, lang: str = "en", models: Providers = Providers()) -> DataFrame:
    """queries with translated (of a question that isn't ASCII), hyde_doc (a passage that would answer it, in the collection's
    language) and search_text, what the dense side looks for. Without a model that writes, the question itself."""
    query = F.col("query_text")
    if models.write is None:
        none = F.lit(None).cast("string")
        return queries.withColumns({"translated": none, "hyde_doc": none, "search_text": query})
    asked = F.when(~T.is_ascii(query), models.write(prompts.translation(query)))
    rows = queries.withColumn("translated", routing.translated(query, asked))
    about = query if lang == "ko" else F.coalesce("translated", "query_text")
    rows = rows.withColumn("hyde_doc", models.write(prompts.hypothetical(about, F.lit(lang))))
    return rows.withColumn("search_text", F.coalesce(F.nullif(F.trim("hyde_doc"), F.lit("")), "query_text"))


def searched(queries: DataFrame) -> Column:
    """What the dense side looks for: an expansion's text, else the question."""
    return F.coalesce("search_text", "query_text") if "search_text" in queries.columns else F.col("query_text")


class Searchable(NamedTuple):
    """Chunks (chunk, document, section, page, text, chunk_level, ...) with their embedding, and their index."""

    chunks: DataFrame
    index: retrieval.Index


def searchable(chunks: DataFrame | Searchable, models: Providers = Providers()) -> Searchable:
    """chunks embedded and indexed, once for all searches of a pipeline; what is searchable already stays."""
    if isinstance(chunks, Searchable):
        return chunks
    own = materialized(chunks.withColumn("embedding", models.embed(F.col("text"))), "chunks")
    return Searchable(own, retrieval.index_of(own, "chunk", "text"))


def searchable_within(chunks: DataFrame, documents: DataFrame, models: Providers = Providers()) -> Searchable:
    """For searches inside documents (column document) only: all chunks are indexed, but those of these documents alone are
    embedded and kept."""
    every = materialized(chunks, "chunks")
    own = every.join(small(materialized(documents.select("document").distinct(), "documents")), "document", "left_semi")
    own = materialized(own.withColumn("embedding", models.embed(F.col("text"))), "chunks-within")
    return Searchable(own, retrieval.index_of(every, "chunk", "text"))


def sparse(held: Searchable, queries: DataFrame, k: int) -> DataFrame:
    """query, doc, rank of the k best by BM25, written: several lists are cut from it."""
    return materialized(retrieval.bm25(held.index, queries, k, key="query", body="query_text").select("query", "doc", "rank"), "sparse")


def hybrid(chunks: DataFrame | Searchable, queries: DataFrame, k: int = 20, models: Providers = Providers(), dense_where: Column | None = None, sparse_where: Column | None = None, found: DataFrame | None = None) -> DataFrame:
    """query, doc (the chunk's id), rank of the fused lists. chunks: chunk, text, and what the filters read. The dense
    filter works inside the search, the sparse one on its finished list (found, if it is there), so filtered sparse lists may be
    short."""
    held = searchable(chunks, models)
    asked = queries.select("query", models.embed(models.rewrite(searched(queries))).alias("vector"))
    near = retrieval.dense(held.chunks, asked, k, dense_where, key="chunk")
    found = sparse(held, queries, k) if found is None else found
    if sparse_where is not None:
        found = held.chunks.filter(sparse_where).select(F.col("chunk").alias("doc")).join(small(found), "doc")  # ids of chunks are unique
    return materialized(retrieval.fuse(near, found, k), "hits")


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query and doc of hits with the chunks' columns. Hits are few and go to the chunks: texts that nothing found aren't shuffled.
    hits are cheap to count: a materialized table."""
    return chunks.withColumnRenamed("chunk", "doc").drop("embedding").join(small(hits.select("query", "doc")), "doc")


def reranked(hits: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, models: Providers = Providers(), boosted: Column | None = None, boost: float = DEFAULT_BOOST) -> DataFrame:
    """hits with the chunks' columns, rerank_score, rank and position."""
    rows = with_chunks(hits, chunks).join(queries.select("query", "query_text"), "query")
    rows = rows.withColumn("score", F.round(models.score(F.col("query_text"), F.col("text")), 6))
    return retrieval.rerank(rows, k, boosted, boost)


def hybrid_within(chunks: DataFrame | Searchable, queries: DataFrame, targets: DataFrame, k: int = 20, models: Providers = Providers(), where: Column | None = None, by: tuple[str, ...] = (), found: DataFrame | None = None) -> DataFrame:
    """hybrid() inside documents: query (a struct of query, document and the chunks' columns `by`), doc (the chunk's id), rank,
    for each target (query, document) and value of these columns, all in one search. Chunks meet targets by an equal document.
    Targets that have some of these columns meet chunks of equal values only. The dense list is made inside the document and the
    filter; the sparse one is the collection's, cut to them afterwards."""
    held = searchable(chunks, models)
    slot = F.struct("query", "document", *by).alias("query")
    own = held.chunks if where is None else held.chunks.filter(where)
    meet = ["document", *(c for c in by if c in targets.columns)]
    wanted = materialized(targets.select("query", *meet).distinct(), "wanted")
    asked = wanted.join(queries.select("query", models.embed(models.rewrite(searched(queries))).alias("vector")), "query")
    asked = materialized(asked, "wanted-vectors")
    pairs = own.select("chunk", "document", *by, "embedding").join(small(asked, VECTOR_ROWS), meet)
    pairs = pairs.select(slot, F.col("chunk").alias("doc"), F.round(T.cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
    near = retrieval.top(pairs, ["query"], k, "rank", F.col("score").desc(), F.col("doc"))
    found = sparse(held, queries, k) if found is None else found
    found = own.select(F.col("chunk").alias("doc"), "document", *by).join(small(found), "doc").join(small(wanted), ["query", *meet])
    return materialized(retrieval.fuse(near, found.select(slot, "doc", "rank"), k), "hits")


def answered(hits: DataFrame, models: Providers = Providers(), order: str = "position", limit: bool = True, prompt=prompts.answer) -> DataFrame:
    """query, query_text, context, sources, prompt, answer from reranked hits (with section and page). What is shown of them is
    written, as texts, lines and questions are made of it."""
    rows = context.compress(hits)
    if limit:
        rows = context.truncate(rows.drop("text", "truncated").withColumnRenamed("content", "text"), order=order)
    rows = materialized(rows.select("query", "query_text", "doc", "section", "page", order, "content"), "shown")
    lines = context.source_lines(rows, order=order)
    body = context.joined(rows.withColumn("c", F.col("content")), "query", order, "c")
    asked = rows.groupBy("query").agg(F.first("query_text").alias("query_text"))
    out = body.join(lines, "query").join(asked, "query").withColumn("prompt", prompt(F.col("query_text"), F.col("context")))
    return out.withColumn("answer", models.generate(F.col("query_text"), F.col("context"), F.col("prompt")))


def simple_qa(chunks: DataFrame, queries: DataFrame, models: Providers = Providers()) -> DataFrame:
    """Pipeline A; also what answers where no other fits."""
    queries = expansion(queries, models=models)
    held = searchable(chunks, models)
    hits = hybrid(held, queries, 20, models)
    return with_missing(answered(reranked(hits, held.chunks, queries, 5, models), models), queries, hits)


def with_missing(answers: DataFrame, queries: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Questions without a context get no answer, and the reason: nothing found, or (with the hits given) nothing left of it
    after compression."""
    out = queries.select("query").join(answers, "query", "left")
    reason = F.lit("no_search_results")
    if hits is not None:
        out = out.join(hits.select("query").distinct().withColumn("had_hits", F.lit(True)), "query", "left")
        reason = F.when(F.col("had_hits"), "no_context_after_compression").otherwise(reason)
    out = out.withColumn("error", F.when(F.col("context").isNull(), reason))
    return out.drop("had_hits")


def section_qa(chunks: DataFrame, queries: DataFrame, section: str, models: Providers = Providers()) -> DataFrame:
    """Pipeline B: hits of one section, with others where there are fewer than three; the section's hits get a boost."""
    held = searchable(chunks, models)
    found = sparse(held, queries, 20)
    inside = hybrid(held, queries, 20, models, F.col("section") == section, F.col("section") == section, found)
    both = materialized(retrieval.with_fallback(inside, hybrid(held, queries, 20, models, found=found), 3), "both-hits")
    return with_missing(answered(reranked(both, held.chunks, queries, 5, models, F.col("section") == section, SECTION_BOOST), models), queries, both)


def compare(chunks: DataFrame, queries: DataFrame, targets: DataFrame, models: Providers = Providers()) -> DataFrame:
    """Pipeline C: query, context_a, context_b, compared, sources, prompt, answer, error. Each of a query's two documents is
    searched, reranked and compressed by itself. targets: query, targets (array). Other than two documents is an error
    (insufficient_docs, too_many_docs), and so is a side without a context (no_doc_contexts, insufficient_contexts)."""
    sides = targets.filter(F.size("targets") == 2).select("query", F.posexplode("targets").alias("side", "document"))
    held = searchable(chunks, models)
    sides = materialized(sides, "sides")
    hits = hybrid_within(held, queries, sides, 20, models)
    asked = sides.join(queries.select("query", "query_text"), "query").select(F.struct("query", "document").alias("query"), "side", "query_text")
    rows = with_chunks(hits, held.chunks.drop("document")).join(asked, "query")
    best = retrieval.rerank(rows.withColumn("score", F.round(models.score(F.col("query_text"), F.col("text")), 6)), 5)
    pressed = materialized(context.compress(best).select("query", "doc", "section", "page", "side", "position", "content"), "shown")
    body = context.joined(pressed, "query", "position", "content", "\n\n")
    each = sides.join(body.select(F.col("query.query").alias("query"), F.col("query.document").alias("document"), "context"), ["query", "document"], "left")
    at = lambda n: F.max(F.when(F.col("side") == n, F.col("context")))
    both = each.groupBy("query").agg(at(0).alias("context_a"), at(1).alias("context_b"))
    listed = pressed.withColumn("place", F.struct("side", "position")).withColumn("query", F.col("query.query"))
    lines = context.source_lines(listed, order="place")
    out = targets.join(both, "query", "left").join(lines, "query", "left").join(queries.select("query", "query_text"), "query")
    held = F.col("context_a").isNotNull().cast("int") + F.col("context_b").isNotNull().cast("int")
    fault = (
        F.when(F.size("targets") < 2, "insufficient_docs").when(F.size("targets") > 2, "too_many_docs")
        .when(held == 0, "no_doc_contexts").when(held == 1, "insufficient_contexts")
    )
    prompt = prompts.comparison(F.col("query_text"), F.col("context_a"), F.col("context_b"))
    out = out.withColumn("error", fault).withColumn("prompt", F.when(F.col("error").isNull(), prompt))
    whole = F.concat_ws("\n\n", "context_a", "context_b")
    return out.withColumn("answer", F.when(F.col("error").isNull(), models.generate(F.col("query_text"), whole, F.col("prompt"))))


def cited(blocks: DataFrame, most: int = 5) -> DataFrame:
    """Pipeline D's first half: doc, kind, no, title, key (what a catalogue is asked by) of what a document cites, the first
    few. Papers and general documents cite references, patents patents; lectures nothing. blocks: with sections and
    doc_type; they are written, as each kind is looked for in them."""
    blocks = materialized(blocks.filter("doc_type <> 'lecture'").select("doc", "block_idx", "content", "section_type", "doc_type"), "cited-blocks")
    papers = blocks.filter(F.col("doc_type").isin("paper", "general"))
    refs = citations.references(sections.reference_text(papers))
    refs = refs.select("doc", F.lit("reference").alias("kind"), F.col("ref_id").cast("int").alias("no"), "title", citations.feed_query(F.col("arxiv_id"), F.col("title")).alias("key"))
    own = blocks.filter("doc_type = 'patent'")
    named = sections.section_text(own, "cited_patents").unionByName(
        sections.section_text(own, "background").join(sections.section_text(own, "cited_patents").select("doc"), "doc", "left_anti")
    )
    pats = citations.patents(named).select("doc", F.lit("patent").alias("kind"), F.col("patent_no").alias("no"), "title", F.col("patent_id").alias("key"))
    return citations.first_n(refs.unionByName(pats), most, "doc", "no")


def tracked(works: DataFrame, catalogue: DataFrame, downloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pipeline D's second half: what a catalogue says of the cited works, and the new chunks of those that could be taken.

    works: of cited(); catalogue: key, title, pdf_url, fetched, fetch_error from stored responses (feed_entries,
    patent_pages); downloads: url, content_type, head, text of files taken. Returns doc, no, kind, title, fetched, has_pdf,
    fetch_error; and chunks with the citing doc, for its collection's index.
    """
    works = materialized(works, "works")
    known = catalogue.select("key", F.col("title").alias("found_title"), "pdf_url", F.col("fetched").alias("was_fetched"), F.col("fetch_error").alias("own_error"))
    rows = works.join(known, "key", "left").withColumn("fetched", F.coalesce("was_fetched", F.lit(False)))
    absent = F.when(F.col("kind") == "reference", "arxiv_not_found").otherwise("patent_not_found")
    rows = rows.withColumn("fetch_error", F.when(~F.col("fetched"), F.coalesce("own_error", absent)))
    said = rows.select("doc", "no", "kind", F.coalesce(F.nullif("found_title", F.lit("")), "title").alias("title"), "fetched", F.col("pdf_url").isNotNull().alias("has_pdf"), "fetch_error")
    files = downloads.filter(citations.download_allowed(F.col("url"), F.col("content_type"), F.col("head")))
    texts = rows.filter("fetched").join(files, F.col("pdf_url") == F.col("url"))
    texts = texts.select(F.concat_ws("__", "doc", F.lit("cited"), F.col("no").cast("string")).alias("doc"), F.col("doc").alias("cited_by"), F.lit("unknown").alias("section"), F.lit(1).alias("page"), "text")
    return said, materialized(chunking.windows(texts), "cited-chunks")


def citation_qa(chunks: DataFrame, queries: DataFrame, works: DataFrame, catalogue: DataFrame, downloads: DataFrame, models: Providers = Providers()) -> DataFrame:
    """Pipeline D: questions over a collection's chunks and the newly taken ones, with the citations (array) and how many
    works were indexed. queries: query, query_text, document (the citing one)."""
    said, new = tracked(works, catalogue, downloads)
    added = new.select(F.concat_ws("_", "doc", F.col("char_start").cast("string")).alias("chunk"), F.col("doc").alias("document"), "section", "page", F.col("content").alias("text"), F.lit(0).alias("chunk_level"))
    every = chunks.unionByName(added, allowMissingColumns=True)
    out = simple_qa(every, queries.select("query", "query_text"), models)
    entry = F.struct("no", "kind", "title", "fetched", "has_pdf", "fetch_error")
    listed = said.groupBy("doc").agg(F.array_sort(F.collect_list(entry)).alias("citations"))
    indexed = new.groupBy("cited_by").agg(F.count_distinct("doc").alias("newly_indexed"))
    out = out.join(queries.select("query", "document"), "query").join(listed.withColumnRenamed("doc", "document"), "document", "left")
    out = out.join(indexed.withColumnRenamed("cited_by", "document"), "document", "left")
    return out.withColumn("newly_indexed", F.coalesce("newly_indexed", F.lit(0)))


def summary_hits(chunks: DataFrame | Searchable, queries: DataFrame, models: Providers = Providers(), targets: DataFrame | None = None, fallback: int = 10, k: int = 8) -> DataFrame:
    """Pipeline E's hits, reranked by what a summary asks for, in section order: upper levels of the target documents' summary
    trees (search_score 1 and a tenth for each level), then the three best of each of five sections, and where these are under
    five in all, others that aren't among them. A node of a tree that its section's search finds too is there twice. With
    targets (query, document) all searches stay inside the documents; chunks are embedded, indexed and searched once for
    all sections."""
    held = searchable(chunks, models)
    found = sparse(held, queries, 3)
    inside = F.col("section").isin(*SUMMARY_SECTIONS)
    if targets is None:
        hits = None
        for section in SUMMARY_SECTIONS:
            own = hybrid(held, queries, 3, models, F.col("section") == section, F.col("section") == section, found).select("query", "doc", "rrf_score")
            hits = own if hits is None else hits.unionByName(own)
    else:
        hits = hybrid_within(held, queries, targets, 3, models, inside, ("section",), found).select("query.query", "doc", "rrf_score")
    hits = hits.select("query", "doc", F.col("rrf_score").alias("search_score"), F.lit(1).alias("list_no"))
    if targets is not None:
        tree = held.chunks.filter("chunk_level >= 1").join(targets.select("query", "document").distinct(), "document")
        hits = hits.unionByName(tree.select("query", F.col("chunk").alias("doc"), (F.col("chunk_level") * 0.1 + 1.0).alias("search_score"), F.lit(0).alias("list_no")))
    general_queries = queries.select("query", F.lit(SUMMARY_SEARCH).alias("query_text"))
    if targets is None:
        general = hybrid(held, general_queries, fallback, models)
    else:
        general = hybrid_within(held, general_queries, targets, fallback, models).withColumn("query", F.col("query.query"))
    general = general.select("query", "doc", F.col("rrf_score").alias("search_score"), F.lit(2).alias("list_no"))
    both = materialized(retrieval.with_fallback(hits, general, 5).drop("fallback"), "summary-hits")
    rows = held.chunks.withColumnRenamed("chunk", "doc").drop("embedding").join(small(both), "doc").join(queries.select("query", "query_text"), "query")
    rows = rows.withColumn("score", F.round(models.score(F.lit(SUMMARY_QUERY), F.col("text")), 6))
    final = retrieval.rerank(rows, k)
    order = Window.partitionBy("query").orderBy(sections.section_rank(F.col("section")), "position")
    return final.withColumn("place", F.row_number().over(order))


def summary(chunks: DataFrame, queries: DataFrame, models: Providers = Providers(), targets: DataFrame | None = None) -> DataFrame:
    """Pipeline E."""
    hits = summary_hits(chunks, queries, models, targets)
    return with_missing(answered(hits, models, "place", prompt=prompts.summary), queries, hits)


#: What the sections of a paper are sampled by for new questions; references for questions on citations only.
SAMPLED = (
    ("main", "abstract", "초록 abstract 핵심 기여 contribution problem setting"), ("main", "method", "방법 method architecture algorithm training objective 구현"),
    ("main", "result", "결과 result metric 성능 수치 비교 ablation"), ("main", "related_work", "관련 연구 related work baseline comparison prior work"),
    ("citation-only", "related_work", "인용 cited work baseline author comparison related work"),
    ("citation-only", "references", "참고문헌 cited work author title baseline reference"),
)
GENERAL_SAMPLE = {
    "main": "{} 핵심 기여 main contribution method result 결과", "citation-only": "{} 인용 cited work author baseline reference 참고문헌",
}
PREVIEW = 900


def excerpts(chunks: DataFrame, papers: DataFrame, k: int = 5, models: Providers = Providers()) -> DataFrame:
    """label, paper, section, n, preview: what a prompt for new questions shows of each paper (column paper). Each section is
    searched by its own words inside the paper, all in one search; a preview counts once for each label, and papers for which a
    label found nothing are searched without a section. Only the papers' chunks are embedded."""
    spark = papers.sparkSession
    names = materialized(papers.select(F.col("paper").alias("document")).distinct(), "papers")
    held = searchable_within(chunks, names, models)
    asked = spark.createDataFrame([(no, *x) for no, x in enumerate(SAMPLED)], "query int, label string, section string, query_text string")
    hits = hybrid_within(held, asked, names.crossJoin(F.broadcast(asked.select("query", "section"))), k, models, by=("section",))
    hits = hits.select("query.*", "rank", "doc").join(F.broadcast(asked.select("query", "label")), "query")
    own = lambda rows: rows.select("label", F.col("document").alias("paper"), "section", F.col("query").alias("no"), "rank", "doc")
    found = materialized(own(hits), "excerpts")
    # papers for which a label found nothing
    general = [(no, label, words.replace("{}", "%s")) for no, (label, words) in enumerate(GENERAL_SAMPLE.items(), len(SAMPLED))]
    lacking = None
    for no, label, words in general:
        one = names.join(found.filter(F.col("label") == label).select(F.col("paper").alias("document")), "document", "left_anti")
        one = one.select(F.concat_ws(":", F.lit(no), "document").alias("query"), "document", F.lit(no).alias("no"), F.lit(label).alias("label"), F.format_string(words, "document").alias("query_text"))
        lacking = one if lacking is None else lacking.unionByName(one)
    lacking = materialized(lacking, "excerpts-lacking")
    hits = hybrid_within(held, lacking, lacking, k, models).select("query.*", "rank", "doc").join(lacking.select("query", "no", "label"), "query")
    found = found.unionByName(own(hits.withColumn("section", F.lit("general")).drop("query").withColumnRenamed("no", "query")))
    texts = held.chunks.select(F.col("chunk").alias("doc"), F.substring("text", 1, PREVIEW).alias("preview"))
    rows = found.join(texts, "doc").groupBy("label", "paper", "preview").agg(F.min(F.struct("no", "rank", "section")).alias("x"))
    return rows.select("label", "paper", "x.section", (F.col("x.rank") + 1).alias("n"), "preview", F.col("x.no").alias("no"))


def sampled_context(found: DataFrame) -> DataFrame:
    """paper and context of excerpts(), as a prompt shows them."""
    entry = F.format_string("[%s | %s | %s | %d]\n%s", "label", "paper", "section", "n", "preview")
    own = lambda label: F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("no", "n", entry.alias("entry")))))
    text = lambda rows: F.array_join(F.transform(rows, lambda x: x["entry"]), "\n\n")
    rows = found.groupBy("paper").agg(own("main").alias("main"), own("citation-only").alias("cited"))
    main = F.concat(F.lit("[Main excerpts: use for all non-citation query types]\n\n"), text(F.col("main")))
    cited_only = F.concat(F.lit("\n\n[Citation-only excerpts: use only for citation query types]\n\n"), text(F.col("cited")))
    return rows.select("paper", F.concat(main, F.when(F.size("cited") > 0, cited_only).otherwise("")).alias("context"))


def quiz(chunks: DataFrame, queries: DataFrame, models: Providers = Providers()) -> DataFrame:
    """Pipeline F: ten retrieved, seven kept, and whether a quiz or flash cards are wanted."""
    held = searchable(chunks, models)
    hits = hybrid(held, queries, 10, models)
    ask = lambda q, c: prompts.quiz(q, c, routing.quiz_mode(q))
    out = with_missing(answered(reranked(hits, held.chunks, queries, 7, models), models, prompt=ask), queries, hits)
    return out.withColumn("mode", routing.quiz_mode(F.coalesce("query_text", F.lit(""))))


def steps(names: list[str], counts: list[Column]) -> Column:
    """What a pipeline did: array of struct<step, attrs>."""
    return F.array(*(F.struct(F.lit(n).alias("step"), F.create_map(F.lit("n"), c.cast("string")).alias("attrs")) for n, c in zip(names, counts, strict=True)))


def judged(samples: DataFrame, models: Providers = Providers(), strict: bool = False) -> DataFrame:
    """samples (sample_id, query_text, answer, context, truth) with the four metrics; recall is null without a truth."""
    from folioloom.operators import evaluation as E

    ask = lambda a, b, labels: E.label_score(models.judge(F.col(a), F.col(b), labels), strict)
    recall = ask("truth", "context", ("COVERED", "PARTIAL", "MISSING"))
    return samples.select(
        "*", ask("answer", "context", ("SUPPORTED", "PARTIAL", "UNSUPPORTED")).alias("faithfulness"),
        ask("query_text", "answer", ("RELEVANT", "PARTIAL", "IRRELEVANT")).alias("answer_relevancy"),
        ask("query_text", "context", ("USEFUL", "PARTIAL", "NOISY")).alias("context_precision"),
        F.when(T.word_count(F.coalesce("truth", F.lit(""))) > 0, recall).alias("context_recall"), (F.coalesce("truth", F.lit("")) != "").alias("has_truth"),
    )

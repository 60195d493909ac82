"""Queries over the lexical index, dense search, fusion, reranking, compression and the pipelines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import ann, chunking, context, decoding, pruned, retrieval
from folioloom.operators.tables import shared_folder
from folioloom.plans import pipelines
from folioloom.plans.queries_text import _WINDOWS
from folioloom.plans.registry import query, table

# common table expressions that several oracles share
TF = r"""
tok AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
dl AS (SELECT doc_id AS doc, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS dl FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _bm25(queries: str, k: int = 20) -> str:
    """queries: a table expression with columns query, body."""
    return rf"""{TF},
q AS (SELECT query, term, count(*) AS qtf FROM (
  SELECT query, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')) AS term FROM {queries}) GROUP BY ALL),
scored AS (
  SELECT q.query, tf.doc, round(sum(qtf * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)
    * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avg_dl, 1.0::DOUBLE))))), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc), stats GROUP BY q.query, tf.doc),
bm AS (SELECT query, doc, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1)::INT AS rank
  FROM scored QUALIFY rank < {k})"""


_BENCH = "(SELECT item_id AS query, text AS body FROM benchmark)"
_ASKED = "(SELECT doc_id AS query, text AS body FROM documents WHERE doc_id % 20 = 0)"
_DENSE = """
qv AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT query, vec_id AS doc, label, round(list_sum(list_transform(list_zip(v, embedding::DOUBLE[]), lambda x: x[1] * x[2])), 6) AS score
  FROM qv, embeddings)"""


def _dense_top(name: str, where: str, k: int = 20) -> str:
    return f"""{name} AS (SELECT query, doc, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1)::INT AS rank
  FROM near WHERE {where} QUALIFY rank < {k})"""


def _fused(dense: str, sparse: str, k: int = 20) -> str:
    return f"""fused AS (
  SELECT query, doc, round(sum(part), 8) AS rrf_score, max(dr) AS dense_rank, max(sr) AS sparse_rank FROM (
    SELECT query, doc, 0.6::DOUBLE / (60 + rank + 1) AS part, rank AS dr, NULL::INT AS sr FROM {dense} UNION ALL
    SELECT query, doc, 0.4::DOUBLE / (60 + rank + 1), NULL, rank FROM {sparse}) GROUP BY query, doc),
rrf AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) - 1)::INT AS rank
  FROM fused QUALIFY rank < {k})"""


def benchmark_hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), k)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), F.col("text").alias("query_text"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query(f"WITH {_bm25(_BENCH)} SELECT query, doc, score, rank FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return benchmark_hits(spark, d)


@query(f"WITH {_bm25(_BENCH)} SELECT query, doc, score, rank FROM bm")
def bm25_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The rows of bm25_topk from fewer postings."""
    blocks = pruned.blocks_of(retrieval.index_of(table(spark, d, "documents")))
    return pruned.search(blocks, table(spark, d, "benchmark")).hits


@query(
    f"WITH {_bm25(_BENCH, 20)}, held AS (SELECT query, count(*) AS n FROM bm GROUP BY query), "
    "first AS (SELECT doc_id AS doc FROM documents ORDER BY doc_id LIMIT 40), "
    "fill AS (SELECT item_id AS query, doc, 0.0::DOUBLE AS score FROM benchmark, first WHERE coalesce((SELECT n FROM held WHERE held.query = item_id), 0) < 20 "
    "AND NOT EXISTS (SELECT 1 FROM bm WHERE bm.query = item_id AND bm.doc = first.doc)), "
    "every AS (SELECT query, doc, score FROM bm UNION ALL SELECT * FROM fill) "
    "SELECT query, doc, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1)::INT AS rank FROM every QUALIFY rank < 20"
)
def bm25_topk_with_zero_scores(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), 20, zeros=True)


@query(f"WITH {TF} SELECT n_docs, round(avg_dl, 6) AS avg_dl FROM stats")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.index_stats(table(spark, d, "documents")).select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query(f"WITH {TF} SELECT term, df FROM df")
def doc_freqs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.terms_of_documents(table(spark, d, "documents"))


@query(f"WITH {TF} SELECT doc, term, tf, dl::INT AS dl FROM tf JOIN dl USING (doc)")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(table(spark, d, "documents"))


@query(f"WITH {_DENSE}, {_dense_top('dt', 'true')} SELECT query, doc, score, rank FROM dt")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return retrieval.dense(v, q)


def _cells(spark: SparkSession, d: str) -> str:
    """An approximate index of the vectors that took deletions, and upserts of old and new vectors, on its way."""
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    v = table(spark, d, "embeddings")
    ann.build(v.filter("vec_id % 3 <> 0"), path)
    ann.remove(spark, path, v.filter("vec_id % 5 = 1").select(F.col("vec_id").alias("doc")))
    ann.upsert(v.filter("vec_id % 3 = 0 OR vec_id % 5 = 1 OR vec_id % 7 = 0"), path)
    return path


@query(f"WITH {_DENSE}, {_dense_top('dt', 'true')} SELECT query, doc, score, rank FROM dt")
def ann_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """A search through all cells of the index is the exact one."""
    return ann.search(spark, _cells(spark, d), _vectors(spark, d)[1], probes=ann.MOST_CELLS)


@query()
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Recall is measured against dense_topk in the tests."""
    return ann.search(spark, _cells(spark, d), _vectors(spark, d)[1])


@query(f"WITH {_DENSE}, {_dense_top('dt', 'label = 3 AND doc >= 100')} SELECT query, doc, score, rank FROM dt")
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return retrieval.dense(v, q, where=retrieval.all_of(F.col("label") == 3, None, F.col("vec_id") >= 100))


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v, q = _vectors(spark, d)
    sparse = retrieval.bm25(table(spark, d, "documents"), _asked(spark, d), 20, key="query", body="query_text")
    return retrieval.dense(v, q), sparse


@query(f"WITH {_DENSE}, {_dense_top('dt', 'true')}, {_bm25(_ASKED)}, {_fused('dt', 'bm')} SELECT query, doc, rrf_score, dense_rank, sparse_rank, rank FROM rrf")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(*_two_lists(spark, d))


@query(
    f"WITH {_DENSE}, {_dense_top('dt', 'label < 5')}, {_bm25(_ASKED)}, late AS (SELECT * FROM bm WHERE doc IN (SELECT doc_id FROM documents WHERE lang = 'en')), "
    f"{_fused('dt', 'late')} SELECT query, doc, rrf_score, dense_rank, sparse_rank, rank FROM rrf"
)
def rrf_postfilter(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    docs = table(spark, d, "documents")
    sparse = retrieval.bm25(docs, _asked(spark, d), 20, key="query", body="query_text")
    late = sparse.join(docs.filter("lang = 'en'").select(F.col("doc_id").alias("doc")), "doc", "left_semi")
    return retrieval.fuse(retrieval.dense(v, q, where=F.col("label") < 5), late)


@query(
    f"WITH {_bm25(_BENCH)}, inside AS (SELECT bm.* FROM bm JOIN documents ON doc_id = doc WHERE lang = 'fr'), held AS (SELECT query, count(*) AS n FROM inside GROUP BY query) "
    "SELECT query, doc, score, rank, 0 AS fallback FROM inside UNION ALL "
    "SELECT query, doc, score, rank, 1 FROM bm WHERE coalesce((SELECT n FROM held WHERE held.query = bm.query), 0) < 3 "
    "AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.query = bm.query AND i.doc = bm.doc)"
)
def section_fallback_union(spark: SparkSession, d: str) -> DataFrame:
    hits = benchmark_hits(spark, d)
    docs = table(spark, d, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("doc"))
    return retrieval.with_fallback(hits.join(docs, "doc", "left_semi"), hits, 3).select("query", "doc", "score", "rank", "fallback")


_LEX = r"""
pairs AS (SELECT query, doc, b.text AS qt, d.text, d.lang FROM bm JOIN benchmark b ON item_id = query JOIN documents d ON doc_id = doc),
lex AS (SELECT query, doc, lang, round(len(list_filter(own, lambda w: list_contains(asked, w))) / greatest(len(own), 1)::DOUBLE, 6) AS score FROM (
  SELECT query, doc, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS own,
    list_filter(regexp_split_to_array(lower(qt), '\s+'), lambda w: w <> '') AS asked FROM pairs))"""


def _zigzag(score: str, k: int) -> str:
    return f"""
ranked AS (SELECT query, doc, round({score}, 6) AS rerank_score, (row_number() OVER (PARTITION BY query ORDER BY round({score}, 6) DESC, doc) - 1)::INT AS rank
  FROM lex QUALIFY rank < {k}),
n AS (SELECT query, count(*) AS n FROM ranked GROUP BY query)
SELECT query, doc, rerank_score, rank, (CASE WHEN n <= 2 THEN rank WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - (rank - 1) // 2 END)::INT AS position
FROM ranked JOIN n USING (query)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "lang")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    return retrieval.lexical_scores(benchmark_hits(spark, d).select("query", "doc").join(docs, "doc").join(items, "query"))


@query(f"WITH {_bm25(_BENCH)}, {_LEX}, {_zigzag('score', 5)}")
def rerank_zigzag(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(_scored(spark, d)).select("query", "doc", "rerank_score", "rank", "position")


@query(f"WITH {_bm25(_BENCH)}, {_LEX}, " + _zigzag("score + CASE WHEN lang = 'fr' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END", 7))
def rerank_boost(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(_scored(spark, d), 7, F.col("lang") == "fr", 0.15).select("query", "doc", "rerank_score", "rank", "position")


_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_COMPRESS = rf"""
hits AS (SELECT query, doc, b.text AS qt, d.text, len({_WORDS.format('d.text')}) AS n, sum(len({_WORDS.format('d.text')})) OVER (PARTITION BY query) AS total
  FROM bm JOIN benchmark b ON item_id = query JOIN documents d ON doc_id = doc),
sents AS (SELECT query, doc, floor(n * 0.5::DOUBLE) AS goal, {_WORDS.format('lower(qt)')} AS asked,
  generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS s FROM (
  SELECT *, string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM hits WHERE total > 3072)),
own AS (SELECT query, doc, goal, pos, s, asked, len({_WORDS.format('s')}) AS words, list_distinct({_WORDS.format('lower(s)')}) AS w FROM sents),
scored_s AS (SELECT *, len(list_filter(w, lambda x: list_contains(asked, x))) / greatest(len(w), 1)::DOUBLE AS score FROM own),
kept AS (SELECT DISTINCT query, doc, s FROM (SELECT *, sum(words) OVER (PARTITION BY query, doc ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS upto FROM scored_s) WHERE upto <= goal),
shown AS (SELECT query, doc, string_agg(s, ' ' ORDER BY at_) AS shown FROM (
  SELECT query, doc, s, (SELECT min(pos) FROM own o WHERE o.query = k.query AND o.doc = k.doc AND o.s = k.s) AS at_ FROM kept k) GROUP BY query, doc),
pressed AS (SELECT query, doc, CASE WHEN total > 3072 THEN coalesce(shown, substr(text, 1, 500)) ELSE text END AS content, total > 3072 AS compressed
  FROM hits LEFT JOIN shown USING (query, doc))"""


def _for_context(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    return benchmark_hits(spark, d).join(docs, "doc").join(items, "query")


@query(f"WITH {_bm25(_BENCH)}, {_COMPRESS} SELECT query, doc, content, compressed FROM pressed")
def compress_extractive(spark: SparkSession, d: str) -> DataFrame:
    return context.compress(_for_context(spark, d)).select("query", "doc", "content", "compressed")


@query(rf"""WITH {_bm25(_BENCH)},
hits AS (SELECT query, doc, rank, d.text, {_WORDS.format('d.text')} AS w FROM bm JOIN documents d ON doc_id = doc),
run AS (SELECT *, sum(len(w)) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM hits)
SELECT query, doc, CASE WHEN upto <= 3072 THEN text ELSE array_to_string(w[1 : (3072 - (upto - len(w)))::INT], ' ') END AS content, upto > 3072 AS truncated
FROM run WHERE upto <= 3072 OR (upto - len(w) <= 3072 AND 3072 - (upto - len(w)) > 50)""")
def truncate_budget(spark: SparkSession, d: str) -> DataFrame:
    return context.truncate(_for_context(spark, d), order="rank").select("query", "doc", "content", "truncated")


@query(rf"""WITH {_bm25(_BENCH, 5)}
SELECT query, string_agg('[' || (rank + 1) || '] ' || doc || ' - ' || lang || ' (p.' || (doc % 7) || ')', chr(10) ORDER BY rank) AS sources,
  string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM bm JOIN documents ON doc_id = doc GROUP BY query""")
def context_and_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("lang").alias("section"), (F.col("doc_id") % 7).alias("page"))
    hits = benchmark_hits(spark, d, 5).join(docs, "doc")
    return context.source_lines(hits, order="rank").join(context.joined(hits, "query", "rank", "text"), "query")


# decoding: consecutive embeddings stand for scores with and without the context
_PAIRS = """
p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS c, b.embedding::DOUBLE[] AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
sm AS (SELECT vec_id, c, e, list_transform(c, lambda x: exp(x - list_max(c))) AS cx, list_transform(e, lambda x: exp(x - list_max(e))) AS ex FROM p),
pr AS (SELECT vec_id, c, e, list_transform(cx, lambda x: x / list_sum(cx)) AS cp, list_transform(ex, lambda x: x / list_sum(ex)) AS ep FROM sm)"""


def _score_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return v.select("vec_id", F.col("embedding").alias("c")).join(after, "vec_id")


@query(f"WITH {_PAIRS} SELECT vec_id, list_transform(list_zip(c, e), lambda x: round(x[1] - 0.5::DOUBLE * x[2], 6)) AS scores FROM p")
def cad_logits(spark: SparkSession, d: str) -> DataFrame:
    return _score_pairs(spark, d).select("vec_id", decoding.rounded(decoding.contrast(F.col("c"), F.col("e"))).alias("scores"))


@query(f"""WITH {_PAIRS}, kl AS (SELECT vec_id,
  0.5::DOUBLE * (list_sum(list_transform(list_zip(cp, ep), lambda x: x[1] * ln(x[1] / (0.5::DOUBLE * (x[1] + x[2]) + 1e-10::DOUBLE) + 1e-10::DOUBLE)))
  + list_sum(list_transform(list_zip(cp, ep), lambda x: x[2] * ln(x[2] / (0.5::DOUBLE * (x[1] + x[2]) + 1e-10::DOUBLE) + 1e-10::DOUBLE)))) AS jsd FROM pr)
SELECT vec_id, round(jsd, 8) AS jsd, round(least(greatest(jsd * 0.5 * 2, 0.1::DOUBLE), 0.5::DOUBLE), 6) AS alpha FROM kl""")
def adaptive_alpha(spark: SparkSession, d: str) -> DataFrame:
    jsd = decoding.divergence(decoding.softmax(F.col("c")), decoding.softmax(F.col("e")))
    return _score_pairs(spark, d).select("vec_id", F.round(jsd, 8).alias("jsd"), F.round(decoding.adaptive_alpha(F.col("c"), F.col("e")), 6).alias("alpha"))


#: A vocabulary of 64 tokens, one for each score.
_VOCABULARY = [f"{w}{'' if i < 14 else i}" for i, w in enumerate(("가", "ㄱ", "1", ".", "a", "A", "α", "한국", "BERT", "모델", "ok,", "2024", "(표)", "naïve") * 5)][:64]


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings)
SELECT vec_id, list_transform(list_zip(s, {_VOCABULARY!r}), lambda x:
  round(x[1] - CASE WHEN regexp_matches(x[2], '[^\\x{{AC00}}-\\x{{D7A3}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}} .,!?()0-9]') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 6)) AS scores FROM v""")
def scd_penalty(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.array(*(F.lit(t) for t in _VOCABULARY))
    return table(spark, d, "embeddings").select("vec_id", decoding.rounded(decoding.penalized(F.col("embedding"), tokens)).alias("scores"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS s FROM embeddings),
l AS (SELECT vec_id, s, no, label, unnest(toks) AS token FROM v, (VALUES (0, 'SUPPORTED', [3, 7]), (1, 'PARTIAL', [5]), (2, 'UNSUPPORTED', [11, 3, 7])) t(no, label, toks)),
p AS (SELECT vec_id, no, label, round(sum(s[token + 1] - list_max(s) - ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s)))))), 6) AS log_probability FROM l GROUP BY ALL)
SELECT vec_id AS prompt, label, log_probability, row_number() OVER (PARTITION BY vec_id ORDER BY log_probability DESC, no) = 1 AS chosen FROM p""")
def label_rank(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([(0, "SUPPORTED", [3, 7]), (1, "PARTIAL", [5]), (2, "UNSUPPORTED", [11, 3, 7])], "label_no int, label string, tokens array<int>")
    steps = table(spark, d, "embeddings").select(F.col("vec_id").alias("prompt"), F.col("embedding").alias("scores"))
    steps = steps.join(F.broadcast(labels.select("label_no", "label", F.explode("tokens").alias("token"))))
    return decoding.ranked_labels(steps)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document's windows as chunks to search, its language as section."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("section"), F.lit(1).alias("page"), "text")
    rows = chunking.windows(docs)
    chunk = F.concat_ws("_", F.col("doc").cast("string"), F.col("char_start").cast("string"))
    return rows.select(chunk.alias("chunk"), F.col("doc").cast("string").alias("document"), "section", "page", F.col("content").alias("text"), F.lit(0).alias("chunk_level"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))


_SENTENCES = r"string_split(regexp_replace({0}, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1))"
#: Chunks as a table ck (doc_id, the chunk's id; document, section, text), their embeddings and those of the questions, and the
#: cosine of every question and chunk.
_CHUNK_TABLES = rf"""{_WINDOWS},
ck AS (SELECT doc || '_' || char_start AS doc_id, doc::VARCHAR AS document, section, content AS text FROM ids),
texts AS (SELECT 'c' AS side, doc_id AS id, text FROM ck UNION ALL SELECT 'q', item_id::VARCHAR, text FROM benchmark),
buckets AS (SELECT side, id, ('0x' || substr(md5(w), 1, 6))::INT % 64 AS b, count(*) AS n FROM (
  SELECT side, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM texts) GROUP BY ALL),
units AS (SELECT side, id, b, n::DOUBLE / sqrt(sum(n * n) OVER (PARTITION BY side, id)::DOUBLE) AS x FROM buckets),
dots AS (SELECT q.id, c.id AS doc, sum(q.x * c.x) AS dot FROM units q JOIN units c ON q.side = 'q' AND c.side = 'c' AND q.b = c.b GROUP BY ALL),
near AS (SELECT item_id AS query, ck.doc_id AS doc, document, section, round(coalesce(dot, 0::DOUBLE), 6) AS score
  FROM benchmark JOIN ck ON true LEFT JOIN dots ON dots.id = item_id::VARCHAR AND dots.doc = ck.doc_id)"""


def _chunk_bm25(k: int) -> str:
    return _bm25(_BENCH, k).replace("FROM documents", "FROM ck")


def _reranked_sql(hits: str, k: int, boost: str = "0::DOUBLE") -> str:
    """hits: a table with query and doc; its best as a table best (query, doc, qt, text, section, rerank_score, rank, position)."""
    words = _WORDS.format
    return rf"""
pairs AS (SELECT query, doc, b.text AS qt, d.text, d.section FROM {hits} JOIN benchmark b ON item_id = query JOIN ck d ON doc_id = doc),
lex AS (SELECT query, doc, qt, text, section, round(len(list_filter(own, lambda w: list_contains(asked, w))) / greatest(len(own), 1)::DOUBLE, 6) + {boost} AS score FROM (
  SELECT *, list_distinct({words('lower(text)')}) AS own, {words('lower(qt)')} AS asked FROM pairs)),
ranked AS (SELECT *, round(score, 6) AS rerank_score, (row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) - 1)::INT AS rank FROM lex QUALIFY rank < {k}),
best AS (SELECT *, (CASE WHEN n <= 2 THEN rank WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - (rank - 1) // 2 END)::INT AS position
  FROM (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM ranked))"""


def _answer_sql(prompt: str, more: str = "") -> str:
    """From a table best to whole answers, with the reasons where there is none. prompt: an expression over qt and context."""
    pressed = _COMPRESS.replace("FROM bm JOIN benchmark b ON item_id = query JOIN documents d ON doc_id = doc", "FROM best JOIN benchmark b ON item_id = query JOIN ck d ON doc_id = doc")
    words = _WORDS.format
    return rf"""{pressed},
run AS (SELECT *, sum(len(w)) OVER (PARTITION BY query ORDER BY position) AS upto FROM (
  SELECT query, doc, qt, section, position, content, {words('content')} AS w FROM pressed JOIN best USING (query, doc))),
kept_t AS (SELECT *, CASE WHEN upto <= 3072 THEN content ELSE array_to_string(w[1 : (3072 - (upto - len(w)))::INT], ' ') END AS shown_t
  FROM run WHERE upto <= 3072 OR (upto - len(w) <= 3072 AND 3072 - (upto - len(w)) > 50)),
lined AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position) AS i FROM kept_t),
contexts AS (SELECT query, any_value(qt) AS qt, string_agg(shown_t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context,
  string_agg('[' || i || '] ' || doc || ' - ' || section || ' (p.1)', chr(10) ORDER BY i) AS sources FROM lined GROUP BY query),
said AS (SELECT query, generate_subscripts(x, 1) AS pos, unnest(x) AS s, asked FROM (
  SELECT query, {_SENTENCES.format('context')} AS x, {words('lower(qt)')} AS asked FROM contexts)),
first_two AS (SELECT query, string_agg(s, ' ' ORDER BY no) AS answer FROM (
  SELECT query, s, row_number() OVER (PARTITION BY query ORDER BY len(list_filter(own, lambda w: list_contains(asked, w))) / greatest(len(own), 1)::DOUBLE DESC, pos) AS no
  FROM (SELECT *, list_distinct({words('lower(s)')}) AS own FROM said) QUALIFY no <= 2) GROUP BY query)
SELECT item_id AS query, context, sources, qt AS query_text, {prompt} AS prompt, answer,
  CASE WHEN context IS NULL THEN CASE WHEN item_id IN (SELECT query FROM best) THEN 'no_context_after_compression' ELSE 'no_search_results' END END AS error{more}
FROM benchmark LEFT JOIN contexts ON item_id = query LEFT JOIN first_two USING (query)"""


_LF = "' || chr(10) || chr(10) || '"
_ANSWER_PROMPT = f"'Answer from the sources only; say so if they don''t hold the answer.{_LF}[Sources]' || chr(10) || context || '{_LF}[Question]' || chr(10) || qt || '{_LF}[Answer]'"
_QUIZ_PROMPT = f"'Write five questions with answers and explanations.{_LF}' || context || '{_LF}[Request]' || chr(10) || qt"
_SUMMARY_PROMPT = f"'Summarize by section: goal, method, result, conclusion.{_LF}' || context || '{_LF}[Request]' || chr(10) || qt"


@query(f"WITH {_CHUNK_TABLES}, {_dense_top('dt', 'true')}, {_chunk_bm25(20)}, {_fused('dt', 'bm')}, {_reranked_sql('rrf', 5)}, {_answer_sql(_ANSWER_PROMPT)}")
def rag_answer_a(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.simple_qa(_chunks(spark, d), _items(spark, d))


_INSIDE = _fused("dt", "late").replace("fused AS", "fused_in AS").replace("rrf AS", "inside AS").replace("FROM fused\n", "FROM fused_in\n").replace("FROM fused ", "FROM fused_in ")


@query(
    f"WITH {_CHUNK_TABLES}, {_dense_top('dt', chr(34) + 'section' + chr(34) + ' = ' + chr(39) + 'fr' + chr(39))}, {_dense_top('dg', 'true')}, {_chunk_bm25(20)}, "
    f"late AS (SELECT bm.* FROM bm JOIN ck ON doc_id = doc WHERE section = 'fr'), {_INSIDE}, {_fused('dg', 'bm')}, "
    "held AS (SELECT query, count(*) AS n FROM inside GROUP BY query), "
    "both_lists AS (SELECT query, doc FROM inside UNION ALL SELECT query, doc FROM rrf WHERE coalesce((SELECT n FROM held WHERE held.query = rrf.query), 0) < 3 "
    "AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.query = rrf.query AND i.doc = rrf.doc)), "
    + _reranked_sql("both_lists", 5, "CASE WHEN section = 'fr' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END") + ", " + _answer_sql(_ANSWER_PROMPT)
)
def rag_answer_b(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.section_qa(_chunks(spark, d), _items(spark, d), "fr")


def _within_sql(name: str, by: str, k: int, near: str, bm: str) -> str:
    """Lists inside the targets' documents, for each query and `by`, fused: a table name (query, doc, by, n)."""
    own = f", {by}" if by else ""
    return f"""
{name}_d AS (SELECT n.query, n.doc{', n.' + by if by else ''}, row_number() OVER (PARTITION BY n.query{', n.' + by if by else ''} ORDER BY n.score DESC, n.doc) - 1 AS rank
  FROM {near} n JOIN targets t ON t.query = n.query AND t.document = n.document QUALIFY rank < {k}),
{name}_s AS (SELECT b.query, b.doc{', ck.' + by if by else ''}, b.rank FROM {bm} b JOIN ck ON ck.doc_id = b.doc JOIN targets t ON t.query = b.query AND t.document = ck.document),
{name}_f AS (SELECT query, doc{own}, round(sum(part), 8) AS rrf, max(dr) AS dr, max(sr) AS sr FROM (
  SELECT query, doc{own}, 0.6::DOUBLE / (61 + rank) AS part, rank AS dr, NULL AS sr FROM {name}_d UNION ALL SELECT query, doc{own}, 0.4::DOUBLE / (61 + rank), NULL, rank FROM {name}_s) GROUP BY ALL),
{name} AS (SELECT query, doc{own} FROM {name}_f QUALIFY row_number() OVER (PARTITION BY query{own} ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST) <= {k})"""


_COMPARE_SQL = rf"""WITH {_CHUNK_TABLES},
targets AS (WITH {_bm25(_BENCH, 2)} SELECT query, doc::VARCHAR AS document, rank AS side FROM bm),
bm20 AS (WITH {_chunk_bm25(20)} SELECT query, doc, rank FROM bm),
{_within_sql('inside', 'document', 20, 'near', 'bm20')},
lex AS (SELECT i.query, i.doc, i.document, d.text, d.section, b.text AS qt, round(len(list_filter(list_distinct({_WORDS.format('lower(d.text)')}), lambda w: list_contains({_WORDS.format('lower(b.text)')}, w)))
  / greatest(len(list_distinct({_WORDS.format('lower(d.text)')})), 1)::DOUBLE, 6) AS score FROM inside i JOIN ck d ON d.doc_id = i.doc JOIN benchmark b ON b.item_id = i.query),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, document ORDER BY score DESC, doc) - 1 AS rank FROM lex QUALIFY rank < 5),
placed AS (SELECT *, CASE WHEN n <= 2 THEN rank WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - (rank - 1) // 2 END AS position
  FROM (SELECT ranked.*, side, count(*) OVER (PARTITION BY ranked.query, ranked.document) AS n FROM ranked JOIN targets t ON t.query = ranked.query AND t.document = ranked.document)),
lined AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY side, position) AS i FROM placed),
sides AS (SELECT query, string_agg(text, chr(10) || chr(10) ORDER BY position) FILTER (side = 0) AS context_a, string_agg(text, chr(10) || chr(10) ORDER BY position) FILTER (side = 1) AS context_b,
  string_agg('[' || i || '] ' || doc || ' - ' || section || ' (p.1)', chr(10) ORDER BY i) AS sources FROM lined GROUP BY query),
asked AS (SELECT query, list(document ORDER BY side) AS targets FROM targets GROUP BY query),
whole AS (SELECT a.query, a.targets, context_a, context_b, sources, b.text AS query_text, CASE WHEN len(a.targets) < 2 THEN 'insufficient_docs'
  WHEN context_a IS NULL AND context_b IS NULL THEN 'no_doc_contexts' WHEN context_a IS NULL OR context_b IS NULL THEN 'insufficient_contexts' END AS error
  FROM asked a JOIN benchmark b ON b.item_id = a.query LEFT JOIN sides s ON s.query = a.query),
said AS (SELECT query, generate_subscripts(x, 1) AS pos, unnest(x) AS s, asked FROM (
  SELECT query, {_SENTENCES.format("concat_ws(chr(10) || chr(10), context_a, context_b)")} AS x, {_WORDS.format('lower(query_text)')} AS asked FROM whole WHERE error IS NULL)),
first_two AS (SELECT query, string_agg(s, ' ' ORDER BY no) AS answer FROM (
  SELECT query, s, row_number() OVER (PARTITION BY query ORDER BY len(list_filter(own, lambda w: list_contains(asked, w))) / greatest(len(own), 1)::DOUBLE DESC, pos) AS no
  FROM (SELECT *, list_distinct({_WORDS.format('lower(s)')}) AS own FROM said) QUALIFY no <= 2) GROUP BY query)
SELECT whole.*, CASE WHEN error IS NULL THEN 'Compare the two documents on the question.{_LF}[A]' || chr(10) || context_a || '{_LF}[B]' || chr(10) || context_b || '{_LF}[Question]' || chr(10) || query_text END AS prompt, answer
FROM whole LEFT JOIN first_two USING (query)"""


@query(_COMPARE_SQL)
def rag_answer_c(spark: SparkSession, d: str) -> DataFrame:
    best = benchmark_hits(spark, d, 2).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"].cast("string")).alias("targets"))
    return pipelines.compare(_chunks(spark, d), _items(spark, d), best)


_SEARCH_TEXT = f"'{pipelines.SUMMARY_SEARCH}'"
_SUMMARY_SQL = rf"""WITH {_CHUNK_TABLES.replace("section, content AS text FROM ids", "CASE section WHEN 'en' THEN 'method' WHEN 'fr' THEN 'result' WHEN 'de' THEN 'abstract' ELSE 'conclusion' END AS section, content AS text FROM ids")},
targets AS (WITH {_bm25(_BENCH, 1)} SELECT query, doc::VARCHAR AS document FROM bm),
bm3 AS (WITH {_chunk_bm25(3)} SELECT query, doc, rank FROM bm),
bm10 AS (WITH {_bm25(f'(SELECT item_id AS query, {_SEARCH_TEXT} AS body FROM benchmark)', 10).replace('FROM documents', 'FROM ck')} SELECT query, doc, rank FROM bm),
{_within_sql('inside', 'section', 3, 'near', 'bm3')},
gu AS (SELECT b, n::DOUBLE / sqrt(sum(n * n) OVER ()::DOUBLE) AS x FROM (SELECT ('0x' || substr(md5(w), 1, 6))::INT % 64 AS b, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all({_SEARCH_TEXT}, '[\p{{L}}\p{{N}}_]+')) AS w) GROUP BY b)),
gd AS (SELECT id AS doc, sum(gu.x * u.x) AS dot FROM units u JOIN gu ON gu.b = u.b WHERE side = 'c' GROUP BY id),
gn AS (SELECT item_id AS query, ck.doc_id AS doc, document, round(coalesce(dot, 0::DOUBLE), 6) AS score FROM benchmark JOIN ck ON true LEFT JOIN gd ON gd.doc = ck.doc_id),
{_within_sql('general', '', 10, 'gn', 'bm10')},
held AS (SELECT query, count(*) AS n FROM inside GROUP BY query),
both_lists AS (SELECT query, doc FROM inside UNION ALL SELECT query, doc FROM general WHERE coalesce((SELECT n FROM held WHERE held.query = general.query), 0) < 5
  AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.query = general.query AND i.doc = general.doc)),
{_reranked_sql('both_lists', 8).replace(_WORDS.format('lower(qt)'), _WORDS.format(f"lower('{pipelines.SUMMARY_QUERY}')")).replace('best AS', 'best_8 AS')},
best AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query ORDER BY CASE section WHEN 'abstract' THEN 0 WHEN 'method' THEN 2 WHEN 'result' THEN 3 WHEN 'conclusion' THEN 4 ELSE 99 END, position) AS position) FROM best_8),
""" + _answer_sql(_SUMMARY_PROMPT)


@query(_SUMMARY_SQL)
def rag_answer_e(spark: SparkSession, d: str) -> DataFrame:
    """Each passage asks for a summary of the document that it fits best; languages stand for sections."""
    named = F.when(F.col("section") == "en", "method").when(F.col("section") == "fr", "result").when(F.col("section") == "de", "abstract").otherwise("conclusion")
    best = benchmark_hits(spark, d, 1).select("query", F.col("doc").cast("string").alias("document"))
    return pipelines.summary(_chunks(spark, d).withColumn("section", named), _items(spark, d), targets=best)


@query(f"WITH {_CHUNK_TABLES}, {_dense_top('dt', 'true', 10)}, {_chunk_bm25(10)}, {_fused('dt', 'bm', 10)}, {_reranked_sql('rrf', 7)}, " + _answer_sql(_QUIZ_PROMPT, ", 'quiz' AS mode"))
def rag_answer_f(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.quiz(_chunks(spark, d), _items(spark, d))


@query(f"WITH {_CHUNK_TABLES}, {_dense_top('dt', 'true')}, {_chunk_bm25(20)}, {_fused('dt', 'bm')}, {_reranked_sql('rrf', 5)} SELECT query, doc, rerank_score, rank, position, substr(text, 1, 500) AS content FROM best")
def search_api(spark: SparkSession, d: str) -> DataFrame:
    held, items = pipelines.searchable(_chunks(spark, d)), _items(spark, d)
    hits = pipelines.reranked(pipelines.hybrid(held, items), held.chunks, items)
    return hits.select("query", "doc", "rerank_score", "rank", "position", F.substring("text", 1, 500).alias("content"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 6))::INT % 64) AS b, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT doc_id, list(n ORDER BY b) AS n, list(b ORDER BY b) AS b, sqrt(sum(n * n)::DOUBLE) AS norm FROM b GROUP BY doc_id)
SELECT d.doc_id, list_transform(range(0, 64), lambda i: round(coalesce(n[list_position(b, i)], 0)::DOUBLE / greatest(coalesce(norm, 0), 1e-12), 6)) AS embedding
FROM documents d LEFT JOIN c USING (doc_id)""")
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    from folioloom.operators.providers import hashed_embedding

    v = hashed_embedding(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.transform(v, lambda x: F.round(x, 6)).alias("embedding"))

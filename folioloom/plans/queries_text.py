"""Queries over text functions, chunks, blocks, sections, routes, citations and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import patterns as P
from folioloom.functions import text as T
from folioloom.operators import chunking, citations, routing, sections
from folioloom.plans import fixtures as X
from folioloom.plans import pipelines
from folioloom.plans.fixtures import Rows
from folioloom.plans.registry import query, table
from folioloom.sources import files

W = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@query(rf"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^가-힣]', '', 'g')) / greatest(length(text), 1) >= 0.15 THEN 'ko' ELSE 'en' END AS lang_detected,
  len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))::INT AS n_tokens, len({W.format('text')})::INT AS n_words,
  len(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)))::INT AS n_sentences,
  round(length(regexp_replace(text, '[^{T.MATH_CHARS}]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS math_density,
  regexp_matches(text, '^[\x00-\x7F]*$') AS ascii FROM documents""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.detect_lang(t).alias("lang_detected"), F.size(T.tokens(t)).alias("n_tokens"), T.word_count(t).alias("n_words"),
        F.size(T.sentences(t)).alias("n_sentences"), F.round(T.math_density(t), 6).alias("math_density"), T.is_ascii(t).alias("ascii"),
    )


_WINDOWS = rf"""
w AS (SELECT doc_id AS doc, lang AS section, text, {W.format('text')} AS w FROM documents),
s AS (SELECT *, unnest(range(0, ((greatest(len(w) - 512, 0) + 447) // 448) * 448 + 1, 448))::INT AS char_start FROM w),
c AS (SELECT doc, section, char_start, CASE WHEN len(w) <= 512 THEN 0 ELSE least(char_start + 512, len(w)) END::INT AS char_end,
  CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(w[char_start + 1 : char_start + 512], ' ') END AS content,
  (least(char_start + 512, len(w)) - char_start)::INT AS words FROM s WHERE least(char_start + 512, len(w)) - char_start >= 50),
ids AS (SELECT *, substr(md5(doc || ':' || section || ':' || char_start || ':' || substr(content, 1, 50)), 1, 12) AS chunk_id FROM c)"""


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("section"), "text")
    return chunking.windows(docs)


@query(f"WITH {_WINDOWS} SELECT doc, section, char_start, char_end, words, content, chunk_id FROM ids")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return document_chunks(spark, d).select("doc", "section", "char_start", "char_end", "words", "content", "chunk_id")


@query(f"""WITH {_WINDOWS}, twice AS (SELECT doc, chunk_id, char_start, k FROM ids, (VALUES (0), (1)) t(k))
SELECT doc, char_start, k, doc || '_' || chunk_id || CASE WHEN row_number() OVER (PARTITION BY doc, chunk_id ORDER BY char_start * 2 + k) = 1 THEN ''
  ELSE '_' || row_number() OVER (PARTITION BY doc, chunk_id ORDER BY char_start * 2 + k) END AS stored_id FROM twice""")
def unique_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    twice = document_chunks(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("char_start") * 2 + F.col("k"))
    return chunking.unique_ids(twice, "at").select("doc", "char_start", "k", "stored_id")


@query(rf"""WITH RECURSIVE x AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents),
s AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS s FROM x), n AS (SELECT *, len({W.format('s')}) AS n FROM s),
r AS (SELECT doc_id, i, 0 AS g, n FROM n WHERE i = 1 UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN r.n + n.n > 512 THEN g + 1 ELSE g END, CASE WHEN r.n + n.n > 512 THEN n.n ELSE r.n + n.n END FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1),
c AS (SELECT doc_id, g, sum(n.n) AS words, string_agg(s, ' ' ORDER BY i) AS content FROM r JOIN n USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS group_no, content FROM c WHERE words >= 50""")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    groups = chunking.sentence_groups(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(groups).alias("group_no", "content"))


_LINES = r"""
l AS (SELECT doc_id AS doc, generate_subscripts(x, 1) - 1 AS line_no, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS content
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
b AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY line_no) - 1)::INT AS block_idx, content FROM l WHERE content <> ''),
f AS (SELECT *, CASE WHEN content LIKE '# %' THEN 18.0 WHEN content LIKE '## %' THEN 14.0 WHEN content LIKE '### %' THEN 12.0 ELSE 10.0 END::DOUBLE AS font_size FROM b)"""


@query(f"WITH {_LINES} SELECT doc, block_idx, content, (block_idx // 51 + 1)::INT AS page, font_size, font_size > 10 AS is_bold FROM f")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return files.line_blocks(table(spark, d, "documents")).select("doc", "block_idx", "content", "page", "font_size", "is_bold")


_MARKDOWN = Rows("md", "doc string, page int, text string", [
    ("m1", 0, "# Title\nfirst line here\n```py\nx = 1\n\ny = 2\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n- item one\n* item two\n3. item three\nno\n## Part"),
    ("m1", 1, "| lone |\ntext after it\n```\nopen fence"), ("m2", 0, ""),
])
_MARKDOWN = _MARKDOWN.over("documents", "b.doc_id", doc="CAST(b.doc_id AS STRING)", page="x.page", text="x.text || chr(10) || b.text")


@query()
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return files.markdown_blocks(_MARKDOWN.df(spark, d))


_PAGES = r"""
h AS (SELECT page_id, trim(regexp_replace(unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)), '<[^>]*>', '', 'g')) AS heading FROM pages)"""


@query(f"WITH {_PAGES} SELECT page_id, heading, length(heading)::INT AS n FROM h")
def page_headings(spark: SparkSession, d: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<h1[^>]*>(.*?)</h1>"), F.lit(1)))
    rows = table(spark, d, "pages").select("page_id", found.alias("h"))
    return rows.select("page_id", F.trim(F.regexp_replace("h", "<[^>]*>", "")).alias("heading")).withColumn("n", F.length("heading"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return sections.with_sections(X.BLOCKS.df(spark, d))


@query(f"WITH {X.BLOCKS.cte}, s AS (SELECT doc, string_agg(content, ' ' ORDER BY block_idx) AS t FROM blocks WHERE block_type IN ('text', 'heading') AND block_idx < 30 GROUP BY doc), "
       "n AS (SELECT doc, " + ", ".join(f"len(regexp_extract_all(t, '{p}'))::INT AS {k}" for k, p in P.SIGNALS.items()) + " FROM s) "
       "SELECT *, CASE WHEN patent >= 2 THEN 'patent' WHEN paper > 0 AND lecture <= paper THEN 'paper' WHEN greatest(lecture, paper, general) = 0 THEN 'paper' "
       "WHEN lecture = greatest(lecture, paper, general) THEN 'lecture' WHEN paper = greatest(lecture, paper, general) THEN 'paper' ELSE 'general' END AS doc_type FROM n")  # fmt: skip
def doc_type_detect(spark: SparkSession, d: str) -> DataFrame:
    return sections.document_types(X.BLOCKS.df(spark, d))


def _match(x: str) -> str:
    """match_text: spaces between Hangul letters go in two passes, as SQL's patterns have no look-around."""
    for _ in range(2):
        x = f"regexp_replace({x}, '([가-힣])\\s+([가-힣])', '\\1\\2', 'g')" if "trim(" in x else f"regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '([가-힣])\\s+([가-힣])', '\\1\\2', 'g')"
    return x


def _plain(x: str) -> str:
    return f"trim(regexp_replace({x}, '{T.NUMBERING}', ''))"


def _sections_sql(blocks: str) -> str:
    """CTEs that lead from a table blocks to sectioned (with doc_type, body_font, detected, section_type)."""
    counts = ", ".join(f"len(regexp_extract_all(t, '{p}'))::INT AS {k}" for k, p in P.SIGNALS.items())
    by_type = ""
    for kind, table_ in P.BY_TYPE.items():
        tests = " ".join("WHEN " + " OR ".join(f"regexp_matches({c}, '{p}')" for p in shapes for c in ("c1", "c2", "c3", "c4")) + f" THEN '{section}'" for section, shapes in table_.items())
        by_type += f" WHEN '{kind}' THEN CASE {tests} END"
    author = "^[A-Z][A-Za-z''`\\-]+,\\s+[A-Z]\\."
    return f"""{blocks},
first30 AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY doc ORDER BY block_idx) <= 30),
joined AS (SELECT doc, coalesce(string_agg(content, ' ' ORDER BY block_idx) FILTER (block_type IN ('text', 'heading')), '') AS t FROM first30 GROUP BY doc),
counted AS (SELECT doc, {counts} FROM (SELECT doc, {_match('t')} AS t FROM joined)),
kinds AS (SELECT doc, CASE WHEN patent >= 2 THEN 'patent' WHEN paper > 0 AND lecture <= paper THEN 'paper' WHEN greatest(lecture, paper, general) = 0 THEN 'paper'
  WHEN lecture = greatest(lecture, paper, general) THEN 'lecture' WHEN paper = greatest(lecture, paper, general) THEN 'paper' ELSE 'general' END AS doc_type FROM counted),
sizes AS (SELECT doc, round(font_size, 1) AS size, count(*) AS n, min(block_idx) AS first FROM blocks WHERE block_type IN ('text', 'heading') AND font_size > 0 GROUP BY ALL),
fonts AS (SELECT doc, arg_max(size, (n, -first)) AS body_font FROM sizes GROUP BY doc),
spelled AS (SELECT b.*, doc_type, coalesce(body_font, 10.0) AS body_font, trim(content) AS c1, {_match('trim(content)')} AS c2 FROM blocks b JOIN kinds USING (doc) LEFT JOIN fonts USING (doc)),
heads AS (SELECT *, {_plain('c1')} AS c3, {_plain('c2')} AS c4 FROM spelled),
found AS (SELECT *, CASE WHEN block_type IN ('text', 'heading') AND (block_type = 'heading' OR length(c1) <= 80 OR (length(c1) < 100 AND (font_size >= body_font * 1.2 OR is_bold)))
  THEN CASE doc_type{by_type} END END AS detected, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS line FROM heads),
entries AS (SELECT *, regexp_matches(line, '^\\s*(\\[\\d+\\]|\\d+\\.)\\s+') AS numbered, trim(regexp_replace(line, '^\\s*(\\[\\d+\\]|\\d+\\.)\\s+', '')) AS rest FROM found),
filled AS (SELECT *, coalesce(last_value(detected IGNORE NULLS) OVER (PARTITION BY doc ORDER BY block_idx ROWS UNBOUNDED PRECEDING), 'unknown') AS own_section,
  (block_type IN ('text', 'heading') AND CASE WHEN numbered THEN regexp_matches(rest, '{author}') OR regexp_matches(rest, '(?i)\\bet al\\.') OR regexp_matches(rest, '(?i)\\bdoi\\b|arxiv|retrieval|generation|language model')
    ELSE regexp_matches(line, '{author}') END)::INT AS entry FROM entries),
near AS (SELECT *, sum(entry) OVER (PARTITION BY doc ORDER BY block_idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS near, max(page) OVER (PARTITION BY doc) + 1 AS pages,
  bool_or(own_section = 'references') OVER (PARTITION BY doc) AS has_references FROM filled),
begun AS (SELECT *, min(CASE WHEN doc_type = 'paper' AND NOT has_references AND block_type IN ('text', 'heading') AND entry = 1 AND near >= 3
  AND page >= greatest(floor(pages * 0.65), pages - 5) THEN block_idx END) OVER (PARTITION BY doc) AS begins FROM near),
paged AS (SELECT *, max(CASE WHEN block_idx = begins THEN page END) OVER (PARTITION BY doc) AS begin_page FROM begun),
ended AS (SELECT *, min(CASE WHEN block_type IN ('text', 'heading') AND block_idx > begins AND page > begin_page AND (regexp_matches(c1, '(?i)(저\\s*자\\s*소\\s*개|author\\s*bio(?:graphy)?)')
  OR coalesce(detected <> 'references', false) OR (font_size >= body_font * 1.5 AND length(c1) >= 20)) THEN block_idx END) OVER (PARTITION BY doc) AS ends FROM paged),
sectioned AS (SELECT *, CASE WHEN block_idx >= begins AND (ends IS NULL OR block_idx < ends) THEN 'references' ELSE own_section END AS section_type FROM ended)"""


_DETECT = _sections_sql(f"WITH {X.BLOCKS.cte}")


@query(f"{_DETECT} SELECT doc, block_idx, doc_type, body_font::DOUBLE AS body_font, detected, section_type FROM sectioned")
def section_detect(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc", "block_idx", "doc_type", "body_font", "detected", "section_type")


#: Lines of all documents, every tenth of them a heading that a paper, a lecture, a patent or a report may have.
_HEADINGS = ["1. Introduction", "2 Related Work", "3. 방 법 론", "Evaluation", "참 고 문 헌", "Definition 3", "Proof", "Background Art", "Claims", "Chapter 2", "부록", "Executive Summary", "[7] Smith, J. et al. A study."]
_LINE_BLOCKS = f"WITH {_LINES}, k AS (SELECT *, (doc * 7 + block_idx) % 10 = 3 AS head, {X.literal(_HEADINGS)} AS names FROM f), " + """
blocks AS (SELECT doc, block_idx, CASE WHEN head THEN names[((doc + block_idx) % 13 + 1)::INT] ELSE content END AS content, (block_idx // 51 + 1)::INT AS page,
  CASE WHEN head THEN 12.5::DOUBLE ELSE font_size END AS font_size, font_size > 10 AS is_bold, 'text' AS block_type FROM k)"""
_DETECT_LINES = _sections_sql(_LINE_BLOCKS)


def _line_sections(spark: SparkSession, d: str) -> DataFrame:
    head = (F.col("doc") * 7 + F.col("block_idx")) % 10 == 3
    name = F.element_at(F.array(*map(F.lit, _HEADINGS)), ((F.col("doc") + F.col("block_idx")) % 13 + 1).cast("int"))
    blocks = files.line_blocks(table(spark, d, "documents"))
    blocks = blocks.withColumns({"content": F.when(head, name).otherwise(F.col("content")), "font_size": F.when(head, 12.5).otherwise(F.col("font_size"))})
    return sections.with_sections(blocks)


@query(f"{_DETECT_LINES} SELECT doc, block_idx, doc_type, body_font::DOUBLE AS body_font, detected, section_type FROM sectioned")
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    return _line_sections(spark, d).select("doc", "block_idx", "doc_type", "body_font", "detected", "section_type")


@query(f"{_DETECT_LINES} SELECT doc, section_type, count(*) AS n_blocks FROM sectioned GROUP BY ALL")
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return sections.section_counts(_line_sections(spark, d))


_CHUNKS = rf"""{_DETECT}, body AS (SELECT *, block_type IN ('code', 'table', 'math') AS structured FROM sectioned WHERE block_type <> 'image'),
cuts AS (SELECT *, lag(section_type) OVER o AS before_section, lag(structured) OVER o AS before_structured FROM body WINDOW o AS (PARTITION BY doc ORDER BY block_idx)),
islands AS (SELECT *, sum((before_section IS NULL OR before_section <> section_type OR before_structured OR structured)::INT) OVER (PARTITION BY doc ORDER BY block_idx) AS run FROM cuts),
runs AS (SELECT doc, run, string_agg(content, chr(10) ORDER BY block_idx) AS text, arg_min(page, block_idx) AS page, any_value(section_type) AS section, bool_or(structured) AS structured, arg_min(block_type, block_idx) AS kind FROM islands GROUP BY doc, run),
marked AS (SELECT *, coalesce(lead(kind) OVER o = 'math' AND lead(section) OVER o = section, false) AND NOT structured AS before_math FROM runs WINDOW o AS (PARTITION BY doc ORDER BY run)),
chunks AS (SELECT doc, run::BIGINT AS run, section, page::INT AS page, 0 AS char_start, 0 AS char_end, text || CASE WHEN before_math THEN ' [수식 참조]' ELSE '' END AS content,
  substr(md5(doc || ':' || section || ':0:' || substr(text, 1, 50)), 1, 12) AS chunk_id, structured FROM marked WHERE structured OR len({W.format('text')}) >= 3)"""


@query(rf"""{_CHUNKS} SELECT *, CASE WHEN length(regexp_replace(content, '[^가-힣]', '', 'g')) / greatest(length(content), 1) >= 0.15 THEN 'ko' ELSE 'en' END AS lang FROM chunks""")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.by_section(_blocks(spark, d), least=3)
    return rows.select("doc", "run", "section", "page", "char_start", "char_end", "content", "chunk_id", "lang", "structured")


@query(rf"""{_CHUNKS}, mids AS (SELECT doc, section, substr(string_agg(content, chr(10) || chr(10) ORDER BY run, content), 1, 3000) AS t FROM chunks GROUP BY ALL HAVING count(*) > 1),
tops AS (SELECT doc, substr(string_agg(content, chr(10) || chr(10) ORDER BY run, content), 1, 4000) AS t FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY doc ORDER BY run) <= 20) GROUP BY doc)
SELECT doc, section, content, 0 AS chunk_level FROM chunks UNION ALL SELECT doc, section, array_to_string(({W.format('t')})[1:60], ' '), 1 FROM mids
UNION ALL SELECT doc, 'full', array_to_string(({W.format('t')})[1:60], ' '), 2 FROM tops""")
def summary_tree(spark: SparkSession, d: str) -> DataFrame:
    return chunking.summary_tree(chunking.by_section(_blocks(spark, d), least=3))


@query(f"""WITH {X.BLOCKS.cte}, n AS (SELECT doc, round(font_size, 1) AS size, count(*) AS n, min(block_idx) AS first FROM blocks
  WHERE block_type IN ('text', 'heading') AND font_size > 0 GROUP BY ALL)
SELECT doc, arg_max(size, n * 1000 - first) AS body_font FROM n GROUP BY doc""")
def body_fonts(spark: SparkSession, d: str) -> DataFrame:
    return sections.body_fonts(X.BLOCKS.df(spark, d))


@query(f"""WITH {X.BLOCKS.cte} SELECT doc, substr(arg_max(content, font_size * 1000 - block_idx), 1, 200) AS title FROM blocks
WHERE page = 0 AND block_type IN ('text', 'heading') GROUP BY doc""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    return sections.title(X.BLOCKS.df(spark, d))


def _route_sql() -> str:
    hits = [f"({' + '.join(f'contains(q, {X.literal(k)})::INT' for k in words)})" for words in P.ROUTES.values()]
    names = list(P.ROUTES)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    key = "CASE " + " ".join(f"WHEN s{i} = best THEN '{n}'" for i, n in enumerate(names)) + " END"
    route = "CASE " + " ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in P.LETTER.items()) + " ELSE 'B' END"
    section = "CASE " + " ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in P.SECTION_OF.items()) + " END"
    return f"""WITH {X.QUESTIONS.cte}, l AS (SELECT query_id, trim(lower(query)) AS q FROM questions),
s AS (SELECT query_id, {', '.join(f'{h} AS s{i}' for i, h in enumerate(hits))} FROM l), b AS (SELECT *, {best} AS best FROM s), k AS (SELECT *, {key} AS k FROM b)
SELECT query_id, CASE WHEN best = 0 THEN 'A' ELSE {route} END AS route, CASE WHEN best > 0 THEN {section} END AS section,
  CASE WHEN best > 0 THEN k END AS keyword, round(CASE WHEN best = 0 THEN 0.5 ELSE least(best / 3.0, 1.0) END::DOUBLE, 6) AS confidence FROM k"""


@query(_route_sql())
def route_queries(spark: SparkSession, d: str) -> DataFrame:
    r = X.QUESTIONS.df(spark, d).select("query_id", routing.route(F.col("query")).alias("r"))
    return r.select("query_id", "r.route", "r.section", "r.keyword", F.round("r.confidence", 6).alias("confidence"))


@query(f"SELECT route, count(*) AS n FROM ({_route_sql()}) GROUP BY route")
def route_distribution(spark: SparkSession, d: str) -> DataFrame:
    return route_queries(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


_ASK = Rows("asked", "query_id int, collection string, query string", [
    (1, "a", "doc_one vs doc two?"), (2, "a", "Compare them"), (3, "b", "compare z_9 and z 8 with z_7"), (4, "b", "only Z_9"),
])
_ASK = _ASK.over(
    "benchmark", "b.item_id", query_id="CAST(b.item_id AS INT)", collection="'src' || CAST(b.item_id % 20 AS STRING)",
    query="CASE WHEN b.item_id % 3 = 0 THEN 'compare doc_' || CAST(b.item_id AS STRING) || ' vs doc ' || CAST(b.item_id + 20 AS STRING) || '?' ELSE x.query END",
)
_HELD = Rows("held", "collection string, doc_no int, doc string", [("a", 0, "doc_one"), ("a", 1, "doc_two"), ("a", 2, "doc_three"), ("b", 0, "z_7"), ("b", 1, "z_8"), ("b", 2, "z_9")])
_HELD = _HELD.over("documents", "b.doc_id", collection="b.source", doc_no="CAST(b.doc_id AS INT)", doc="'doc_' || CAST(b.doc_id AS STRING)")


@query(f"""WITH {_ASK.cte}, {_HELD.cte}, p AS (SELECT query_id, doc_no, doc, contains(lower(query), lower(doc)) OR contains(lower(query), replace(lower(doc), '_', ' ')) AS named
  FROM asked JOIN held USING (collection))
SELECT query_id, CASE WHEN count(*) FILTER (named) < 2 THEN list(doc ORDER BY doc_no)[1:2] ELSE list(doc ORDER BY doc_no) FILTER (named) END AS targets FROM p GROUP BY query_id""")
def compare_targets(spark: SparkSession, d: str) -> DataFrame:
    return routing.compare_targets(_ASK.df(spark, d), _HELD.df(spark, d))


_REFS = Rows("refs", "doc string, text string", [
    ("r1", '[1] Vaswani, A. et al. (2017). "Attention Is All You Need." NeurIPS 2017. arXiv:1706.03762\n[2] Devlin, J. Bidirectional encoders. NAACL, 2019.\n3. Short\n4) Lewis P, Perez E. Retrieval augmented generation. 2020'),
    ("r2", ""),
])
_REFS = _REFS.over("documents", "b.doc_id", doc="CAST(b.doc_id AS STRING)", text="x.text || chr(10) || '[5] ' || replace(substr(b.text, 1, 200), chr(10), ' ')")


_REFS_SQL = r"""WITH """ + _REFS.cte + r""", e AS (SELECT doc, generate_subscripts(x, 1) AS pos, trim(unnest(x)) AS entry FROM (
  SELECT doc, string_split(regexp_replace(trim(text), '\n\s*(\[\d+\]|\d+[.)])', chr(1) || '\1', 'g'), chr(1)) AS x FROM refs)),
n AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos)::VARCHAR AS ref_id, trim(regexp_replace(entry, '^\[?\d+[\].)]?\s*', '')) AS b FROM e WHERE length(entry) >= 10),
t AS (SELECT *, regexp_extract(b, '["“](.+?)["”]', 1) AS q, string_split(b, '.') AS parts, nullif(regexp_extract(b, '^(.+?)[.,]', 1), '') AS a FROM n),
p AS (SELECT doc, ref_id, CASE WHEN q <> '' THEN trim(q) WHEN len(parts) > 1 THEN trim(parts[2]) ELSE substr(b, 1, 160) END AS title,
  CASE WHEN a IS NULL THEN []::VARCHAR[] ELSE [trim(a)] END AS authors, nullif(regexp_extract(regexp_extract(b, '\((\d{4})\)|,\s*(\d{4})'), '\d{4}'), '') AS year,
  nullif(regexp_extract(b, '(?i)arXiv[:\s]*(\d{4}\.\d{4,5})', 1), '') AS arxiv_id FROM t)"""


@query(f"{_REFS_SQL} SELECT * FROM p")
def parse_references(spark: SparkSession, d: str) -> DataFrame:
    return citations.references(_REFS.df(spark, d))


@query(f"{_REFS_SQL} SELECT doc, ref_id, title, array_to_string(authors[1:3], ', ') AS authors, year, arxiv_id IS NOT NULL AS has_pdf FROM p")
def reference_summary(spark: SparkSession, d: str) -> DataFrame:
    return citations.reference_summary(citations.references(_REFS.df(spark, d)))


_PATENTS = Rows("pats", "doc string, text string", [
    ("p1", 'See KR 10-2020-0012345 "Lens array" and US 10,000,000 Optical system. Also US10000000 again; JP 2019-123456, EP 3123456 and WO 2020/123456.'), ("p2", "none here"),
])
_PATENTS = _PATENTS.over("documents", "b.doc_id", doc="CAST(b.doc_id AS STRING)", text="x.text || ' ' || b.text")


@query(rf"""WITH {_PATENTS.cte}, m AS (SELECT doc, text, string_split(regexp_replace(text, '((?:{T.COUNTRIES})[\s\-]?[\d\-,\.]+(?:[A-Z]\d?)?)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS x FROM pats),
i AS (SELECT doc, text, x, unnest(range(2, len(x) + 1)) AS i FROM m),
e AS (SELECT doc, text, i, split_part(x[i], chr(2), 1) AS found, list_sum(list_transform(x[1:i - 1], lambda y: length(replace(y, chr(2), ''))))::INT AS start FROM i),
n AS (SELECT *, substr(found, 1, 2) || regexp_replace(regexp_replace(substr(found, 3), '^[\s\-]', ''), '[, ]', '', 'g') AS patent_id FROM e),
f AS (SELECT *, substr(text, greatest(0, start - 5) + 1, start + length(found) + 200 - greatest(0, start - 5)) AS context FROM n QUALIFY row_number() OVER (PARTITION BY doc, patent_id ORDER BY i) = 1),
r AS (SELECT *, CASE WHEN contains(context, patent_id) THEN trim(substr(context, instr(context, patent_id) + length(patent_id))) ELSE context END AS rest FROM f),
q AS (SELECT *, regexp_extract(rest, '["''](.+?)["'']', 1) AS quoted, trim(split_part(rest, '.', 1)) AS phrase FROM r)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY i))::INT AS patent_no, patent_id, substr(CASE WHEN quoted <> '' THEN trim(quoted) WHEN phrase <> '' THEN phrase ELSE patent_id END, 1, 200) AS title FROM q""")
def parse_patents(spark: SparkSession, d: str) -> DataFrame:
    return citations.patents(_PATENTS.df(spark, d))


_KEYWORDS = r"""
k AS (SELECT doc_id AS doc, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS keyword FROM (SELECT doc_id, regexp_extract_all(text, '[가-힣]{2,}|[a-zA-Z]{3,}') AS x FROM documents)),
n AS (SELECT doc, keyword, count(*) AS n, min(pos) AS first FROM k WHERE lower(keyword) NOT IN (""" + ", ".join(map(X.literal, P.STOPWORDS)) + """) GROUP BY ALL)"""


@query(f"WITH {_KEYWORDS} SELECT doc, keyword, n, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first)::INT AS rank FROM n QUALIFY rank <= 10")
def keywords_topk(spark: SparkSession, d: str) -> DataFrame:
    return citations.keywords(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


_FEED = Rows("feed", "key string, xml string", [
    ("x", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1706.03762v7</id><title> Attention </title><summary> Text. </summary>'
     '<link title="pdf" href="https://arxiv.org/pdf/1706.03762"/><author><name>A. V.</name></author><author><name>N. S.</name></author></entry></feed>'),
    ("y", '<feed xmlns="http://www.w3.org/2005/Atom"></feed>'),
])
_FEED = _FEED.over("pages", "b.page_id", key="x.key || CAST(b.page_id AS STRING)", xml="replace(x.xml, ' Attention ', ' Page ' || CAST(b.page_id AS STRING) || ' ')")


@query(rf"""WITH {_FEED.cte}, e AS (SELECT key, regexp_extract(xml, '(?s)<entry>(.*)</entry>', 1) AS x FROM feed)
SELECT key, CASE WHEN x <> '' THEN trim(regexp_extract(x, '<title>(.*?)</title>', 1)) END AS title, CASE WHEN x <> '' THEN trim(regexp_extract(x, '<summary>(.*?)</summary>', 1)) END AS abstract,
  nullif(regexp_extract(x, '<link title="pdf" href="([^"]*)"', 1), '') AS pdf_url, nullif(regexp_extract(regexp_extract(x, '<id>(.*?)</id>', 1), '\d{{4}}\.\d{{4,5}}'), '') AS arxiv_id,
  CASE WHEN x <> '' THEN regexp_extract_all(x, '<name>(.*?)</name>', 1) END AS authors, x <> '' AS fetched, CASE WHEN x = '' THEN 'arxiv_not_found' END AS fetch_error FROM e""")
def catalogue_entries(spark: SparkSession, d: str) -> DataFrame:
    return citations.feed_entries(_FEED.df(spark, d))


_URLS = Rows("urls", "url string, content_type string, head string", [
    ("https://arxiv.org/pdf/1706.03762", "application/pdf", "%PDF-1.5"), ("ftp://arxiv.org/a.pdf", "application/pdf", "%PDF-1.5"),
    ("https://evil.example/a.pdf", "application/pdf", "%PDF-1.5"), ("http://export.arxiv.org/a", "text/html", "%PDF-1.5"), ("https://kipris.or.kr/a", "application/pdf", "<html>"), ("no url", None, None),
])
_URLS = _URLS.over(
    "pages", "b.page_id", url="CASE WHEN x.url = 'no url' THEN b.url ELSE x.url || '?p=' || CAST(b.page_id AS STRING) END", content_type="x.content_type",
    head="x.head",
)


@query(f"""WITH {_URLS.cte} SELECT url, coalesce(regexp_matches(lower(url), '^https?://({'|'.join(citations.HOSTS).replace('.', '[.]')})(/|$)')
  AND contains(lower(content_type), 'pdf') AND head[1:5] = '%PDF-', false) AS allowed FROM urls""")
def download_guard(spark: SparkSession, d: str) -> DataFrame:
    ok = citations.download_allowed(F.col("url"), F.col("content_type"), F.col("head"))
    return _URLS.df(spark, d).select("url", F.coalesce(ok, F.lit(False)).alias("allowed"))


@query()
def cited_works(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.cited(_blocks(spark, d))


_NAMES = Rows("names", "name string", [("my papers",), ("3d-models",), ("한글 name",), ("x" * 70,), ("A_b-1",)])
_NAMES = _NAMES.over("customer", "b.c_custkey", name="x.name || b.c_name")


@query(f"""WITH {_NAMES.cte}, s AS (SELECT name, regexp_replace(name, '[^a-zA-Z0-9_-]', '_', 'g') AS safe FROM names)
SELECT name, substr(CASE WHEN regexp_matches(safe, '^[a-zA-Z]') THEN safe ELSE 'col_' || safe END, 1, 63) AS collection,
  substr(regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 80) || '__' || substr(sha1(name), 1, 10) AS file_name FROM s""")
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return _NAMES.df(spark, d).select("name", T.collection_name(n).alias("collection"), T.index_file_name(n).alias("file_name"))


_ANSWERS = Rows("answers", "doc string, text string", [
    ("a1", "intro line\n## One\n- a **bold** point\n2. second\n\n**2. Two** rest\nplain *it* text"), ("a2", "no headings here"),
])
_ANSWERS = _ANSWERS.over("documents", "b.doc_id", doc="CAST(b.doc_id AS STRING)", text="x.text || chr(10) || b.text")


_ANSWER_SQL = rf"""WITH {_ANSWERS.cte}, l AS (SELECT doc, generate_subscripts(x, 1) AS n, trim(unnest(x)) AS line FROM (SELECT doc, string_split(text, chr(10)) AS x FROM answers)),
h AS (SELECT *, coalesce(nullif(regexp_extract(line, '^#{{1,3}}\s+(.+)', 1), ''), nullif(regexp_extract(line, '^\*\*\d+\.\s*(.+?)\*\*', 1), '')) AS head FROM l),
r AS (SELECT *, sum((head IS NOT NULL)::INT) OVER (PARTITION BY doc ORDER BY n) AS run FROM h),
g AS (SELECT doc, run, coalesce(regexp_replace(max(head), '^[*# ]+|[*# ]+$', '', 'g'), '') AS title,
  coalesce(string_agg(regexp_replace(line, '\*{{1,2}}(.+?)\*{{1,2}}', '\1', 'g'), chr(10) ORDER BY n) FILTER (head IS NULL), '') AS body FROM r WHERE head IS NOT NULL OR line <> '' GROUP BY doc, run),
a AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY run))::INT AS section_no, title, body FROM g)"""


@query(f"{_ANSWER_SQL} SELECT * FROM a")
def answer_sections(spark: SparkSession, d: str) -> DataFrame:
    return files.answer_sections(_ANSWERS.df(spark, d))


@query(rf"""{_ANSWER_SQL}, b AS (SELECT doc, section_no, CASE WHEN title = '' THEN 'Summary' ELSE title END AS title, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line
  FROM (SELECT *, string_split(body, chr(10)) AS x FROM a))
SELECT doc, section_no, title, line_no::INT AS line_no, regexp_replace(regexp_replace(line, '^[-*]\s+', ''), '^\d+\.\s+', '') AS text,
  regexp_matches(line, '^[-*]\s') OR regexp_matches(line, '^\d+\.\s') AS is_bullet FROM b WHERE trim(line) <> ''""")
def answer_slides(spark: SparkSession, d: str) -> DataFrame:
    return files.slide_rows(files.answer_sections(_ANSWERS.df(spark, d)))


_CARDS = Rows("cards", "doc string, text string", [
    ("c1", 'Here: [FLASHCARD_START][{"front":"Q1","back":"A1"},{"front":"Q2","back":"A2"}][FLASHCARD_END]'), ("c2", 'x [{"front":"Q","back":"B"}] y'), ("c3", "none"), ("c4", "[1, 2"),
])
_CARDS = _CARDS.over("conversations", X.TURN, doc=f"CAST({X.TURN} AS STRING)", text=f"replace(x.text, '\"Q', '\"Q' || CAST({X.TURN} AS STRING))")


@query(rf"""WITH {_CARDS.cte}, m AS (SELECT doc, trim(CASE WHEN contains(text, '[FLASHCARD_START]') AND contains(text, '[FLASHCARD_END]')
  THEN regexp_extract(text, '(?s)\[FLASHCARD_START\](.*?)\[FLASHCARD_END\]', 1) ELSE regexp_extract(text, '(?s)(\[.*\])', 1) END) AS j FROM cards),
l AS (SELECT doc, regexp_extract_all(j, '\{{"front":"([^"]*)","back":"[^"]*"\}}', 1) AS f, regexp_extract_all(j, '\{{"front":"[^"]*","back":"([^"]*)"\}}', 1) AS b FROM m)
SELECT doc, (generate_subscripts(f, 1) - 1)::INT AS card_no, unnest(f) AS front, unnest(b) AS back FROM l WHERE coalesce(f[1], '') <> ''""")
def flashcard_parse(spark: SparkSession, d: str) -> DataFrame:
    return files.flashcards(_CARDS.df(spark, d))


@query(r"""SELECT event_id, regexp_extract(regexp_replace(trim('```json' || chr(10) || props || chr(10) || '```'), '^```(?:json)?\s*|\s*```$', '', 'g'), '(?s)(\{.*\}|\[.*\])', 1) AS json FROM events""")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", T.json_block(fenced).alias("json"))


_UPLOADS = Rows("uploads", "name string, doc_type string, size bigint, head string", [
    ("a.pdf", "paper", 10, "%PDF-1.4"), ("a.exe", "paper", 10, "MZ"), ("b.txt", "poem", 10, "hi"), ("c.txt", "lecture", 60000000, "hi"), ("d.pdf", "patent", 10, "hello"), ("e.TXT", "paper", 10, "text"),
])
_UPLOADS = _UPLOADS.over(
    "documents", "b.doc_id", name="'d' || CAST(b.doc_id AS STRING) || '_' || x.name", doc_type="x.doc_type", size="x.size + b.doc_id",
    head="CASE WHEN x.head = 'hi' THEN substr(b.text, 1, 16) ELSE x.head END",
)


@query(rf"""WITH {_UPLOADS.cte}, x AS (SELECT *, lower(regexp_extract(name, '(\.[^.]*)$', 1)) AS e,
  CASE WHEN starts_with(head, '%PDF-') THEN 'pdf' WHEN starts_with(head, 'PK' || chr(3) || chr(4)) THEN 'zip' WHEN NOT contains(head, chr(0)) THEN 'text' ELSE 'other' END AS k FROM uploads)
SELECT name, CASE WHEN e NOT IN ('.pdf', '.docx', '.txt') THEN 'extension' WHEN doc_type NOT IN ('paper', 'lecture', 'patent') THEN 'doc_type' WHEN size > 50 * 1024 * 1024 THEN 'size'
  WHEN NOT ((e = '.pdf' AND k = 'pdf') OR (e = '.docx' AND k = 'zip') OR (e = '.txt' AND k = 'text')) THEN 'signature' END AS fault FROM x""")
def upload_check(spark: SparkSession, d: str) -> DataFrame:
    fault = files.upload_fault(F.col("name"), F.col("doc_type"), F.col("size"), F.encode("head", "UTF-8"))
    return _UPLOADS.df(spark, d).select("name", fault.alias("fault"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text || ' sk-' || repeat('a', 24) || ' eyJa.b.c', 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[REDACTED_JWT]', 'g'),
  'sk-[A-Za-z0-9_-]{20,}', '[REDACTED_OPENAI_KEY]', 'g') AS text FROM conversations""")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    with_secrets = F.concat("text", F.lit(" sk-" + "a" * 24 + " eyJa.b.c"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.redacted(with_secrets).alias("text"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(text, chr(173), ''), '-\s*\n\s*', '', 'g')), '\s+', ' ', 'g')) AS span FROM documents""")
def normalized_spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalized_span(F.col("text")).alias("span"))

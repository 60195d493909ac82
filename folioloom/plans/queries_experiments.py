"""Queries over experiment preparation, collections, requests and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import prompts
from folioloom.functions import text as T
from folioloom.operators import experiments as E
from folioloom.operators import routing
from folioloom.plans.fixtures import TURN, TURN_ID, Rows
from folioloom.plans.registry import query, table

_SETS = Rows("qs", "query_id int, applicable_papers array<string>", [(1, [" p1", "p2", "p1"]), (2, ["paper_A_nlp", ""]), (3, ["p2 + p1", "p3"]), (4, [])])
_SETS = _SETS.over("conversations", TURN, query_id=TURN_ID, applicable_papers=(
    "transform(x.applicable_papers, p -> replace(p, 'p1', 'src' || CAST(b.conv_id % 7 AS STRING)))", "list_transform(x.applicable_papers, lambda p: replace(p, 'p1', 'src' || CAST(b.conv_id % 7 AS STRING)))",
))
_PAPERS = Rows("ps", "paper string", [("p1",), ("p2",), ("p3",), ("p4",)])
_PAPERS = _PAPERS.over("documents", "b.doc_id", distinct=True, paper="CASE WHEN b.doc_id % 5 = 0 THEN x.paper ELSE b.source END")
_EACH = f"WITH {_SETS.cte}, {_PAPERS.cte}, e AS (SELECT DISTINCT query_id, trim(unnest(applicable_papers)) AS paper FROM qs), a AS (SELECT query_id, paper FROM e JOIN ps USING (paper))"


@query(f"{_EACH} SELECT query_id::INT AS query_id, paper FROM a")
def applicable_queries(spark: SparkSession, d: str) -> DataFrame:
    return E.applicable(_SETS.df(spark, d), _PAPERS.df(spark, d)).select("query_id", "paper")


@query(f"{_EACH} SELECT paper FROM ps WHERE paper NOT IN (SELECT paper FROM a)")
def papers_without_queries(spark: SparkSession, d: str) -> DataFrame:
    return E.papers_without_queries(_SETS.df(spark, d), _PAPERS.df(spark, d))


@query(f"WITH {_SETS.cte}, e AS (SELECT query_id, unnest(applicable_papers) AS paper FROM qs) SELECT DISTINCT query_id::INT AS query_id, unnest(regexp_extract_all(paper, '{E.PLACEHOLDER}')) AS placeholder FROM e")
def placeholder_papers(spark: SparkSession, d: str) -> DataFrame:
    return E.placeholder_ids(_SETS.df(spark, d))


@query(f"""WITH {_SETS.cte}, t AS (SELECT query_id, list_transform(applicable_papers, lambda p: trim(p)) AS p FROM qs),
k AS (SELECT query_id, list_filter(p, lambda x: x <> '' AND NOT regexp_matches(x, '[+()]') AND NOT regexp_matches(x, '{E.PLACEHOLDER}')) AS p FROM t)
SELECT query_id::INT AS query_id, list_filter(p, lambda x, i: list_position(p, x) = i)::VARCHAR[] AS papers FROM k""")
def target_papers(spark: SparkSession, d: str) -> DataFrame:
    return _SETS.df(spark, d).select("query_id", E.target_papers(F.col("applicable_papers")).alias("papers"))


_QUERIES = Rows("qq", "position int, query string, type string, answer_span string", [
    (0, "What section covers it?", "crosslingual_en", "long enough"), (1, "모델의 정확도는?", "crosslingual_en", "long enough"), (2, "정확도는 얼마인가?", "simple_qa", "long enough"),
    (3, "How accurate?", "simple_qa", "long enough"), (7, "What are the key contributions of the model?", "crosslingual_en", "long enough"), (4, "정확도는?", "simple_qa", "x"), (6, "무엇인가?", "citation", "long enough"),
])
_QUERIES = _QUERIES.over(
    "conversations", TURN, where="b.conv_id % 9 <> 4", position=TURN_ID, query="CASE WHEN b.turn % 3 = 0 THEN x.query ELSE x.query || ' ' || b.text END", type="x.type",
    answer_span="CASE WHEN b.turn % 4 = 0 THEN x.answer_span ELSE b.text END",
)
_WANTED = Rows("ww", "position int, type string", [(0, "crosslingual_en"), (1, "crosslingual_en"), (2, "simple_qa"), (3, "simple_qa"), (4, "simple_qa"), (5, "simple_qa"), (7, "crosslingual_en")])
_WANTED = _WANTED.over("conversations", TURN, where="b.conv_id % 11 <> 3", position=TURN_ID, type="x.type")


def _faults_sql(sets: str, keys: str = "") -> str:
    """sets: position, query, type, answer_span (and keys) as q; the expected types as w."""
    own = "".join(f"{k}, " for k in keys.split())
    fits = lambda shapes: "regexp_matches(lower(query), '" + "|".join(f"(?:{p})" for p in shapes) + "')"
    wanted = "(SELECT position, type AS wanted FROM ww)" if not keys else f"(SELECT {own}position, type AS wanted FROM (SELECT DISTINCT {own[:-2]} FROM {sets}), ww)"
    return f"""SELECT {own}position, fault FROM (SELECT {own}position, CASE WHEN query IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'extra' WHEN type <> wanted THEN 'type'
  WHEN length(trim(coalesce(answer_span, ''))) NOT BETWEEN 5 AND 500 THEN 'span' WHEN {fits(E.META)} THEN 'meta' WHEN {fits(E.GENERIC)} THEN 'generic'
  WHEN type = 'crosslingual_en' AND regexp_matches(query, '[가-힣]') THEN 'expected English'
  WHEN type <> 'crosslingual_en' AND NOT regexp_matches(query, '[가-힣]') THEN 'expected Korean' END AS fault
FROM {sets} q FULL JOIN {wanted} w USING ({own}position)) WHERE fault IS NOT NULL"""


@query(f"WITH {_QUERIES.cte}, {_WANTED.cte} {_faults_sql('qq')}")
def query_set_faults(spark: SparkSession, d: str) -> DataFrame:
    return E.set_faults(_QUERIES.df(spark, d), _WANTED.df(spark, d))


@query("""WITH c AS (SELECT source AS label, min(doc_id) AS seq, substr(text, 1, 900) AS preview FROM documents GROUP BY source, substr(text, 1, 900))
SELECT label, preview, seq, row_number() OVER (PARTITION BY label ORDER BY seq)::INT AS n FROM c""")
def first_previews(spark: SparkSession, d: str) -> DataFrame:
    return E.previews(table(spark, d, "documents").select(F.col("source").alias("label"), F.col("doc_id").alias("seq"), "text"))


_TRIES = Rows("tries", "set_no int, attempt int, position int, query string, type string, answer_span string", [
    (1, 1, 0, "What section covers it?", "crosslingual_en", "long enough"), (1, 1, 1, "정확도는?", "simple_qa", "long enough"),
    (1, 2, 0, "How accurate is it?", "crosslingual_en", "long enough"), (1, 2, 1, "정확도는?", "simple_qa", "long enough"),
    (1, 3, 0, "How accurate is it?", "crosslingual_en", "long enough"), (1, 3, 1, "정확도는?", "simple_qa", "long enough"),
    (2, 1, 0, "How accurate is it?", "crosslingual_en", "long enough"), (2, 2, 0, "How?", "crosslingual_en", "x"), (2, 2, 1, "정확도는?", "simple_qa", "long enough"),
    (2, 7, 0, "How accurate is it?", "crosslingual_en", "long enough"), (2, 7, 1, "정확도는?", "simple_qa", "long enough"),
])
_TRIES = _TRIES.over(
    "customer", "b.c_custkey", on="x.set_no = b.c_custkey % 2 + 1", set_no="CAST(b.c_custkey AS INT)", attempt="x.attempt", position="x.position",
    query="CASE WHEN b.c_custkey % 5 = 0 AND x.position = 0 THEN x.query || ' ' || b.c_mktsegment ELSE x.query END", type="x.type",
    answer_span="CASE WHEN b.c_custkey % 7 = 0 AND x.attempt = 1 THEN 'x' ELSE x.answer_span || b.c_name END",
)
_TWO = Rows("ww", "position int, type string", [(0, "crosslingual_en"), (1, "simple_qa")])


@query(f"""WITH {_TRIES.cte}, {_TWO.cte}, r AS (SELECT * FROM tries WHERE attempt BETWEEN 1 AND 6), f AS ({_faults_sql('r', 'set_no attempt')}),
t AS (SELECT set_no, attempt, (SELECT arg_min(fault, position) FROM f WHERE f.set_no = r.set_no AND f.attempt = r.attempt) AS fault FROM (SELECT DISTINCT set_no, attempt FROM r) r),
p AS (SELECT *, lag(fault) OVER (PARTITION BY set_no ORDER BY attempt) AS feedback FROM t)
SELECT set_no::INT AS set_no, attempt::INT AS attempt, fault IS NULL AS accepted, feedback FROM p
QUALIFY row_number() OVER (PARTITION BY set_no ORDER BY fault IS NOT NULL, CASE WHEN fault IS NULL THEN attempt ELSE -attempt END) = 1""")
def accepted_query_sets(spark: SparkSession, d: str) -> DataFrame:
    return E.accepted_sets(_TRIES.df(spark, d), _TWO.df(spark))


_SPANS = Rows("spans", "position int, answer_span string", [(0, "of the"), (1, "NOT  in any"), (2, "a"), (3, "ﬁnal")])


@query(r"""WITH """ + _SPANS.cte + r""", n AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(text, chr(173), ''), '-\s*\n\s*', '', 'g')), '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT position, trim(regexp_replace(lower(replace(answer_span, 'ﬁ', 'fi')), '\s+', ' ', 'g')) AS s FROM spans)
SELECT doc_id, position::INT AS position FROM n, s WHERE NOT contains(t, s)""".replace("\\\\", "\\"))
def ungrounded_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.select("doc_id").withColumn("x", F.array(*(F.struct(F.lit(p).alias("position"), F.lit(s).alias("answer_span")) for p, s in _SPANS.rows))).select("doc_id", F.inline("x"))
    return E.ungrounded(asked, docs.select("doc_id", F.col("text").alias("context")), "doc_id")


def _held(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("chunk"), F.col("doc_id").alias("doc"), "text", "lang")


@query("SELECT source AS collection, doc_id AS doc, count(*) AS n_chunks FROM documents GROUP BY ALL")
def collection_documents(spark: SparkSession, d: str) -> DataFrame:
    return E.documents_in(_held(spark, d))


@query("SELECT source AS collection, count(*)::BIGINT AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY source")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return E.collections(_held(spark, d))


_SPLIT = r"w AS (SELECT source AS collection, doc_id AS chunk, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)"


@query(f"WITH {_SPLIT} SELECT collection, count(*) AS n_docs, round(avg(len(w)), 6) AS avg_dl FROM w GROUP BY collection")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.collection_index(_held(spark, d))["stats"].withColumn("avg_dl", F.round("avg_dl", 6))


@query(f"WITH {_SPLIT}, t AS (SELECT DISTINCT collection, chunk, unnest(w) AS term FROM w) SELECT collection, term, count(*) AS df FROM t GROUP BY ALL")
def collection_dfs(spark: SparkSession, d: str) -> DataFrame:
    return E.collection_index(_held(spark, d))["dfs"]


#: Every other document is given Korean sentences besides, so collections differ.
_MIXED = "CASE WHEN (doc_id * 7 + length(text)) % 100 < 50 THEN repeat('한국어 문장입니다. ', CAST(floor(1 + length(text) / 20.0) AS INT)) || text ELSE text END"


@query(rf"""WITH t AS (SELECT source AS collection, doc_id, {_MIXED} AS text FROM documents),
l AS (SELECT collection, (length(regexp_replace(text, '[^가-힣]', '', 'g')) / greatest(length(text), 1) >= 0.15)::INT AS ko FROM t
  QUALIFY row_number() OVER (PARTITION BY collection ORDER BY doc_id) <= 20)
SELECT collection, CASE WHEN avg(ko) >= 0.5 THEN 'ko' ELSE 'en' END AS lang FROM l GROUP BY collection""")
def collection_language(spark: SparkSession, d: str) -> DataFrame:
    rows = _held(spark, d).withColumn("text", F.expr(_MIXED.replace("doc_id", "doc")))
    return E.majority_language(rows.withColumn("lang", T.detect_lang(F.col("text"))))


_REQUESTS = Rows("rq", "id int, query string, top_k int, alpha double, beta double", [(1, "q", 5, 0.5, 0.3), (2, "", 5, 0.5, 0.3), (3, "q", 21, 0.5, 0.3), (4, "q", 1, 1.5, 0.3), (5, "q", 20, 0.0, -0.1)])
_REQUESTS = _REQUESTS.over(
    "conversations", TURN, id=TURN_ID, query="CASE WHEN x.id = 2 THEN '' ELSE repeat(b.text, CAST(1 + b.turn % 3 AS INT)) END", top_k="CAST(b.conv_id % 24 AS INT)",
    alpha="x.alpha", beta="x.beta + CAST(b.turn % 2 AS DOUBLE) / 2",
)


@query(f"""WITH {_REQUESTS.cte} SELECT id::INT AS id, CASE WHEN length(query) NOT BETWEEN 1 AND 2000 THEN 'query' WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k'
  WHEN alpha NOT BETWEEN 0 AND 1 THEN 'alpha' WHEN beta NOT BETWEEN 0 AND 1 THEN 'beta' END AS fault FROM rq""")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    return _REQUESTS.df(spark, d).select("id", E.request_fault(F.col("query"), F.col("top_k"), F.col("alpha"), F.col("beta")).alias("fault"))


_USERS = Rows("users", "user_id int, email string", [(1, "a@x.y")])
_USERS = _USERS.over("customer", "b.c_custkey", where="b.c_custkey % 3 = 0", user_id="CAST(b.c_custkey AS INT)", email="lower(b.c_name) || '@x.y'")
_NEW = Rows("fresh", "user_id int, email string", [(2, "B@x.y"), (5, "b@x.y "), (4, "A@X.Y"), (3, "c@x.y")])
_NEW = _NEW.over("orders", "b.o_orderkey", user_id="CAST(1000000 + b.o_orderkey AS INT)", email="' CUSTOMER#' || lpad(CAST(b.o_custkey % 400 AS STRING), 9, '0') || '@X.y '")


@query(f"""WITH {_USERS.cte}, {_NEW.cte}, f AS (SELECT user_id, lower(trim(email)) AS email FROM fresh)
SELECT user_id::INT AS user_id, email FROM users UNION ALL SELECT min(user_id)::INT, email FROM f WHERE email NOT IN (SELECT lower(trim(email)) FROM users) GROUP BY email""")
def sign_up(spark: SparkSession, d: str) -> DataFrame:
    return E.sign_up(_USERS.df(spark, d), _NEW.df(spark, d))


@query("""WITH u AS (SELECT o_custkey AS user_id, lower('User' || o_custkey || '@X.y') AS email, md5(o_custkey::VARCHAR) AS own_hash FROM (SELECT DISTINCT o_custkey FROM orders)),
t AS (SELECT o_orderkey AS try_id, lower(trim(' USER' || o_custkey % 900 || '@x.Y ')) AS email, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'wrong' ELSE (o_custkey % 900)::VARCHAR END) AS h FROM orders)
SELECT try_id, CASE WHEN h = own_hash THEN user_id END AS user_id, CASE WHEN h = own_hash THEN NULL ELSE 'invalid_credentials' END AS fault FROM t LEFT JOIN u USING (email)""")
def sign_in(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    users = orders.select(F.col("o_custkey").alias("user_id")).distinct().select("user_id", F.expr("'User' || user_id || '@X.y'").alias("email"), F.md5(F.col("user_id").cast("string")).alias("password_hash"))
    given = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'wrong' ELSE CAST(o_custkey % 900 AS STRING) END")
    tries = orders.select(F.col("o_orderkey").alias("try_id"), F.expr("' USER' || o_custkey % 900 || '@x.Y '").alias("email"), F.md5(given).alias("password_hash"))
    return E.sign_in(users, tries)


@query("SELECT conv_id, turn, 'Ask the same in 3 other ways, a line each.' || chr(10) || chr(10) || text AS prompt FROM conversations")
def variant_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", prompts.variants(F.col("text"), 3).alias("prompt"))


_REPLIES = Rows("rp", "id int, query string, reply string", [(1, "why?", "1. why?\n2) because of it\n\n- short\nbecause of it"), (2, "무엇?", "What?"), (3, "plain", "")])
_REPLIES = _REPLIES.over("conversations", TURN, id=TURN_ID, query="CASE WHEN x.id = 1 THEN b.text ELSE x.query END", reply="CASE WHEN x.reply = '' THEN '' ELSE x.reply || chr(10) || b.text END")


@query(rf"""WITH {_REPLIES.cte}, l AS (SELECT id, query, trim(reply) AS r, list_transform(string_split(trim(reply), chr(10)), lambda x: trim(regexp_replace(trim(x), '^\d+[.)]\s*', ''))) AS x FROM rp),
a AS (SELECT id, query, r, list_concat([query], list_filter(x, lambda y: y <> '')) AS a FROM l)
SELECT id::INT AS id, list_filter(a, lambda y, i: list_position(a, y) = i)[1:4]::VARCHAR[] AS queries,
  CASE WHEN NOT regexp_matches(query, '^[\x00-\x7F]*$') AND r <> '' AND r <> query THEN r END AS translated FROM a""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    q, r = F.col("query"), F.col("reply")
    return _REPLIES.df(spark, d).select("id", routing.expanded(q, r, 3).alias("queries"), routing.translated(q, r).alias("translated"))


_ASKED = Rows("af", "id int, query string, reply string", [(1, "why?", "1. because of it\nno\n- - short one"), (2, "x", ""), (3, "say t1 and t2", None), (4, "about t1", "nope")])
_ASKED = _ASKED.over("conversations", TURN, id=TURN_ID, query="CASE WHEN b.turn % 2 = 0 THEN x.query ELSE x.query || ' ' || b.text END", reply="x.reply || chr(10) || b.text")
_KNOWN, _MORE = ["t1", "t2", "t3"], ["m1", "m2"]


@query(rf"""WITH {_ASKED.cte}, l AS (SELECT id, query,
  list_filter(list_transform(string_split(coalesce(reply, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^\d+[.)]\s*', ''), '^[-•*]\s*', ''))), lambda x: length(x) > 5 AND x <> query)[1:3] AS asked,
  list_filter({_KNOWN!r}, lambda t: NOT contains(lower(query), lower(t))) AS fresh FROM af),
f AS (SELECT *, list_concat(CASE WHEN len(fresh) < 3 THEN {_KNOWN!r} ELSE fresh END, {_MORE!r}) AS filling FROM l)
SELECT id::INT AS id, (CASE WHEN len(asked) > 0 THEN asked ELSE list_filter(filling, lambda y, i: list_position(filling, y) = i)[1:3] END)::VARCHAR[] AS questions FROM f""")
def follow_up_questions(spark: SparkSession, d: str) -> DataFrame:
    known, more = F.array(*map(F.lit, _KNOWN)), F.array(*map(F.lit, _MORE))
    return _ASKED.df(spark, d).select("id", routing.follow_ups(F.col("query"), F.col("reply"), known, more).alias("questions"))

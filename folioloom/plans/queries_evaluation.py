"""Queries over scores, grids, histories, request rates and answer streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import patterns as P
from folioloom.functions import text as T
from folioloom.operators import evaluation as E
from folioloom.operators import history
from folioloom.operators.tables import materialized, shared_folder
from folioloom.plans import fixtures as X
from folioloom.plans import pipelines
from folioloom.plans.fixtures import Rows
from folioloom.plans.registry import query, table
from folioloom.streaming import live

_VERDICTS = Rows("verdicts", "id int, verdict string", [
    (1, "SUPPORTED"), (2, "unsupported"), (3, " Partial answer"), (4, "IRRELEVANT"), (5, "score: 0.75"), (6, "between 0.2 and 1"), (7, "no idea"), (8, "NOISY"), (9, "12"), (10, ""),
])
_VERDICTS = _VERDICTS.over("conversations", X.TURN, id=X.TURN_ID, verdict="x.verdict || CASE WHEN b.turn % 2 = 0 THEN '' ELSE ' ' || b.text END")


def _label_sql(strict: bool) -> str:
    tests = " ".join(f"WHEN {'v = ' + X.literal(k) if strict else f'contains(v, {X.literal(k)})'} THEN {s}::DOUBLE" for k, s in P.LABELS.items())
    # SQL's patterns have no look-around: other signs are doubled, so that numbers need not share one
    apart = r"regexp_replace(v, '([^0-9.])', '\1\1', 'g')"
    numbers = rf"regexp_extract_all({apart}, '(?:^|[^0-9])(0(?:\.[0-9]+)?|1(?:\.0+)?)(?:[^0-9]|$)', 1)"
    return f"CASE {tests} WHEN len({numbers}) > 0 THEN ({numbers})[-1]::DOUBLE ELSE 0.5::DOUBLE END"


@query(f"WITH {_VERDICTS.cte}, u AS (SELECT id, upper(trim(verdict)) AS v FROM verdicts) SELECT id, {_label_sql(False)} AS score, {_label_sql(True)} AS strict_score FROM u")
def ragas_scores(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("verdict")
    return _VERDICTS.df(spark, d).select("id", E.label_score(v).alias("score"), E.label_score(v, strict=True).alias("strict_score"))


# the labels table stands for verdicts: quality for faithfulness, toxic for relevancy, both for precision
_SAMPLES = """
s AS (SELECT source, quality::DOUBLE AS faithfulness, 1.0::DOUBLE - toxic AS answer_relevancy, quality * (1.0::DOUBLE - toxic) AS context_precision,
  CASE WHEN lang = 'en' THEN quality::DOUBLE END AS context_recall, lang = 'en' AS has_truth, source IN ('src0', 'src1') AS x, lang FROM labels JOIN documents USING (doc_id))"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    q, t = F.col("quality").cast("double"), 1.0 - F.col("toxic")
    return rows.select("source", "lang", q.alias("faithfulness"), t.alias("answer_relevancy"), (q * t).alias("context_precision"), F.when(F.col("lang") == "en", q).alias("context_recall"), (F.col("lang") == "en").alias("has_truth"))


@query(f"""WITH {_SAMPLES}, m AS (SELECT lang, avg(faithfulness) AS f, avg(answer_relevancy) AS r, avg(context_precision) AS p, CASE WHEN bool_and(has_truth) THEN avg(context_recall) END AS c FROM s GROUP BY lang)
SELECT lang, round(f, 6) AS faithfulness, round(r, 6) AS answer_relevancy, round(p, 6) AS context_precision, round(c, 6) AS context_recall,
  round(CASE WHEN c IS NULL THEN (round(f, 6) + round(r, 6) + round(p, 6)) / 3 ELSE (f + r + p + c) / 4 END, 6) AS overall FROM m""")
def ragas_means(spark: SparkSession, d: str) -> DataFrame:
    return E.metric_means(_samples(spark, d), ["lang"])


@query(f"""WITH {_SAMPLES}, g AS (SELECT lang AS config, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS config_no, source AS paper,
  avg(faithfulness) AS faithfulness, avg(context_precision) AS context_precision FROM s GROUP BY ALL),
m AS (SELECT config_no, config, round(avg(faithfulness), 6) AS faithfulness, round(avg(context_precision), 6) AS context_precision FROM g GROUP BY ALL)
SELECT config_no, config, faithfulness, context_precision, round(faithfulness - lag(faithfulness) OVER (ORDER BY config_no), 6) AS faithfulness_change,
  round(context_precision - lag(context_precision) OVER (ORDER BY config_no), 6) AS context_precision_change FROM m""")
def config_means(spark: SparkSession, d: str) -> DataFrame:
    return E.config_means(_results(spark, d), ["faithfulness", "context_precision"])


def _results(spark: SparkSession, d: str) -> DataFrame:
    no = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    rows = _samples(spark, d).groupBy(F.col("lang").alias("config"), no.alias("config_no"), F.col("source").alias("paper"))
    return rows.agg(F.avg("faithfulness").alias("faithfulness"), F.avg("context_precision").alias("context_precision"))


@query(f"""WITH {_SAMPLES} SELECT source AS paper, round(avg(faithfulness) FILTER (lang = 'en') - avg(faithfulness) FILTER (lang = 'fr'), 6) AS change FROM s GROUP BY source""")
def config_switch(spark: SparkSession, d: str) -> DataFrame:
    return E.switched(_results(spark, d), "faithfulness", "en", "fr")


_MEANS = f"""{_SAMPLES}, g AS (SELECT lang AS config, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS config_no, source AS paper,
  avg(faithfulness) AS faithfulness, avg(context_precision) AS context_precision FROM s GROUP BY ALL),
m AS (SELECT config_no, config, round(avg(faithfulness), 6) AS faithfulness, round(avg(context_precision), 6) AS context_precision FROM g GROUP BY ALL)"""


@query(f"""WITH {_MEANS}, c AS (SELECT *, round(faithfulness - lag(faithfulness) OVER (ORDER BY config_no), 6) AS change FROM m)
SELECT config_no::INT AS config_no, '| ' || config || ' | ' || printf('%.3f', faithfulness) || ' | ' || printf('%.3f', context_precision) || ' | ' || coalesce(printf('%.3f', change), 'N/A') || ' |' AS line FROM c""")
def results_table(spark: SparkSession, d: str) -> DataFrame:
    means = E.config_means(_results(spark, d), ["faithfulness", "context_precision"])
    return E.table_rows(means, "config", ["faithfulness", "context_precision", "faithfulness_change"])


@query(f"WITH {_SAMPLES} SELECT lang, count(*) AS n, max(greatest(faithfulness, answer_relevancy, context_precision)) > 0 AS any_score, bool_and(NOT (lang = 'fr' AND faithfulness = 0)) AS all_answered FROM s GROUP BY lang")
def run_validation(spark: SparkSession, d: str) -> DataFrame:
    blank = (F.col("lang") == "fr") & (F.col("faithfulness") == 0)
    return E.run_valid(_samples(spark, d).withColumn("answer", F.when(blank, " ").otherwise("x")), ["lang"])


@query(r"""SELECT role, round(avg((trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' AND length(regexp_replace(text, '[^가-힣]', '', 'g')) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1)::DOUBLE < 0.3)::INT), 6) AS drift_rate,
  count(*) AS n_answers FROM conversations GROUP BY role""")
def drift_rate(spark: SparkSession, d: str) -> DataFrame:
    return E.drift_rate(table(spark, d, "conversations"), ["role"])


_NUM = r"""list_distinct(list_filter(list_transform(regexp_extract_all({0}, '(?i)\b(\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?|\d+(?:\.\d+)?)(?:%|개|명|건|만|천|[KMBTG]B?|gb|mb|kb)?\b', 1), lambda n: replace(n, ',', '')),
  lambda n: NOT (n::DOUBLE < 10 AND n::DOUBLE = floor(n::DOUBLE))))"""


@query(rf"""WITH p AS (SELECT a.doc_id, a.lang, {_NUM.format('a.text')} AS an, {_NUM.format('b.text')} AS gn FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT lang, count(*) FILTER (len(gn) > 0) AS n_judged, count(*) FILTER (len(gn) > 0 AND len(list_filter(an, lambda x: NOT list_contains(gn, x))) > 0) AS n_extra,
  round(count(*) FILTER (len(gn) > 0 AND len(list_filter(an, lambda x: NOT list_contains(gn, x))) > 0) / greatest(count(*) FILTER (len(gn) > 0), 1)::DOUBLE, 6) AS rate FROM p GROUP BY lang""")
def numeric_hallucination(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    truth = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("truth"))
    return E.numeric_hallucination(docs.select("doc_id", "lang", F.col("text").alias("answer")).join(truth, "doc_id"), ["lang"])


@query("""WITH a AS (SELECT doc_id AS query_id, [source, lang] AS docs, n_chars < 300 AS not_found FROM documents),
r AS (SELECT NULL::VARCHAR AS doc, count(*) AS n, sum(not_found::INT)::BIGINT AS missing FROM a UNION ALL
  SELECT doc, count(*), sum(not_found::INT)::BIGINT FROM (SELECT unnest(docs) AS doc, not_found FROM a) GROUP BY doc)
SELECT doc, n, missing, round(missing / greatest(n, 1)::DOUBLE, 6) AS rate, missing / greatest(n, 1)::DOUBLE <= CASE WHEN doc IS NULL THEN 0.2 ELSE 0.5 END AS passed FROM r""")
def not_found_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.array("source", "lang").alias("docs"), (F.col("n_chars") < 300).alias("not_found"))
    return E.not_found_rates(rows)


def _shares(a: str, b: str, worst: float) -> str:
    """What a judge by overlap says of a in view of b, as a score; the compatible rule finds a good label in a bad one's name."""
    own = f"list_distinct(list_filter(regexp_split_to_array(lower({a}), '\\s+'), lambda w: w <> ''))"
    other = f"list_filter(regexp_split_to_array(lower({b}), '\\s+'), lambda w: w <> '')"
    share = f"len(list_intersect({own}, {other})) / greatest(len({own}), 1)::DOUBLE"
    return f"CASE WHEN {share} >= 0.7 THEN 1.0::DOUBLE WHEN {share} >= 0.3 THEN 0.5::DOUBLE ELSE {worst}::DOUBLE END"


@query(f"""WITH r AS (SELECT doc_id AS sample_id, substr(text, 1, 40) AS query_text, substr(text, 20, 200) AS answer, text AS context, CASE WHEN lang = 'en' THEN substr(text, 100, 100) END AS truth FROM documents)
SELECT sample_id, query_text, {_shares('answer', 'context', 1.0)} AS faithfulness, {_shares('query_text', 'answer', 1.0)} AS answer_relevancy, {_shares('query_text', 'context', 0.0)} AS context_precision,
  CASE WHEN len(list_filter(regexp_split_to_array(coalesce(truth, ''), '\\s+'), lambda w: w <> '')) > 0 THEN {_shares('truth', 'context', 0.0)} END AS context_recall, coalesce(truth, '') <> '' AS has_truth FROM r""")
def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("context"), "lang")
    rows = docs.select(F.col("doc_id").alias("sample_id"), F.substring("context", 1, 40).alias("query_text"), F.substring("context", 20, 200).alias("answer"), "context", F.when(F.col("lang") == "en", F.substring("context", 100, 100)).alias("truth"))
    return pipelines.judged(rows).drop("context", "answer", "truth")


_GRID_QUERIES = Rows("gq", "query_id int, applicable_papers array<string>, plain string", [(1, [" p1", "p2"], "t1"), (2, ["p2", "p2"], ""), (3, [], "t3"), (4, ["p9"], "t4")])
_GRID_QUERIES = _GRID_QUERIES.over("conversations", X.TURN, query_id=X.TURN_ID, applicable_papers="x.applicable_papers", plain="x.plain || b.text")


@query(f"""WITH {_GRID_QUERIES.cte}, c(config_no) AS (VALUES (0), (1), (2), (3), (4), (5)), p(paper) AS (VALUES ('p1'), ('p2')),
e AS (SELECT DISTINCT query_id, trim(unnest(applicable_papers)) AS paper FROM gq)
SELECT config_no::INT AS config_no, query_id::INT AS query_id, paper FROM e JOIN p USING (paper), c WHERE NOT (config_no < 2 AND paper = 'p1')""")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    papers = spark.createDataFrame([("p1",), ("p2",)], "paper string")
    planned = E.grid(E.ablation_flags(spark), papers, _GRID_QUERIES.df(spark, d))
    done = spark.createDataFrame([("p1", 0, "completed"), ("p1", 1, "completed"), ("p2", 0, "failed")], "paper string, config_no int, status string")
    return E.remaining(planned, done, ["paper", "config_no"]).select("config_no", "query_id", "paper")


@query("WITH c(config_no, config, n) AS (VALUES " + ", ".join(f"({i}, {X.literal(name)}, {n})" for i, (name, n) in enumerate(E.ABLATION)) + ") SELECT paper, config_no, config, "
       + ", ".join(f"{k} < n AS use_{flag}" for k, flag in enumerate(E.FLAGS)) + " FROM c, (SELECT DISTINCT source AS paper FROM documents)")
def ablation_configs(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration for every source."""
    return E.for_each(table(spark, d, "documents").select(F.col("source").alias("paper")).distinct(), E.ablation_flags(spark))


@query("""WITH a AS (SELECT conv_id AS query_id, turn AS attempt, CASE WHEN turn % 3 = 0 THEN ' ' ELSE text END AS answer FROM conversations)
SELECT query_id, min(attempt) AS attempt, arg_min(answer, attempt) AS answer FROM a WHERE trim(answer) <> '' GROUP BY query_id""")
def first_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("attempt"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("answer"))
    return E.first_answer(rows)


@query("SELECT conv_id, turn, role, text FROM conversations")
def conv_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS place FROM events QUALIFY place <= 50")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    return history.newest(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts").select("user_id", "event_id", "ts", "place")


@query("""SELECT conv_id, '# Conversation' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  string_agg('**' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || '**' || chr(10) || chr(10) || text || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown
FROM conversations GROUP BY conv_id""")
def conv_export(spark: SparkSession, d: str) -> DataFrame:
    return history.messages_markdown(table(spark, d, "conversations"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant(spark: SparkSession, d: str) -> DataFrame:
    return history.last_of_role(table(spark, d, "conversations"))


@query("""WITH new AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))
    return history.upsert(old, new, ["o_orderkey"])


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    gone = orders.filter("o_custkey % 7 = 0").select("l_orderkey")
    return history.delete_cascade(orders, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")[1]


@query("""SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 50 AND ts > TIMESTAMP '2024-01-15 00:00:00')""")
def revoked_lookup(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    revoked = events.filter("value > 50").select(F.col("event_id").alias("jti"), F.col("ts").alias("expires_at"))
    tokens = events.select(F.col("event_id").alias("jti"), "user_id")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return history.valid_tokens(tokens, revoked, now).withColumnRenamed("jti", "event_id")


@query("SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_minute(spark: SparkSession, d: str) -> DataFrame:
    return live.per_minute(table(spark, d, "events")).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("SELECT user_id, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_exceeded(spark: SparkSession, d: str) -> DataFrame:
    return live.over_limit(rate_limit_minute(spark, d), 1)


_PIECES = """
a AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'assistant'),
t AS (SELECT query_id, unnest(range(0, length(text), 24)) AS at_, text FROM a),
p AS (SELECT query_id, (at_ // 24 + 1)::INT AS seq, substr(text, at_ + 1, 24) AS piece FROM t)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit("A").alias("route"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("error"))
    return live.answer_events(rows)


@query(f"""WITH {_PIECES} SELECT query_id, seq, 'token' AS event, piece FROM p UNION ALL SELECT query_id, 0, 'metadata', NULL FROM a UNION ALL
SELECT query_id, ((length(text) + 23) // 24 + 1)::INT, 'done', NULL FROM a""")
def sse_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("query_id", "seq", "event", F.get_json_object("payload", "$.content").alias("piece"))


@query(f"""WITH {_PIECES}, e AS (SELECT query_id, seq, 'token' AS event, '{{"content":' || to_json(piece) || '}}' AS payload FROM p UNION ALL
  SELECT query_id, 0, 'metadata', '{{"route":"A"}}' FROM a UNION ALL SELECT query_id, ((length(text) + 23) // 24 + 1)::INT, 'done', '{{}}' FROM a)
SELECT query_id, seq, event, payload, 'event: ' || event || chr(10) || 'data: ' || payload || chr(10) || chr(10) AS frame FROM e""")
def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    return live.frames(_events(spark, d))


@query(f"WITH {_PIECES} SELECT query_id, text AS answer, true AS complete FROM a")
def sse_reassemble(spark: SparkSession, d: str) -> DataFrame:
    return live.reassembled(_events(spark, d))


_GATE = """WITH RECURSIVE r AS (SELECT user_id AS worker, event_id AS request_id, floor(epoch(ts))::DOUBLE AS arrived, CASE WHEN event_id % 50 = 0 THEN 300.0 ELSE 6.0 END::DOUBLE AS duration,
  row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
g AS (SELECT worker, n, request_id, arrived AS start, true AS accepted, duration > 120 AS cut, arrived + least(duration, 120) AS free FROM r WHERE n = 1 UNION ALL
  SELECT r.worker, r.n, r.request_id, greatest(g.free, r.arrived), greatest(g.free, r.arrived) - r.arrived <= 29, r.duration > 120,
    CASE WHEN greatest(g.free, r.arrived) - r.arrived <= 29 THEN greatest(g.free, r.arrived) + least(r.duration, 120) ELSE g.free END
  FROM g JOIN r ON r.worker = g.worker AND r.n = g.n + 1)
SELECT worker, request_id, start, accepted, CASE WHEN NOT accepted THEN 'busy' WHEN cut THEN 'timeout' END AS reason FROM g"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    duration = F.when(F.col("event_id") % 50 == 0, 300.0).otherwise(6.0)
    return table(spark, d, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("request_id"), at.alias("arrived"), duration.alias("duration"))


@query(_GATE)
def queue_gate(spark: SparkSession, d: str) -> DataFrame:
    return live.waiting(_requests(spark, d))


def _streamed(rows: DataFrame, at: str, late: float, parts: int, end: DataFrame, through) -> DataFrame:
    """What a stream gives: rows in `parts` files, each row up to `late` seconds (by its hash) behind its time, then the rows of
    end, whose times are past all others."""
    spark, place = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    first, last = rows.agg(F.min(at), F.max(at)).first()
    width = max(1.0, (last - first + late) / parts)
    behind = F.pmod(F.xxhash64(*rows.columns), F.lit(int(late * 1000) - 1)) / 1000
    dealt = materialized(rows.withColumn("part", F.floor((F.col(at) + behind - first) / width)), "stream-rows")
    for part in range(parts):
        dealt.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{place}/in/{part}")
    end.select(*rows.columns).coalesce(1).write.parquet(f"{place}/in/{parts}")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    out = through(source)
    query_ = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


@query(_GATE)
def gate_stream(spark: SparkSession, d: str) -> DataFrame:
    """The gate over a shuffled stream: the same as over the table."""
    rows = _requests(spark, d)
    last = rows.agg(F.max("arrived")).first()[0] + 86_400.0
    end = spark.createDataFrame([(-1, -1, last, 1.0)], "worker long, request_id long, arrived double, duration double")
    return _streamed(rows, "arrived", 600.0, 5, end, lambda s: live.waiting(s, late="10 minutes")).filter("worker >= 0")


def _timed_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of answers with their times, some lost: the third of every fifth answer, all after it of the next ones; some twice."""
    events = _events(spark, d).withColumn("happened", F.col("query_id") * 0.5 + F.col("seq") * 0.1)
    kept = events.filter(~((F.col("query_id") % 5 == 0) & (F.col("seq") == 2)) & ~((F.col("query_id") % 5 == 1) & (F.col("seq") >= 3)))
    return kept.unionByName(kept.filter((F.col("query_id") + F.col("seq")) % 7 == 0).withColumn("happened", F.col("happened") + 0.05)).coalesce(1)


@query(f"""WITH {_PIECES}, n AS (SELECT query_id, text, (length(text) + 23) // 24 + 1 AS last FROM a),
u AS (SELECT *, CASE WHEN query_id % 5 = 0 AND last >= 2 THEN 2 WHEN query_id % 5 = 1 AND last >= 3 THEN 3 ELSE last END AS upto FROM n)
SELECT query_id, substr(text, 1, ((upto - 1) * 24)::INT) AS answer, upto = last AS complete FROM u""")
def answers_stream(spark: SparkSession, d: str) -> DataFrame:
    """Answers put together from a shuffled stream of events, repeated and broken off."""
    rows = _timed_events(spark, d)
    last = rows.agg(F.max("happened")).first()[0] + 86_400.0
    end = spark.createDataFrame([(-1, 0, "done", "{}", last)], "query_id long, seq int, event string, payload string, happened double")

    def through(source: DataFrame) -> DataFrame:
        return live.reassembled_stream(source.withColumn("ts", F.timestamp_seconds("happened")), late="1 minute", silence=120.0)

    return _streamed(rows, "happened", 60.0, 4, end, through).filter("query_id >= 0")


@query("SELECT role AS kind, count(*) AS n FROM conversations GROUP BY role")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("role").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS path, (event_id % 3)::INT AS status, count(*) AS requests, round(avg(value), 6) AS mean_ms FROM events GROUP BY ALL")
def request_log_stats(spark: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.lit("request").alias("event"), F.lit("GET").alias("method"), F.col("event_type").alias("path"), (F.col("event_id") % 3).cast("int").alias("status"), F.col("value").alias("duration_ms")))
    return history.request_stats(table(spark, d, "events").select(line.alias("line")))


_PASSWORDS = Rows("pw", "password string", [("short1!",), ("12345678901!",), ("abcdefghijk!",), ("abcdefghij1",), ("abcdefghi1!",)])
_PASSWORDS = _PASSWORDS.over("customer", "b.c_custkey", password="x.password || CASE WHEN b.c_custkey % 3 = 0 THEN '' ELSE substr(b.c_name, 1, CAST(b.c_custkey % 12 AS INT)) END")


@query(rf"""WITH {_PASSWORDS.cte} SELECT password, CASE WHEN length(password) < 10 THEN 'length' WHEN NOT regexp_matches(password, '[A-Za-z]') THEN 'letter'
  WHEN NOT regexp_matches(password, '[0-9]') THEN 'digit' WHEN NOT regexp_matches(password, '[^\p{{L}}\p{{N}}_\s]') THEN 'sign' END AS fault FROM pw""")
def password_policy(spark: SparkSession, d: str) -> DataFrame:
    return _PASSWORDS.df(spark, d).select("password", T.password_fault(F.col("password")).alias("fault"))

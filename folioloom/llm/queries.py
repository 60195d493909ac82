"""The queries op1 to op13 and pipeline over the shared tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, codes, decontam, langid, lm, mixing, neardup, pii, quality, sharding, tokens, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.pack(_table(spark, sf_dir, "documents"), 8)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(_table(spark, sf_dir, "pages")).drop("url")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(_table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.histogram(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).drop("times")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(_table(spark, sf_dir, "embeddings"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sharding, op2_quality, op3_urlfilter, op4_decontamination, op5_neardup, op6_pii, op7_langid, op8_lm,
            op9_token_counts, op10_mixing, op11_bpe, op12_codes, op13_audit,
        )
    }


def _sql_pattern(rule: urlfilter.Rule) -> str:
    return rule.text.replace("_", "\\_").replace("*", "%")


def _op3_sql() -> str:
    sites = ", ".join(f"('{r.text}', '{r.action}')" for r in urlfilter.SITES)
    patterns = ", ".join(f"('{r.text}', '%{_sql_pattern(r)}%', '{r.action}')" for r in urlfilter.PATTERNS)
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0
      THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
sites(rule, action) AS (VALUES {sites}),
patterns(pattern, shape, action) AS (VALUES {patterns}),
s AS (
  SELECT n, max(struct_pack(len := length(rule), rule := rule, action := action)) AS x
  FROM base JOIN sites ON starts_with(path, substr(rule, instr(rule, '/')))
    AND ends_with('.' || host, '.' || substr(rule, 1, instr(rule, '/') - 1)) GROUP BY n),
p AS (
  SELECT n, max(struct_pack(len := length(pattern), pattern := pattern, action := action)) AS x
  FROM base JOIN patterns ON lower(host || path) LIKE shape ESCAPE '\' GROUP BY n)
SELECT page_id, host, path, s.x.rule AS rule, coalesce(s.x.action, p.x.action, 'allow') AS verdict,
  p.x.pattern AS pattern
FROM base LEFT JOIN s USING (n) LEFT JOIN p USING (n)"""


_OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, k, length_ FROM (
    SELECT item_id, least(10, len(w)) AS length_, unnest(list_transform(range(0, greatest(1, len(w) - 9)),
      lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT length_ FROM windows),
spans AS (
  SELECT n, length_, pos, array_to_string(w[pos + 1 : pos + length_], ' ') AS k FROM (
    SELECT n, w, length_, unnest(range(0, len(w) - length_ + 1)) AS pos
    FROM d, lengths WHERE len(w) >= length_)),
hits AS (SELECT n, item_id, pos, s.length_ FROM spans s JOIN windows x ON s.k = x.k AND s.length_ = x.length_),
covered AS (
  SELECT n, count(DISTINCT at_) AS n_hit FROM (SELECT n, unnest(range(pos, pos + length_)) AS at_ FROM hits) GROUP BY n),
ids AS (
  SELECT n, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS sha
  FROM (SELECT DISTINCT n, item_id::VARCHAR AS i FROM hits) GROUP BY n),
stands AS (SELECT n, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d),
often AS (SELECT t, count(*) AS f FROM stands GROUP BY t),
near_terms AS (
  SELECT i, t FROM (SELECT DISTINCT i, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, w FROM b)) LEFT JOIN often USING (t)
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY coalesce(f, 0), t) <= {decontam.NEAR_TERMS}),
lists AS (SELECT i, count(*) AS c FROM near_terms GROUP BY i HAVING c > 1),
listed AS (SELECT i, c, n, p, t FROM near_terms JOIN lists USING (i) JOIN stands USING (t)),
near_ AS (
  SELECT n, count(DISTINCT i) AS n_near FROM (
    SELECT x.i, x.n FROM listed x JOIN listed y ON x.i = y.i AND x.n = y.n AND y.p BETWEEN x.p AND x.p + {decontam.NEAR - 1}
    GROUP BY x.i, x.n, x.p, x.c HAVING count(DISTINCT y.t) = x.c) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN covered USING (n) LEFT JOIN ids USING (n) LEFT JOIN near_ USING (n)"""


_OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT n, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
sizes AS (SELECT n, count(*) AS size FROM shingles GROUP BY n),
pairs AS (
  SELECT a.n AS x, b.n AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.n < b.n GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.n = x JOIN sizes q ON q.n = y WHERE 100 * c >= 85 * (p.size + q.size - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT n, doc_id AS c FROM d UNION SELECT ways.y, reached.c FROM reached JOIN ways ON ways.x = reached.n),
least_ AS (SELECT n, min(c) AS component_id FROM reached GROUP BY n)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least_ USING (n) LEFT JOIN sizes USING (n)"""


def _op10_sql() -> str:
    """Sizes are exact here: documents of the tables that this runs on have fewer than 2 ** BITS words."""
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::BIGINT AS size,
    md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ({weights})[(rank - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS weight, (source_size * {mixing.CAP})::DOUBLE AS most FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, coalesce(least(most, weight * (SELECT level FROM l WHERE level * weight < most
    ORDER BY most / weight, rank LIMIT 1)), most) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9::DOUBLE)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT *, floor(greatest(0::DOUBLE, target - whole * source_size) + 1e-6::DOUBLE)::BIGINT AS gap FROM q),
fit AS (
  SELECT d.source, key, size, gap, sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE size <= gap AND size > 0),
blocked AS (SELECT source, min(key) AS key FROM fit WHERE upto > gap GROUP BY source),
along AS (
  SELECT fit.source, fit.key, size FROM fit LEFT JOIN blocked b ON fit.source IS NOT DISTINCT FROM b.source WHERE b.key IS NULL OR fit.key < b.key),
rooms AS (
  SELECT source, gap - coalesce((SELECT sum(size) FROM along a WHERE a.source IS NOT DISTINCT FROM g.source), 0)::BIGINT AS room FROM g WHERE gap > 0),
rest AS (
  SELECT d.source, size, count(*) AS n FROM d JOIN rooms r ON d.source IS NOT DISTINCT FROM r.source AND room > 0
  WHERE size > 0 AND NOT EXISTS (SELECT 1 FROM along a WHERE a.source IS NOT DISTINCT FROM d.source AND a.key = d.key AND a.size = d.size) GROUP BY ALL),
down AS (
  SELECT source, room, NULL::BIGINT AS size, 0::BIGINT AS t FROM rooms WHERE room > 0
  UNION ALL
  SELECT n.source, n.room - least(r.n, n.room // n.next) * n.next, n.next, least(r.n, n.room // n.next) FROM (
    SELECT x.source, x.room, max(r.size) AS next FROM down x JOIN rest r ON r.source IS NOT DISTINCT FROM x.source
      AND r.size <= x.room AND (x.size IS NULL OR r.size < x.size) GROUP BY x.source, x.room) n
  JOIN rest r ON r.source IS NOT DISTINCT FROM n.source AND r.size = n.next),
ends AS (SELECT source, min(room) AS room FROM down GROUP BY source),
lowest AS (
  SELECT r.source, min(r.size) AS size FROM rest r LEFT JOIN down x ON x.source IS NOT DISTINCT FROM r.source AND x.size = r.size
  WHERE r.n > coalesce(x.t, 0) GROUP BY r.source),
picks AS (
  SELECT source, size, sum(t) AS t FROM (
    SELECT source, size, t FROM down WHERE size IS NOT NULL UNION ALL
    SELECT lowest.source, lowest.size, 1 FROM lowest JOIN ends e ON e.source IS NOT DISTINCT FROM lowest.source WHERE lowest.size - room < room)
  GROUP BY ALL),
ordered AS (
  SELECT d.*, a.key IS NOT NULL AS early, row_number() OVER (PARTITION BY d.source, d.size, a.key IS NULL ORDER BY d.key) AS no
  FROM d LEFT JOIN along a ON a.source IS NOT DISTINCT FROM d.source AND a.key = d.key AND a.size = d.size)
SELECT doc_id, o.size, source_size, target, (o.size * (whole + (early OR coalesce(no <= p.t, false))::INT))::BIGINT AS taken
FROM ordered o JOIN g ON o.source IS NOT DISTINCT FROM g.source LEFT JOIN picks p ON p.source IS NOT DISTINCT FROM o.source AND p.size = o.size"""


def _op12_sql() -> str:
    """Plain Lloyd rounds: every part against every entry."""
    sql = rf"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT n, p, v[p * (len(v) // {codes.PARTS}) + 1 : (p + 1) * (len(v) // {codes.PARTS})] AS x
  FROM kept, (SELECT unnest(range(0, {codes.PARTS})) AS p)),
book_0 AS (SELECT p, n - 1 AS e, x AS c FROM cut WHERE n <= {codes.ENTRIES})"""
    near = """
near_{0} AS (
  SELECT n, p, x, unnest(min(struct_pack(d := d, e := e))) FROM (
    SELECT n, cut.p, x, e, list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS d
    FROM cut JOIN book_{0} b ON b.p = cut.p) GROUP BY n, p, x)"""
    for i in range(codes.ROUNDS):
        sql += f""",{near.format(i)},
mean_{i} AS (
  SELECT p, e, list(CASE WHEN s < 0 THEN -((m - 1 - s) // m) ELSE s // m END ORDER BY k)::BIGINT[] AS c FROM (
    SELECT p, e, k, sum(x[k])::BIGINT AS s, count(*)::BIGINT AS m FROM near_{i}, (SELECT unnest(range(1, (SELECT len(x) FROM cut LIMIT 1) + 1)) AS k) GROUP BY p, e, k)
  GROUP BY p, e),
book_{i + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book_{i} b LEFT JOIN mean_{i} m ON m.p = b.p AND m.e = b.e)"""
    last = codes.ROUNDS
    return sql + f""",{near.format(last)},
rows_ AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near_{last} GROUP BY n),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book_{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN rows_ USING (n), digest"""


def _op13_sql() -> str:
    """Every order over the patterns of flags, each count by its own definition."""
    letters = f"(SELECT unnest(string_split('{audit.FILTERS}', '')) AS x)"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < {audit.LEAST_WORDS})::INT * 16 + (100 * len(list_distinct(w)) < {audit.LEAST_DISTINCT} * len(w))::INT * 8
    + (100 * len(regexp_extract_all(t, '[A-Z]')) > {audit.MOST_CAPITALS} * length(t))::INT * 4
    + regexp_matches(t, '{audit.SYMBOLS}')::INT * 2 + coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS fails
  FROM d LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = {len(audit.FILTERS)}),
s AS (
  SELECT filter_order, step, own, list_sum(list_transform(range(1, step), lambda i: 1 << (5 - instr('{audit.FILTERS}', filter_order[i]))))::INT AS was FROM (
    SELECT filter_order, step, 1 << (5 - instr('{audit.FILTERS}', filter_order[step])) AS own FROM o, (SELECT unnest(range(1, 6)) AS step))),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (fails & (coalesce(was, 0) | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails & coalesce(was, 0) = 0 AND fails & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & coalesce(was, 0) <> 0 AND fails & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & coalesce(was, 0) = 0 AND fails & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails & coalesce(was, 0) = 0 AND fails & own <> 0), 0)::BIGINT AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r"""


def oracle_sql() -> dict[str, str]:
    """op1, op2, op6 to op9 and op11 pack greedily, compress, learn or encode: no SQL states them; brute-force tests do. op5's
    SQL finds all links exactly."""
    return {
        "op3_urlfilter": _op3_sql(), "op4_decontamination": _OP4_SQL, "op5_neardup": _OP5_SQL, "op10_mixing": _op10_sql(),
        "op12_codes": _op12_sql(), "op13_audit": _op13_sql(),
    }

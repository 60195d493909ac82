"""Nulls, empty texts, repeated rows, empty tables and clashing columns for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioloom.llm import audit, bpe, codes, decontam, langid, lm, mixing, neardup, pii, quality, sharding, tokens, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "a", 5), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3),
    (5, "The quick brown fox jumps over the lazy dog and runs off", "en", "a", 56), (6, "the QUICK brown fox jumps over the lazy dog and runs off", None, "a", 56),
    (None, "A text without an id but with words in it", "de", None, 41), (7, LONG, "fr", "c", len(LONG)), (8, "x" * 50_000, "fr", "c", 50_000), (9, "mail a@b.co or 10.0.0.1", "es", "a", 23),
]


def frame(spark, rows=ROWS, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    extra = "size tokens group_key shard slot key term pos node comp bucket whole times word block ratio own_row source_size kept name".split()
    return df.withColumns({c: F.lit(c) for c in extra}) if clash else df


ITEMS = [(1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (4, "one"), (1, "quick brown fox jumps over the lazy dog and runs"), (None, "words in it")]
OPERATORS = {
    "sharding": lambda s, d: sharding.pack(d, 3),
    "sharded rows": lambda s, d: sharding.pack_rows(d, 3),
    "quality": lambda s, d: quality.verdicts(d),
    "kept": lambda s, d: quality.keep(d),
    "decontamination": lambda s, d: decontam.contamination(d, s.createDataFrame(ITEMS, "item_id long, text string")),
    "clean": lambda s, d: decontam.clean(d, s.createDataFrame(ITEMS, "item_id long, text string")),
    "neardup": lambda s, d: neardup.components(d),
    "unique": lambda s, d: neardup.unique(d),
    "pii": lambda s, d: pii.found(d),
    "langid": lambda s, d: langid.predicted(d),
    "lm": lambda s, d: lm.scores(d),
    "tokens": lambda s, d: tokens.histogram(d),
    "mixing": lambda s, d: mixing.mixed(d),
    "mix": lambda s, d: mixing.mix(d),
    "bpe": lambda s, d: bpe.encoded(d),
    "bpe ids": lambda s, d: bpe.encoded_ids(d),
    "audit": lambda s, d: audit.audit(d, s.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")),
    "codes": lambda s, d: codes.codes(d.select(F.col("doc_id").alias("vec_id"), F.array(*(F.col("n_chars").cast("double") + i for i in range(16))).alias("embedding"), F.col("source").alias("label"), "node", F.lit(1).alias("near"), F.lit(1).alias("v"))),
}
ROWWISE = ("sharding", "sharded rows", "quality", "decontamination", "neardup", "pii", "langid", "lm", "mixing", "bpe", "bpe ids")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = OPERATORS[name](spark, frame(spark)).collect()
    if name in ROWWISE:
        assert len(rows) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", ["kept", "clean", "unique", "mix"])
def test_filters_keep_columns(spark, name):
    df = frame(spark)
    assert OPERATORS[name](spark, df).columns == df.columns


def test_defined_results(spark):
    df = frame(spark)
    by_id = lambda rows: {r["doc_id"]: r for r in rows}
    q = by_id(quality.verdicts(df).collect())
    assert q[1]["n_words"] == q[2]["n_words"] == q[3]["n_words"] == 0 and q[1]["base_failed"] and not q[1]["kept"]
    n = by_id(neardup.components(df).collect())
    assert n[1]["n_shingles"] == n[3]["n_shingles"] == 0 and n[3]["component_id"] == 3 and n[6]["component_id"] == 5 and not n[6]["kept"]
    assert n[None]["component_id"] is None and n[None]["kept"]
    c = by_id(decontam.contamination(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect())
    assert (c[5]["n_hit"], c[5]["n_items"]) == (10, 1) and c[4]["n_hit"] == 1 and c[1]["n_words"] == 0 and not c[2]["contaminated"]
    assert c[None]["n_hit"] == 3 and c[None]["n_items"] == 1
    p = by_id(langid.predicted(df).collect())
    assert p[1]["lang_pred"] == p[3]["lang_pred"] == "und" and p[1]["score"] == 0
    e = by_id(pii.found(df).collect())
    assert e[9]["spans"] == "email:5:11,ip:15:23" and e[1]["spans"] == ""
    s = by_id(lm.scores(df).collect())
    assert s[1]["n_tokens"] == 1 and s[2]["score"] == s[1]["score"] < 0
    m = by_id(mixing.mixed(df).collect())
    assert m[1]["taken"] == 0 and m[2]["source_size"] == 10


def test_unique_keeps_one_of_each(spark):
    kept = [r["doc_id"] for r in neardup.unique(frame(spark)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 8, 9]))


def test_odd_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme/org/"), (4, "HTTP://EXAMPLE.ORG/es/x?y://z"), (4, "HTTP://EXAMPLE.ORG/es/x?y://z"), (None, "http://a.com"), (5, "x://com/de/"), (6, "http://notexample.org/es/"), (7, "http://x/" + "a" * 100_000)]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "place", "verdict")})
    rows = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urlfilter.judged(df).collect()]
    assert (1, "", None, "allow") in rows and (2, "", None, "allow") in rows and (3, "", None, "allow") in rows
    assert rows.count((4, "example.org", "example.org/es/", "block")) == 2 and (5, "com", "com/de/", "block") in rows
    assert (6, "notexample.org", "org/", "allow") in rows and len(rows) == len(urls)
    assert urlfilter.judged(df.limit(0)).count() == 0

"""The registered queries: all return their contract's columns, and equal SQL where they have it."""

from __future__ import annotations

import duckdb
import pytest

from folioloom.llm import queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard",
    "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3": "page_id host path rule verdict",
    "op4": "doc_id n_words n_hit n_items items_sha256 contaminated n_near",
    "op5": "doc_id n_shingles component_id kept",
    "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_id n_key",
    "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9": "limit n_docs total_tokens truncated_total quantile",
    "op10": "doc_id size source_size target taken",
    "op11": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12": "vec_id code error label_error codebooks_sha256",
    "op13": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


@pytest.mark.parametrize("name", queries.queries())
def test_columns(spark, name):
    df = queries.queries()[name](spark, DIR)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    table = {"op3": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    if name.split("_")[0] not in ("op9", "op13"):
        assert df.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DIR).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))

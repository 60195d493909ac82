"""Rounded scores against SQL as text, where -0.0 and 0.0 differ."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from folioloom.plans import registry

#: Vectors that, and whose differences to half of the next one, round to zero from below and above.
SMALL = ([2e-7, -2e-7, 0.0, 0.25] * 16, [6e-7, -6e-7, -4e-7, 0.1] * 16, [-3e-7] * 64, [0.29999995] * 64)


def same_text(spark, folder, name):
    columns = {"vec_id": pa.array(range(len(SMALL)), pa.int64()), "label": pa.array([0] * len(SMALL), pa.int32()), "embedding": pa.array(SMALL, pa.list_(pa.float32()))}
    pq.write_table(pa.table(columns), folder / "embeddings.parquet")
    got = [repr(tuple(r.asDict().values())) for r in registry.queries()[name](spark, str(folder)).orderBy("vec_id").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    want = [repr(r) for r in con.sql(f"FROM ({registry.oracle_sql()[name]}) ORDER BY vec_id").fetchall()]
    assert got == want
    assert "-0.0," in "".join(got) and " 0.0," in "".join(got)


def test_contrast_keeps_the_sign_of_zero(spark, tmp_path):
    same_text(spark, tmp_path, "cad_logits")


def test_decoder_steps_keep_the_sign_of_zero(spark, tmp_path):
    same_text(spark, tmp_path, "decoder_steps")


def test_penalized_scores_keep_the_sign_of_zero(spark, tmp_path):
    same_text(spark, tmp_path, "scd_penalty")

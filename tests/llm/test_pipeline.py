"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
import test_brute_force as B
from folioloom.llm import decontam, mixing, neardup, quality
from folioloom.llm.common import written

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    found = []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, DIR), f"test-{name}")
        found.append((docs, after))
        docs = after
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert all(after.columns == columns for _, after in found[:-1])
    before, after = found[0]
    assert ids(after) == ids(quality.verdicts(before).filter("kept"))
    before, after = found[1]
    assert ids(after) == ids(neardup.components(before).filter("kept"))
    before, after = found[2]
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert ids(after) == ids(decontam.contamination(before, items).filter("NOT contaminated"))
    before, after = found[3]
    assert ids(after) == Counter({r["doc_id"]: r["times"] for r in mixing.mixed(before).collect() if r["times"]})
    before, after = found[4]
    assert ids(after) == ids(before) and after.columns[: len(columns)] == columns
    again = corpus_pipeline.run(spark, DIR)
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect()))


def test_run_equals_brute_force(spark):
    """Every stage restated in plain Python, each on what the one before keeps: the rows, their numbers and their shards."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source", "text").collect()]
    kept = []
    for i, source, text in rows:
        words = B.WORDS.findall(text)
        n = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {j for k in range(len(words) - 7) if n[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        if len(words) >= 20 and 100 * len(inside) <= 30 * len(words) and B.plainly_kept(text)[3]:
            kept.append((i, source, text))
    gone, _ = B.near_copies([(i, t) for i, _, t in kept])
    index = B.item_windows([tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()])
    fresh = []
    for i, source, text in kept:
        words = B.TERM.findall(B.low(text))
        hit = any(tuple(words[k : k + n]) in index for n in {len(x) for x in index} for k in range(len(words) - n + 1))
        if i not in gone and not hit:
            fresh.append((i, source, text))
    times = B.plainly_mixed([(i, source, len(B.WORDS.findall(t))) for i, source, t in fresh])
    copies = [(i, t) for k, (i, _, t) in enumerate(fresh) for _ in range(times[k])]
    shards = B.plainly_sharded(spark, copies, 8)
    got = corpus_pipeline.run(spark, DIR).collect()
    assert len(kept) < len(rows) and gone and len(fresh) < len(kept) - len(gone) and got
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in got) == Counter((i, t, shards[i, t]) for i, t in copies)


def test_session_settings_stay(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    neardup.components(spark.read.parquet(f"{DIR}/documents.parquet").limit(3))
    assert [spark.conf.get(n) for n in names] == before
    spark.conf.set(names[0], "77")
    try:
        neardup.unique(spark.read.parquet(f"{DIR}/documents.parquet").limit(3))
        assert spark.conf.get(names[0]) == "77"
    finally:
        spark.conf.unset(names[0])


def test_odd_tables(spark):
    """Empty tables, nulls, repeated rows and ids, and clashing names go through all stages."""
    odd = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (4, "two " * 50, "en", "b", 3), (None, "no id " * 40, None, None, 0),
        *((10 + i, " ".join(f"w{(i * 31 + j * j) % 997}{'abc'[j % 3]}" for j in range(80)), "en", "c", 9) for i in range(30)), (99, "word " * 100_000, "fr", "c", 9),
    ]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"Shard_x": F.lit(1), "key": F.lit("k"), "comp": F.lit(2)})
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, DIR), f"odd-{name}")
            assert docs.columns[: len(columns)] == columns
        found = {r["doc_id"] for r in docs.collect()}
        assert found <= {10 + i for i in range(30)} and bool(found) == bool(rows)

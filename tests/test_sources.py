"""Files, Markdown, office documents, query sets and streams."""

from __future__ import annotations

import json
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import history, retrieval
from folioloom.sources import files, snapshots, store
from folioloom.streaming import live

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_docx(spark, tmp_path):
    p = lambda text, style=None: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    body = p("A Title", "Heading1") + p("") + "".join(p(f"line {i}") for i in range(45)) + p("Part", "Heading2")
    with zipfile.ZipFile(tmp_path / "My Doc.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    rows = files.docx_blocks(files.files_in(spark, str(tmp_path), "*.docx")).orderBy("block_idx").collect()
    assert len(rows) == 47 and rows[0]["font_size"] == 18.0 and rows[-1]["font_size"] == 14.0
    assert [r["page"] for r in rows].count(1) == 41 and rows[0]["doc"] == "my_doc"


def test_markdown(spark):
    text = "# T\n```\ncode line\n```\n| a |\n|---|\n- item here\nok\nlong enough"
    rows = files.markdown_blocks(spark.createDataFrame([("d", 0, text)], "doc string, page int, text string")).orderBy("block_idx").collect()
    assert [(r["block_type"], r["content"]) for r in rows] == [
        ("heading", "T"), ("code", "code line"), ("table", "| a |\n|---|"), ("list_item", "item here"), ("text", "long enough"),
    ]


def test_merge(spark):
    kind = "doc string, page int, idx int, content string, block_type string, font_size double, is_bold boolean"
    raw = spark.createDataFrame([("d", 0, 0, "alpha beta gamma delta", "text", 14.0, True), ("d", 0, 1, "x = y + z", "math", 10.0, False), ("d", 1, 0, "only raw", "text", 9.0, False)], kind)
    built = spark.createDataFrame([("d", 0, 0, "alpha beta other words", "text", 10.0, False)], kind)
    rows = {(r["page"], r["content"]): r for r in files.merged_blocks(raw, built).collect()}
    assert rows[0, "alpha beta other words"]["font_size"] == 14.0 and (0, "x = y + z") in rows and (1, "only raw") in rows and len(rows) == 3


def test_query_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query": "q1", "ground_truth": "PAPER_SPECIFIC", "applicable_papers": ["p"]}, {"query": " "}]))
    (tmp_path / "b.json").write_text(json.dumps({"queries": [{"query": "q2", "ground_truth": "g", "ground_truth_by_paper": {"p": "x"}}]}))
    rows = {r["query"]: r for r in files.query_sets(spark, str(tmp_path)).collect()}
    assert set(rows) == {"q1", "q2"} and rows["q1"]["ground_truth"] == "" and rows["q2"]["ground_truth_by_paper"] == {"p": "x"}


def test_store_replaces_documents(spark, tmp_path):
    kind, path = "collection string, doc string, content string", str(tmp_path / "s")
    held = lambda: {tuple(r) for r in store.chunks_in(spark, path).select("collection", "doc", "content").collect()}
    store.store_chunks(spark.createDataFrame([("a", "1", "x"), ("a", "1", "x2"), ("a", "2", "y"), ("7", "2", "z")], kind), path)
    store.store_chunks(spark.createDataFrame([("a", "1", "new"), ("a", "3", "w")], kind), path)
    store.store_chunks(spark.createDataFrame([], kind), path)
    assert held() == {("a", "1", "new"), ("a", "2", "y"), ("a", "3", "w"), ("7", "2", "z")}
    store.delete_documents(spark, path, spark.createDataFrame([("a", "1"), ("a", "9"), ("b", "1")], "collection string, doc string"))
    assert held() == {("a", "2", "y"), ("a", "3", "w"), ("7", "2", "z")}
    store.delete_collection(spark, path, "7")
    store.delete_documents(spark, path, spark.createDataFrame([("a", "2")], "collection string, doc string"))
    assert held() == {("a", "3", "w")}


KIND = "collection string, doc string, chunk_id string, content string"


def same_index(spark, path, rows):
    """The kept index of a store equals a fresh one of the rows (collection, doc, chunk_id, content)."""
    asked = spark.createDataFrame([(1, "sea ships"), (2, "and and old")], "item_id int, text string")
    fresh = retrieval.bm25(spark.createDataFrame(rows, KIND), asked, doc_key="chunk_id", doc_body="content").collect()
    assert sorted(map(tuple, retrieval.bm25(store.index_in(spark, path), asked).collect())) == sorted(map(tuple, fresh))
    merged = {(r.collection, r.term): r.df for r in store.frequencies_in(spark, path).collect()}
    counted = Counter((c, t) for c, _, _, text in rows for t in {"", *re.findall(r"\w+", text.lower())})
    assert merged == counted


def test_index_follows_the_store(spark, tmp_path):
    path = str(tmp_path / "s")
    rng, held = random.Random(1), {}
    words = "sea ships and old new harbour".split()
    for step in range(6):
        new = [(rng.choice("ab"), str(rng.randint(1, 6)), f"{step}-{i}", " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(5)]
        store.store_chunks(spark.createDataFrame(new, KIND), path, indexed=True)
        held = {k: v for k, v in held.items() if k not in {r[:2] for r in new}}
        for r in new:
            held.setdefault(r[:2], []).append(r)
        gone = rng.sample(sorted(held), 2)
        store.delete_documents(spark, path, spark.createDataFrame([*gone, ("b", "none")], "collection string, doc string"))
        held = {k: v for k, v in held.items() if k not in gone}
        if step == 3:
            before = snapshots.version(spark, path)
            assert len(snapshots.compact(spark, path).segments) == 1 < len(before.segments)
        if step in (0, 3, 5):
            same_index(spark, path, [r for rows in held.values() for r in rows])
    name = spark.range(1).select(T.index_file_name(F.lit("a")).alias("n")).first().n
    assert store.index_place("x", "a") == f"x/{name}"


def test_commits_are_whole(spark, tmp_path, monkeypatch):
    """A writer that dies leaves the version before; of two writers the second builds on the first one's version."""
    path = str(tmp_path / "s")
    put = lambda *rows: store.store_chunks(spark.createDataFrame(rows, KIND), path, indexed=True)
    held = lambda at=None: {(r.doc, r.content) for r in store.chunks_in(spark, path, at).collect()}
    put(("a", "1", "k1", "sea and ships"), ("a", "2", "k2", "old sea"))
    first = snapshots.version(spark, path)
    publish = snapshots.publish

    def dies(*_):
        raise OSError("no more")

    monkeypatch.setattr(snapshots, "publish", dies)
    with pytest.raises(OSError):
        put(("a", "1", "k3", "lost"))
    assert held() == {("1", "sea and ships"), ("2", "old sea")} and snapshots.versions(spark, path) == [1]
    interrupted = []

    def second(spark_, path_, new):
        if not interrupted:
            interrupted.append(1)
            monkeypatch.setattr(snapshots, "publish", publish)
            put(("a", "1", "k4", "ships"))  # another writer is first
        publish(spark_, path_, new)

    monkeypatch.setattr(snapshots, "publish", second)
    put(("a", "1", "k5", "harbour"), ("a", "3", "k6", "sea"))
    assert held() == {("1", "harbour"), ("2", "old sea"), ("3", "sea")} and snapshots.versions(spark, path) == [1, 2, 3]
    same_index(spark, path, [("a", "1", "k5", "harbour"), ("a", "2", "k2", "old sea"), ("a", "3", "k6", "sea")])
    assert held(first) == {("1", "sea and ships"), ("2", "old sea")}
    snapshots.roll_back(spark, path, 1)
    assert held() == held(first)
    snapshots.vacuum(spark, path, keep=1)
    assert snapshots.versions(spark, path) == [4] and held() == {("1", "sea and ships"), ("2", "old sea")}
    assert len(list((tmp_path / "s" / "chunks").iterdir())) == 1


def test_reads_are_pruned(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(f"c{i % 5}", str(i), f"k{i}", "text") for i in range(200)]
    store.store_chunks(spark.createDataFrame(rows, KIND), path)
    store.delete_documents(spark, path, spark.createDataFrame([("c1", "1")], "collection string, doc string"))
    one = store.chunks_in(spark, path, collections=["c1"], docs=["6", "1"])
    assert [r.doc for r in one.collect()] == ["6"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and all("at_collection" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    every = store.chunks_in(spark, path)._jdf.queryExecution().toRdd().getNumPartitions()
    files = lambda df: len(snapshots_files(df))
    assert files(store.chunks_in(spark, path, collections=["c1"])) * 4 < files(store.chunks_in(spark, path)) and every
    assert files(one) <= 4


def snapshots_files(df):
    """The files that a plan's scans of chunks read, after its partition filters."""
    scans, found = [df._jdf.queryExecution().executedPlan()], []
    while scans:
        node = scans.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            scans.append(node.executedPlan() if hasattr(node, "executedPlan") else node.inputPlan())
        elif node.nodeName().startswith("Scan parquet"):
            parts = node.selectedPartitions().toPartitionArray()
            found += [str(x.urlEncodedPath()) for x in parts if "/chunks/" in str(x.urlEncodedPath())]
        children = node.children()
        scans += [children.apply(i) for i in range(children.size())]
    return found


def test_document_json_round_trip(spark):
    blocks = spark.createDataFrame([("d", 0, "Title", 1, 18.0), ("d", 1, "Body", 2, 10.0)], "doc string, block_idx int, content string, page int, font_size double")
    documents = spark.createDataFrame([("d", "T", 2, {"doc_type": "paper"}), ("e", "U", 0, {})], "doc string, title string, total_pages int, metadata map<string,string>")
    stored = store.document_json(blocks, documents)
    assert json.loads({r.doc: r.document for r in stored.collect()}["e"])["blocks"] == []
    back = store.document_blocks(stored, "content string, page int, font_size double")
    assert sorted(map(tuple, back.select(*blocks.columns).collect())) == sorted(map(tuple, blocks.collect())) and back.first().total_pages == 2


def test_rates_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"2024-01-01 00:00:{i:02d}") for i in range(5)] + [(1, "2024-01-01 02:00:00")], "user_id int, ts string")
    rows.select("user_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.per_minute(source).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("rates").collect()) == [1, 5]


def test_ingest_stream(spark, tmp_path):
    """A document that arrives again, in its batch or a later one, is replaced; others stay; indexes follow."""
    kind = "collection string, doc string, section string, page int, text string"
    arrive = lambda rows, name: spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    source = lambda: spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, cp = (str(tmp_path / x) for x in ("out", "cp"))
    arrive([("c", "d1", "s", 1, "word " * 600), ("c", "d1", "s", 1, "word " * 600), ("c", "d2", "s", 1, "other " * 60)], "1")
    live.ingest(source(), out, cp, indexed=True).awaitTermination()
    assert store.chunks_in(spark, out).count() == 3
    arrive([("c", "d1", "s", 1, "later " * 70)], "2")
    live.ingest(source(), out, cp, indexed=True).awaitTermination()
    rows = store.chunks_in(spark, out).collect()
    assert sorted((r.doc, r.content.split()[0]) for r in rows) == [("d1", "later"), ("d2", "other")]
    assert {r.term for r in store.index_in(spark, out).postings.collect()} == {"later", "other"}
    arrive([("c", "d2", "s", 1, "too short")], "3")
    live.ingest(source(), out, cp).awaitTermination()
    assert [r.doc for r in store.chunks_in(spark, out).collect()] == ["d1"] and len(snapshots.version(spark, out).segments) == 3


def test_events_round_trip(spark):
    rows = spark.createDataFrame([(1, "A", "x" * 60, None), (2, "B", "", "failed")], "query_id int, route string, answer string, error string")
    events = live.answer_events(rows)
    assert [r["event"] for r in events.filter("query_id = 2").orderBy("seq").collect()] == ["metadata", "error"]
    back = {r["query_id"]: r for r in live.reassembled(events).collect()}
    assert back[1]["answer"] == "x" * 60 and back[1]["complete"] and not back[2]["complete"]


REQUESTS = "worker int, request_id long, arrived double, duration double"


def test_gate(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 40.0), (1, 2, 1.0, 5.0), (1, 3, 20.0, 500.0), (1, 4, 150.0, 1.0), (2, 5, 0.0, 1.0)], REQUESTS)
    got = {r["request_id"]: (r["start"], r["accepted"], r["reason"]) for r in live.waiting(rows).collect()}
    assert got == {1: (0.0, True, None), 2: (40.0, False, "busy"), 3: (40.0, True, "timeout"), 4: (160.0, True, None), 5: (0.0, True, None)}


def test_gate_keeps_its_place_between_batches(spark, monkeypatch):
    """A worker's requests in one batch, in many, and over a stream."""
    import random

    rng = random.Random(3)
    rows = [(rng.randint(1, 3), i, float(rng.randint(0, 4000)), float(rng.choice((2, 9, 30, 300)))) for i in range(600)]
    expected = set()
    for w in (1, 2, 3):
        found, _ = live.gated(sorted((a, i, d) for x, i, a, d in rows if x == w), 0.0, 29.0, 120.0)
        expected |= {(w, *x) for x in found}
    df = spark.createDataFrame(rows, REQUESTS)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", old):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {tuple(r) for r in live.waiting(df).collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def streamed(spark, tmp_path, name, parts, kind, through):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / name / str(i)))
    source = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = through(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    return spark.table(name).collect(), held


def test_gate_over_a_stream(spark, tmp_path):
    """Requests that come late, but within the watermark, are taken in their order; the state goes."""
    parts = [[(1, 2, 30.0, 5.0), (1, 1, 1.0, 40.0)], [(2, 4, 31.0, 1.0), (1, 3, 20.0, 5.0), (1, 5, 85.0, 1.0)], [(3, 9, 9000.0, 1.0)], [(3, 10, 19000.0, 1.0)]]
    rows, held = streamed(spark, tmp_path, "gate", parts, REQUESTS, lambda s: live.waiting(s, late="1 minute"))
    whole = live.waiting(spark.createDataFrame([r for p in parts for r in p], REQUESTS)).collect()
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in whole if r.request_id != 10) and len(rows) == 6
    assert held == 1  # the last worker's only


def test_answers_over_a_stream(spark, tmp_path):
    token = lambda q, n, text, t: (q, n, "token", json.dumps({"content": text}), t)
    kind = "query_id int, seq int, event string, payload string, happened double"
    parts = [
        [token(1, 2, "b", 2.0), (1, 3, "done", "{}", 3.0), token(2, 1, "x", 1.0)], [(1, 0, "metadata", "{}", 0.5), token(1, 1, "a", 1.0), token(1, 1, "a", 1.0)],
        [token(1, 2, "b", 4.0), (2, 0, "metadata", "{}", 0.4), token(2, 3, "z", 5.0), (2, 4, "done", "{}", 6.0)], [(9, 0, "metadata", "{}", 900.0)], [(9, 1, "done", "{}", 2000.0)],
    ]
    through = lambda s: live.reassembled_stream(s.withColumn("ts", F.timestamp_seconds("happened")), late="1 minute", silence=30.0)
    rows, held = streamed(spark, tmp_path, "answers", parts, kind, through)
    assert sorted(map(tuple, rows)) == [(1, "ab", True), (2, "x", False), (9, "", True)] and held == 1


def test_repair(spark):
    kind = "user_id int, collection string, doc string, doc_type string, updated_at int"
    rows = spark.createDataFrame([(1, "c", "d", None, 1), (1, "c", "d", "patent", 2), (None, "c", "d", "paper", 3)], kind)
    assert [tuple(r) for r in history.repaired(rows).select("user_id", "doc_type", "updated_at").collect()] == [(1, "patent", 2)]


def test_blocks_of_whole_pages_equal_those_of_spans(spark):
    """Spans were shuffled one row a word; a page's are cut into blocks within its row."""
    rows = [(1, 1, b, s, t, f, 9.0 + s, s == 1) for b, s, t, f in [(0, 0, "one two", "Times"), (0, 1, "three", "CMSY10"), (1, 3, "zz", "CMSY10"), (1, 2, "yyyyy", "Times"), (2, 4, "abc", "Times"), (7, 5, " ", "Times")]]
    spans = spark.createDataFrame(rows, "doc int, page int, block_no int, span_no int, text string, font string, size double, bold boolean")
    pages = spans.groupBy("doc", "page").agg(F.collect_list(F.struct("block_no", "span_no", "text", "font", "size", "bold")).alias("spans"))
    made = files.page_span_blocks(pages)
    assert sorted(made.collect()) == sorted(files.span_blocks(spans).select(*made.columns).collect())
    from folioloom.plans import queries_library

    assert "Exchange" not in queries_library.span_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_postings_of_a_chunk_are_one_row(spark, tmp_path):
    """Each posting was a row with its chunk's keys, written twice and shuffled at every commit."""
    path = str(tmp_path / "s")
    rows = [("a", "1", "k1", "sea and sea"), ("a", "2", "k2", ""), ("b", "2", "k3", "old")]
    store.store_chunks(spark.createDataFrame(rows, KIND), path, indexed=True)
    store.store_chunks(spark.createDataFrame(rows[:1], KIND), path)
    assert [s.rows[store.POSTINGS] for s in snapshots.version(spark, path).segments] == [3, 1]
    index = store.index_in(spark, path)
    assert index.bags.count() == 3 and {(r.doc, r.term, r.tf) for r in index.postings.collect()} == {("k1", "sea", 2), ("k1", "and", 1), ("k3", "old", 1)}
    same_index(spark, path, rows)


def test_gate_keeps_workers_together(spark, tmp_path, monkeypatch):
    """Each worker had its own state and its own call in each batch."""
    monkeypatch.setattr(live, "WORKER_GROUPS", 2)
    parts = [[(w, 1000 * n + 10 * w + i, 1.0 + 3.0 * i + w % 7 + 1000.0 * n, 9.0 if i else 200.0) for w in range(40) for i in range(5)] for n in range(3)] + [[(99, 9999, 9000.0, 1.0)], [(99, 10000, 19000.0, 1.0)]]
    rows, held = streamed(spark, tmp_path, "groups", parts, REQUESTS, lambda s: live.waiting(s, late="1 minute"))
    whole = live.waiting(spark.createDataFrame([r for p in parts for r in p], REQUESTS)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted((tuple(r) for r in whole if r.request_id != 10000), key=str) and held == 1

"""Text expressions against plain Python on the shared documents and on made-up strings."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from folioloom.functions import patterns as P
from folioloom.functions import text as T
from folioloom.operators import chunking, context, decoding, evaluation, retrieval, routing, sections
from folioloom.plans import fixtures as X

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


def test_scalars(docs):
    t = F.col("text")
    for r in docs.select("text", T.tokens(t).alias("k"), T.words(t).alias("w"), T.sentences(t).alias("s")).collect():
        assert r["k"] == re.findall(r"\w+", r["text"].lower())
        assert r["w"] == r["text"].split()
        assert r["s"] == re.split(r"(?<=[.!?。])\s+", r["text"])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,lang", [("한국어 문장으로 구성된 검색 청크입니다.", "ko"), ("An English sentence about retrieval.", "en"), ("", "en")])
def test_language(spark, text, lang):
    assert one(spark, T.detect_lang(F.lit(text))) == lang


@pytest.mark.parametrize(
    "text,numbers",
    [("정확도 92.5% 와 1,200개 샘플, 3 runs", {"92.5", "1200"}), ("2024년 50개의", set()), ("8GB and 16GB, 9.5 points", {"16", "9.5"}), ("none", set())],
)
def test_numbers(spark, text, numbers):
    assert set(one(spark, T.numbers(F.lit(text)))) == numbers


def test_windows_cover_every_word(docs):
    chunks = chunking.windows(docs.select(F.col("doc_id").alias("doc"), F.lit("s").alias("section"), "text"))
    by_doc = {}
    for r in chunks.collect():
        by_doc.setdefault(r["doc"], []).append((r["char_start"], r["char_end"], r["content"]))
    for r in docs.collect():
        words = r["text"].split()
        expected, start = [], 0
        if len(words) <= 512:
            expected = [(0, 0, r["text"])] if len(words) >= 50 else []
        else:
            while start < len(words):
                end = min(start + 512, len(words))
                if end - start >= 50:
                    expected.append((start, end, " ".join(words[start:end])))
                if end >= len(words):
                    break
                start += 448
        assert sorted(by_doc.get(r["doc_id"], [])) == expected


def test_sentence_groups(docs):
    for r in docs.select("text", chunking.sentence_groups(F.col("text"), 100, 20).alias("g")).collect():
        groups, now, n = [], [], 0
        for s in re.split(r"(?<=[.!?])\s+", r["text"]):
            k = len(s.split())
            if n + k > 100 and now:
                groups.append(" ".join(now))
                now, n = [], 0
            now.append(s)
            n += k
        groups.append(" ".join(now))
        assert r["g"] == [g for g in groups if len(g.split()) >= 20]


@pytest.mark.parametrize(
    "query,route,section,confidence",
    [
        ("이 논문의 방법론은 무엇인가요?", "B", "method", 1 / 3), ("실험 결과를 알려줘", "B", "result", 2 / 3), ("doc1과 doc2를 비교해줘", "C", None, 1 / 3),
        ("이 논문에서 사용한 데이터셋이 뭐야?", "A", None, 0.5), ("방법론 설명해줘", "B", "method", 1 / 3), ("두 논문의 정확도 차이를 비교해줘", "C", None, 2 / 3),
        ("이 논문 전체 요약해줘", "E", None, 2 / 3), ("인용 논문들 분석해줘", "D", None, 1 / 3), ("overview", "B", "abstract", 1 / 3),
    ],
)
def test_routes(spark, query, route, section, confidence):
    r = one(spark, routing.route(F.lit(query)))
    assert (r["route"], r["section"]) == (route, section) and r["confidence"] == pytest.approx(confidence)


def test_foreign_tokens(spark):
    tokens = ["가", "ㄱ", " ", "1", ".", "a", "A", "α", ""]
    out = one(spark, decoding.penalized(F.array(*[F.lit(1.0)] * 9), F.array(*map(F.lit, tokens)), 0.3))
    assert out == pytest.approx([1, 1, 1, 1, 1, 0.7, 0.7, 0.7, 1])


@pytest.mark.parametrize("n,order", [(1, [0]), (2, [0, 1]), (3, [0, 2, 1]), (5, [0, 2, 4, 3, 1]), (6, [0, 2, 4, 5, 3, 1])])
def test_zigzag(spark, n, order):
    rows = spark.range(n).select("id", retrieval.zigzag(F.col("id"), F.lit(n)).alias("p")).orderBy("p").collect()
    assert [r["id"] for r in rows] == order


def test_labels(spark):
    score = lambda v, strict=False: one(spark, evaluation.label_score(F.lit(v), strict))
    assert score("UNSUPPORTED") == 1.0 and score("UNSUPPORTED", True) == 0.0
    assert score("partial") == 0.5 and score("0.75 of it") == 0.75 and score("12") == 0.5 and score("NOISY") == 0.0


def test_compression_against_python(spark, docs):
    hits = docs.limit(40).select(F.lit(1).alias("query"), F.lit("the of and in that").alias("query_text"), F.col("doc_id").alias("doc"), "text")
    asked = {"the", "of", "and", "in", "that"}
    rows = context.compress(hits).collect()
    assert sum(len(r["text"].split()) for r in rows) > context.BUDGET
    for r in rows:
        sentences = re.split(r"(?<=[.!?。])\s+", r["text"])
        scored = sorted(((s, len(asked & set(s.lower().split())) / max(len(set(s.lower().split())), 1)) for s in sentences), key=lambda x: -x[1])
        goal, n, kept = int(len(r["text"].split()) * 0.5), 0, set()
        for s, _ in scored:
            if n + len(s.split()) > goal:
                break
            kept.add(s)
            n += len(s.split())
        expected = " ".join(s for s in dict.fromkeys(sentences) if s in kept) or r["text"][:500]
        assert r["content"] == expected and r["compressed"]


def test_budget_is_kept(spark):
    rows = [(1, i, "w " * n) for i, n in enumerate([1000, 1500, 700, 5])]
    df = spark.createDataFrame(rows, "query int, position int, text string")
    out = context.truncate(df).orderBy("position").collect()
    assert [len(r["content"].split()) for r in out] == [1000, 1500, 572] and out[-1]["truncated"]


def test_ids_and_names(spark):
    assert one(spark, T.document_id(F.lit("My Paper v1.2.PDF"))) == "my_paper_v1.2"
    assert one(spark, T.collection_name(F.lit("3d models"))) == "col_3d_models"
    assert one(spark, T.collection_name(F.lit("x" * 80))) == "x" * 63
    assert one(spark, T.metric_text(F.lit(None).cast("double"))) == "N/A"
    assert one(spark, T.pieces(F.lit("a" * 50))) == ["a" * 24, "a" * 24, "aa"]


def test_sections(spark):
    from folioloom.operators import sections

    rows = sections.with_sections(X.BLOCKS.forms.df(spark)).collect()
    got = {(r["doc"], r["block_idx"]): r["section_type"] for r in rows}
    assert [got["p1", i] for i in (1, 3, 5, 7, 8, 10)] == ["abstract", "introduction", "method", "method", "result", "conclusion"]
    assert [got["p1", i] for i in (12, 13, 14)] == ["references"] * 3 and got["p1", 15] != "references"
    assert got["l1", 2] == "definition" and got["l1", 5] == "exercise" and got["k1", 5] == "claims"


@pytest.mark.parametrize(
    "heading,section",
    [
        ("1. 서 론", "introduction"), ("2. 관 련 연 구", "related_work"), ("3. 방 법", "method"), ("참 고 문 헌", "references"), ("Abstract", "abstract"),
        ("1 Introduction", "introduction"), ("2 Data Foundations", "method"), ("5 Evaluation", "result"), ("References", "references"),
    ],
)
def test_headings(spark, heading, section):
    from folioloom.operators import sections

    assert one(spark, sections.heading_section(sections.heading_spellings(F.lit(heading)), F.lit("paper"))) == section


def test_fusion_is_a_permutation(spark):
    d = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query int, doc string, rank int")
    s = spark.createDataFrame([(1, "c", 0), (1, "a", 1)], "query int, doc string, rank int")
    out = retrieval.fuse(d, s).orderBy("rank").collect()
    assert [r["doc"] for r in out] == ["a", "b", "c"]
    assert out[0]["rrf_score"] == pytest.approx(0.6 / 61 + 0.4 / 62, abs=1e-8)


def test_sections_need_one_sort_and_few_tables_a_task(spark):
    """Types and fonts were joined back over two sorts of all blocks, and trees and cited works made all of it anew for each branch."""
    rows = sections.with_sections(X.BLOCKS.forms.df(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and "SortMergeJoin" not in plan
    tree = chunking.summary_tree(chunking.by_section(rows, least=3))
    assert "Window" not in tree.filter("chunk_level < 2")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["a  b", " 참 고\n문 헌 ", "US 1234567", "us12345678", "KR 10-2020-0012345", "EBNF", "제 3 장", "Claim 7", "nothing here", "가 나 다"])
def test_signals_need_no_more_than_their_patterns(spark, text):
    row = spark.createDataFrame([(text,)], "sample string").withColumn("lower", F.lower("sample"))
    got = row.select(*(sections.signals(k).alias(k) for k in P.SIGNALS)).first().asDict()
    assert got == row.select(*(F.regexp_count("sample", F.lit(p)).alias(k) for k, p in P.SIGNALS.items())).first().asDict()
    plain = F.regexp_replace(F.trim(F.regexp_replace("sample", r"\s+", " ")), T.BETWEEN_HANGUL, "")
    assert row.select(T.match_text(F.col("sample")) == plain).first()[0]

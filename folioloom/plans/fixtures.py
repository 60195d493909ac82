"""Forms that the shared tables don't hold (references, markup, questions), planted into their rows, in Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A number for each row of conversations, and the same as an id.
TURN = "b.conv_id * 100 + b.turn"
TURN_ID = f"CAST({TURN} AS INT)"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x) + ("::DOUBLE" if isinstance(x, float) else "")
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


class Rows:
    """A named table of literal rows: columns as Spark DDL."""

    def __init__(self, name: str, columns: str, rows: list[tuple]):
        self.name, self.columns, self.rows = name, columns, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    @property
    def cte(self) -> str:
        """name(columns) AS (VALUES ...)."""
        names = ", ".join(c.strip().split()[0] for c in self.columns.split(", "))
        return f"{self.name}({names}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in self.rows)})"


    def over(self, base: str, key: str, /, where: str = "true", on: str | None = None, distinct: bool = False, **columns: str | tuple[str, str]) -> Planted:
        """These rows planted into those of a shared table: each row of base (as b) meets the one (as x) that its key, a whole
        number, leads to, or those that `on` names. columns: expressions that hold in Spark and SQL, or one for each."""
        return Planted(self, base, f"({key}) % {len(self.rows)} = x.form_no" if on is None else on, where, distinct, columns)


class Planted:
    """The rows of a shared table with forms planted into them."""

    def __init__(self, forms: Rows, base: str, on: str, where: str, distinct: bool, columns: dict):
        self.forms, self.base, self.on, self.where, self.distinct = forms, base, on, where, distinct
        self.columns = {c: x if isinstance(x, tuple) else (x, x) for c, x in columns.items()}

    def df(self, spark: SparkSession, d: str) -> DataFrame:
        forms = spark.createDataFrame([(*r, i) for i, r in enumerate(self.forms.rows)], self.forms.columns + ", form_no int").alias("x")
        base = spark.read.parquet(f"{d}/{self.base}.parquet").alias("b").filter(self.where)
        rows = base.join(F.broadcast(forms), F.expr(self.on)).select(*(F.expr(e).alias(c) for c, (e, _) in self.columns.items()))
        return rows.distinct() if self.distinct else rows

    @property
    def cte(self) -> str:
        """The forms, and name AS (SELECT ...)."""
        name = self.forms.name
        names = ", ".join(c.strip().split()[0] for c in self.forms.columns.split(", "))
        values = ", ".join("(" + ", ".join(map(literal, r)) + f", {i})" for i, r in enumerate(self.forms.rows)).replace("\n", "' || chr(10) || '")
        columns = ", ".join(f"{e} AS {c}" for c, (_, e) in self.columns.items())
        distinct = "DISTINCT " if self.distinct else ""
        return f"{name}_forms({names}, form_no) AS (VALUES {values}), {name} AS (SELECT {distinct}{columns} FROM {self.base} b JOIN {name}_forms x ON {self.on} WHERE {self.where})"


PAPER_LINES = [
    ("p1", 0, "Sparse Attention for Long Papers", 0, 18.0, True, "heading"), ("p1", 1, "Abstract", 0, 14.0, True, "heading"),
    ("p1", 2, "We study attention over long documents and report what it costs.", 0, 10.0, False, "text"),
    ("p1", 3, "1. Introduction", 0, 12.0, False, "text"), ("p1", 4, "Long inputs are slow to read and hard to search in practice today.", 0, 10.0, False, "text"),
    ("p1", 5, "2 Proposed Approach", 1, 12.0, False, "text"), ("p1", 6, "x = a + b", 1, 10.0, False, "math"),
    ("p1", 7, "The approach keeps a window around each word of the input, and a few words for all.", 1, 10.0, False, "text"),
    ("p1", 8, "3 Evaluation", 2, 12.0, False, "text"), ("p1", 9, "Scores rise by 2.5 points over 1,200 documents.", 2, 10.0, False, "text"),
    ("p1", 10, "4 Conclusion", 3, 12.0, False, "text"), ("p1", 11, "Windows suffice.", 3, 10.0, False, "text"),
    ("p1", 12, "[1] Vaswani, A. et al. (2017). \"Attention Is All You Need.\" NeurIPS 2017. arXiv:1706.03762", 3, 10.0, False, "text"),
    ("p1", 13, "[2] Devlin, J. et al. Bidirectional encoders, 2019.", 3, 10.0, False, "text"),
    ("p1", 14, "[3] Lewis, P. et al. Retrieval for generation, 2020.", 3, 10.0, False, "text"),
    ("p1", 15, "Author Biography", 4, 10.0, False, "text"),
    ("l1", 0, "Lecture 4: Formal Languages", 0, 18.0, True, "heading"), ("l1", 1, "Definition 1", 0, 12.0, True, "text"),
    ("l1", 2, "A grammar is a set of rules.", 0, 10.0, False, "text"), ("l1", 3, "Theorem 2", 0, 12.0, True, "text"),
    ("l1", 4, "Proof", 0, 12.0, True, "text"), ("l1", 5, "Exercise 3", 1, 12.0, True, "text"),
    ("k1", 0, "Title of the Invention", 0, 12.0, True, "text"), ("k1", 1, "A device with an embodiment of the invention.", 0, 10.0, False, "text"),
    ("k1", 2, "Background Art", 0, 12.0, True, "text"), ("k1", 3, "A patent names prior art such as US 10,000,000 \"Lens array\".", 0, 10.0, False, "text"),
    ("k1", 4, "Claims", 1, 12.0, True, "text"), ("k1", 5, "Claim 1 protects the device.", 1, 10.0, False, "text"),
    ("g1", 0, "Chapter 1", 0, 14.0, True, "heading"), ("g1", 1, "Appendix", 0, 12.0, True, "text"), ("g1", 2, "Tables.", 0, 10.0, False, "text"),
]
BLOCKS = Rows("blocks", "doc string, block_idx int, content string, page int, font_size double, is_bold boolean, block_type string", PAPER_LINES)
#: Each document as a paper, a lecture, a patent or a report, with its own words in the body.
BLOCKS = BLOCKS.over(
    "documents", "b.doc_id", on="x.doc = CASE b.doc_id % 4 WHEN 0 THEN 'p1' WHEN 1 THEN 'l1' WHEN 2 THEN 'k1' ELSE 'g1' END",
    doc="x.doc || '_' || CAST(b.doc_id AS STRING)", block_idx="x.block_idx",
    content="CASE WHEN length(x.content) > 60 AND substr(x.content, 1, 1) <> '[' THEN x.content || ' ' || replace(substr(b.text, 1, 160), chr(10), ' ') ELSE x.content END",
    page="x.page", font_size="x.font_size", is_bold="x.is_bold", block_type="x.block_type",
)
QUESTIONS = Rows("questions", "query_id int, query string", [
    (1, "이 논문의 방법론은 무엇인가요?"), (2, "실험 결과를 알려줘"), (3, "doc1과 doc2를 비교해줘"), (4, "이 논문에서 사용한 데이터셋이 뭐야?"), (5, "방법론 설명해줘"),
    (6, "두 논문의 정확도 차이를 비교해줘"), (7, "이 논문 전체 요약해줘"), (8, "인용 논문들 분석해줘"), (9, "overview"), (10, "What is the accuracy and F1 score?"),
    (11, "Make a quiz with flashcard exercise"), (12, ""),
])
#: Questions of each kind, every other one with the words of a turn.
QUESTIONS = QUESTIONS.over("conversations", TURN, query_id=TURN_ID, query="CASE WHEN b.turn % 2 = 0 THEN x.query ELSE x.query || ' ' || b.text END")

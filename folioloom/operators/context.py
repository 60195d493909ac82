"""What a generator reads: extractive compression, budgets, source lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.functions import text as T

BUDGET, RATIO, WHOLE_CLIP, LEAST_REST = 3072, 0.5, 500, 50


def compress(hits: DataFrame, budget: int = BUDGET, ratio: float = RATIO) -> DataFrame:
    """hits (query, query_text, doc, text) with content and compressed.

    If a query's texts exceed the budget, each keeps its sentences most like the query: by score, until the next would
    exceed the ratio of its words; then in text order, each distinct sentence once. A text of which nothing fits is
    clipped. Sentences are scored, ordered and summed within their row, so only the query's total needs a shuffle.
    """
    n = T.word_count(F.col("text"))
    sized = hits.withColumns({"words_": n, "total_": F.sum(n).over(Window.partitionBy("query"))})
    asked = F.array_distinct(T.words(F.lower(F.col("query_text"))))
    sized = sized.withColumns({"goal_": F.floor(F.col("words_") * ratio), "asked_": asked, "sentences_": T.sentences(F.col("text"))})
    scored = F.transform(
        "sentences_",
        lambda s, i: F.struct((-T.overlap_score(F.col("asked_"), s)).alias("order"), i.alias("pos"), T.word_count(s).alias("n"), s.alias("s")),
    )
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("upto"), none.alias("kept"))

    def step(state, x):
        fits = state["upto"] + x["n"] <= F.col("goal_")
        # counts are never negative, so once one overflows all later ones do
        return F.struct((state["upto"] + x["n"]).alias("upto"), F.when(fits, F.array_append(state["kept"], x["s"])).otherwise(state["kept"]).alias("kept"))

    sized = sized.withColumn("kept_", F.when(F.col("total_") > budget, F.aggregate(F.array_sort(scored), start, step)["kept"]))
    shown = F.filter(F.array_distinct("sentences_"), lambda s: F.array_contains("kept_", s))
    cut = F.when(F.size("kept_") > 0, F.array_join(shown, " ")).otherwise(F.substring("text", 1, WHOLE_CLIP))
    long = F.col("total_") > budget
    out = sized.withColumns({"content": F.when(long, cut).otherwise(F.col("text")), "compressed": long})
    return out.drop("words_", "total_", "goal_", "asked_", "sentences_", "kept_")


def truncate(hits: DataFrame, budget: int = BUDGET, body: str = "text", order: str = "position") -> DataFrame:
    """hits (query, order, text) cut to the budget in order: whole texts while they fit; of the first that doesn't, what
    is left if that is over 50 words."""
    sized = hits.withColumn("words", T.word_count(F.col(body)))
    upto = F.sum("words").over(Window.partitionBy("query").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sized = sized.withColumn("upto", upto)
    before = F.col("upto") - F.col("words")
    rest = F.lit(budget) - before
    whole = F.col("upto") <= budget
    part = (before <= budget) & (rest > LEAST_REST)
    cut = F.array_join(F.slice(T.words(F.col(body)), F.lit(1), F.greatest(rest, F.lit(1)).cast("int")), " ")
    return sized.filter(whole | part).withColumns({"content": F.when(whole, F.col(body)).otherwise(cut), "truncated": ~whole}).drop("upto")


def joined(hits: DataFrame, by: str, order: str, body: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """One text for each group, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(body).alias("body_"))))
    return hits.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["body_"]), separator).alias("context"))


def source_lines(hits: DataFrame, by: str = "query", order: str = "position") -> DataFrame:
    """Numbered sources of each query: [i] doc - section (p.N)."""
    ranked = hits.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    line = F.format_string("[%d] %s - %s (p.%d)", F.col("i"), F.col("doc").cast("string"), F.col("section"), F.col("page"))
    return joined(ranked.withColumn("line", line), by, "i", "line", "\n").withColumnRenamed("context", "sources")

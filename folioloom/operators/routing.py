"""Which pipeline answers a question, over which sections and documents, and what else it asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import patterns as P
from folioloom.functions import text as T


def route(query: Column) -> Column:
    """struct<route, section, keyword, score, confidence>: the kind with most keywords in the question, the first on a
    tie; A at confidence 0.5 without any."""
    low = F.trim(F.lower(query))
    kinds = [
        F.struct(F.lit(-i).alias("first"), F.lit(k).alias("keyword"), F.array(*map(F.lit, words)).alias("words"))
        for i, (k, words) in enumerate(P.ROUTES.items())
    ]
    hits = lambda words: F.size(F.filter(words, lambda w: F.contains(low, w)))
    scores = F.transform(F.array(*kinds), lambda k: F.struct(hits(k["words"]).alias("score"), k["first"], k["keyword"]))
    letters = F.create_map(*(F.lit(x) for pair in P.LETTER.items() for x in pair))
    parts = F.create_map(*(F.lit(x) for pair in P.SECTION_OF.items() for x in pair))

    def decided(best: Column) -> Column:
        none = best["score"] == 0
        return F.struct(
            F.when(none, "A").otherwise(F.coalesce(F.try_element_at(letters, best["keyword"]), F.lit("B"))).alias("route"),
            F.when(~none, F.try_element_at(parts, best["keyword"])).alias("section"), F.when(~none, best["keyword"]).alias("keyword"),
            best["score"].alias("score"), F.when(none, 0.5).otherwise(F.least(best["score"] / F.lit(3.0), F.lit(1.0))).alias("confidence"),
        )

    return F.get(F.transform(F.array(F.array_max(scores)), decided), F.lit(0))


def compare_targets(queries: DataFrame, docs: DataFrame, ordinal: str = "doc_no") -> DataFrame:
    """query_id and targets: the documents (doc, doc_no) of the query's collection that its text names, with or without
    underscores; the first two of the collection if it names fewer than two. Both have the column collection, so texts
    are only compared within one."""
    pairs = queries.join(docs, "collection")
    low = F.lower(F.col("query"))
    named = F.contains(low, F.lower("doc")) | F.contains(low, F.replace(F.lower(F.col("doc")), F.lit("_"), F.lit(" ")))
    found = pairs.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(named, F.struct(ordinal, "doc")))).alias("named"),
        F.slice(F.array_sort(F.collect_list(F.struct(ordinal, "doc"))), 1, 2).alias("first"),
    )
    chosen = F.when(F.size("named") < 2, F.col("first")).otherwise(F.col("named"))
    return found.select("query_id", F.transform(chosen, lambda x: x["doc"]).alias("targets"))


def description(letter: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in P.DESCRIPTION.items() for x in pair))
    return F.coalesce(F.element_at(table, letter), F.lit("🔍 기본 검색"))


def section_label(section: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in P.SECTION_LABEL.items() for x in pair))
    return F.coalesce(F.element_at(table, F.coalesce(section, F.lit(""))), section, F.lit("해당"))


def quiz_mode(query: Column) -> Column:
    return F.when(T.keyword_hits(F.lower(query), P.FLASHCARDS) > 0, "flashcard").otherwise("quiz")


def wants_similar_patents(query: Column) -> Column:
    return query.rlike(P.SIMILAR_PATENT)


def effective_section(requested: Column, routed: Column) -> Column:
    return F.coalesce(F.nullif(requested, F.lit("")), routed)


def expanded(query: Column, reply: Column, most: int) -> Column:
    """The question and the distinct further ones of a reply, a line each without numbering, `most` + 1 at most."""
    lines = F.transform(F.split(F.trim(reply), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d+[.)]\s*", "")))
    return F.slice(F.array_distinct(F.concat(F.array(query), F.filter(lines, lambda x: x != ""))), 1, most + 1)


def translated(query: Column, reply: Column) -> Column:
    """The reply to a request for translation, if the question isn't ASCII and the reply is new; else null."""
    text = F.trim(reply)
    return F.when(~T.is_ascii(query) & (text != "") & (text != query), text)


def follow_ups(query: Column, reply: Column, templates: Column, more: Column, count: int = 3) -> Column:
    """`count` questions: the reply's lines without numbering or bullets that are over five characters and not the
    question; then templates that the question doesn't hold, all templates if those are too few, then others'. The order
    is fixed, so reruns agree."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^\d+[.)]\s*", ""), r"^[-•*]\s*", ""))
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), bare)
    asked = F.slice(F.filter(lines, lambda x: (F.length(x) > 5) & (x != query)), 1, count)
    fresh = F.filter(templates, lambda t: ~F.contains(F.lower(query), F.lower(t)))
    filling = F.when(F.size(fresh) < count, templates).otherwise(fresh)
    filled = F.slice(F.array_distinct(F.concat(filling, more)), 1, count)
    return F.when(F.size(asked) > 0, asked).otherwise(filled)

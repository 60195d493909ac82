"""Chunks: overlapping word windows, section runs, sentence groups, and a three-level summary tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.functions import text as T
from folioloom.operators.tables import materialized

SIZE, OVERLAP, LEAST = 512, 64, 50
STRUCTURED = ("code", "table", "math")
MATH_ANCHOR = " [수식 참조]"


def window_starts(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Word offsets at which windows over n words start; the last one reaches the end."""
    step = size - overlap if size > overlap else max(size // 2, 1)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") * step
    return F.sequence(F.lit(0), last, F.lit(step))


def windows(texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """texts (doc, section, page, text, and any order columns) as chunks: content, char_start and char_end in words (both
    0 for a text that isn't split), chunk_id. Chunks under `least` words are left out."""
    split = texts.withColumn("w", T.words(F.col("text"))).withColumn("n", F.size("w"))
    each = split.withColumn("char_start", F.explode(window_starts(F.col("n"), size, overlap)))
    whole = F.col("n") <= size
    end = F.least(F.col("char_start") + size, F.col("n"))
    content = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice("w", F.col("char_start") + 1, size), " "))
    each = each.withColumns({"content": content, "char_end": F.when(whole, 0).otherwise(end), "words": end - F.col("char_start")})
    each = each.filter(F.col("words") >= least)
    return each.withColumn("chunk_id", T.chunk_id(F.col("doc"), F.col("section"), F.col("char_start"), F.col("content"))).drop("w", "n", "text")


def section_texts(blocks: DataFrame) -> DataFrame:
    """blocks (doc, block_idx, content, page, block_type, section_type) as texts: runs of one section, cut at structured
    blocks, which stand alone. An island ends wherever the section changes or a structured block begins or ends."""
    order = Window.partitionBy("doc").orderBy("block_idx")
    rows = blocks.filter("block_type <> 'image'")
    structured = F.col("block_type").isin(*STRUCTURED)
    rows = rows.withColumn("structured", structured)
    before = F.lag(F.struct("section_type", "structured")).over(order)
    new = before.isNull() | (before["section_type"] != F.col("section_type")) | before["structured"] | F.col("structured")
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.array_sort(F.collect_list(F.struct("block_idx", "content")))
    runs = rows.groupBy("doc", "run").agg(
        F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("text"), F.min_by("page", "block_idx").alias("page"),
        F.first("section_type").alias("section"), F.first("structured").alias("structured"), F.min_by("block_type", "block_idx").alias("kind"),
    )
    following = F.lead(F.struct("kind", "section")).over(Window.partitionBy("doc").orderBy("run"))
    near_math = (following["kind"] == "math") & (following["section"] == F.col("section"))
    return runs.withColumn("before_math", F.coalesce(near_math, F.lit(False)) & ~F.col("structured"))


def by_section(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks that cross no section boundary; structured blocks are kept whole whatever their size. The chunk before a
    formula says so at its end, after its id was made. The runs are written, as both kinds are made of them."""
    runs = materialized(section_texts(blocks), "runs")
    free = windows(runs.filter("NOT structured"), size, overlap, least)
    last = F.row_number().over(Window.partitionBy("doc", "run").orderBy(F.col("char_start").desc())) == 1
    free = free.withColumn("content", F.when(F.col("before_math") & last, F.concat("content", F.lit(MATH_ANCHOR))).otherwise(F.col("content")))
    fixed = runs.filter("structured").withColumns({"content": F.col("text"), "char_start": F.lit(0), "char_end": F.lit(0), "words": T.word_count(F.col("text"))})
    fixed = fixed.withColumn("chunk_id", T.chunk_id(F.col("doc"), F.col("section"), F.lit(0), F.col("text"))).drop("text")
    return free.unionByName(fixed).withColumn("lang", T.detect_lang(F.col("content"))).drop("before_math")


def fixed_size(blocks: DataFrame) -> DataFrame:
    """Windows over all text blocks of a document, sections ignored."""
    lines = F.array_sort(F.collect_list(F.struct("block_idx", "content")))
    whole = blocks.filter("block_type = 'text'").groupBy("doc").agg(F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("text"))
    return windows(whole.withColumns({"section": F.lit("unknown"), "page": F.lit(0)}))


def sentence_groups(text: Column, size: int = SIZE, least: int = LEAST) -> Column:
    """Sentences packed greedily up to `size` words. A fold over the sentences, as the budget starts anew in each group."""
    empty = "struct<done:array<string>,open:array<string>,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n")).cast(empty)

    def step(state: Column, s: Column) -> Column:
        n = T.word_count(s)
        full = (state["n"] + n > size) & (F.size(state["open"]) > 0)
        return F.when(
            full,
            F.struct(F.array_append(state["done"], F.array_join(state["open"], " ")).alias("done"), F.array(s).alias("open"), n.alias("n")),
        ).otherwise(F.struct(state["done"].alias("done"), F.array_append(state["open"], s).alias("open"), (state["n"] + n).alias("n")))

    def finish(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.array_append(state["done"], F.array_join(state["open"], " "))).otherwise(state["done"])

    groups = F.aggregate(F.split(text, T.BLOCK_SENTENCE_END), start, step, finish)
    return F.filter(groups, lambda g: T.word_count(g) >= least)


def unique_ids(chunks: DataFrame, order: str) -> DataFrame:
    """stored_id: document and chunk id, with _2, _3, ... for repeats in order."""
    base = F.concat_ws("_", F.col("doc").cast("string"), F.col("chunk_id"))
    n = F.row_number().over(Window.partitionBy("doc", "chunk_id").orderBy(order))
    return chunks.withColumn("stored_id", F.when(n == 1, base).otherwise(F.concat_ws("_", base, n.cast("string"))))


def extract(text: Column, words: int) -> Column:
    """The offline stand-in of a summary: the first words."""
    return F.array_join(F.slice(T.words(text), 1, words), " ")


def summary_tree(chunks: DataFrame, summarize=lambda text: extract(text, 60)) -> DataFrame:
    """chunks (doc, run, char_start, section, content) as level 0, a summary of each section with several chunks as level
    1 (from its first 3000 characters), and one of each document as level 2 (from its first 20 chunks, 4000 characters). The chunks
    are written, as all levels are made of them."""
    chunks = materialized(chunks.select("doc", "section", "content", "run", "char_start"), "tree-chunks")
    order = F.struct("run", "char_start", "content")
    leaves = chunks.select("doc", "section", "content", "run", "char_start").withColumn("chunk_level", F.lit(0))
    rows = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["content"])
    mids = chunks.groupBy("doc", "section").agg(F.count(F.lit(1)).alias("n"), F.array_join(rows, "\n\n").alias("all")).filter("n > 1")
    mids = mids.select("doc", "section", summarize(F.substring("all", 1, 3000)).alias("content"), F.lit(1).alias("chunk_level"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("run", "char_start"))
    first = chunks.withColumn("place", place).filter("place <= 20")
    roots = first.groupBy("doc").agg(F.array_join(rows, "\n\n").alias("all"))
    roots = roots.select("doc", F.lit("full").alias("section"), summarize(F.substring("all", 1, 4000)).alias("content"), F.lit(2).alias("chunk_level"))
    return leaves.select("doc", "section", "content", "chunk_level").unionByName(mids).unionByName(roots)

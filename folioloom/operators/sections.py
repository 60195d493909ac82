"""Document types, section headings, forward fill of sections, inferred reference lists."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.functions import patterns as P
from folioloom.functions import text as T
from folioloom.operators.tables import materialized

HEADER_RATIO, SHORT, CANDIDATE = 1.2, 80, 100
SAMPLE, REFERENCE_WINDOW, REFERENCE_LEAST = 30, 16, 3


#: Stands on a line of its own between the spellings of a heading; no pattern fits over it.
BETWEEN = "\n\x01\n"


def _first_section(patterns: dict[str, list[str]], spellings: Column) -> Column:
    """The first section of which a pattern fits a line of spellings; one regular expression for each section."""
    found = F.lit(None).cast("string")
    for section, shapes in reversed(patterns.items()):
        found = F.when(spellings.rlike("(?md)" + "|".join(f"(?:{p})" for p in shapes)), section).otherwise(found)
    return found


def heading_spellings(content: Column) -> Column:
    """A heading as it stands, with spaced Hangul joined, and both without numbering, each different one on a line of its own."""
    text = F.replace(F.trim(content), F.lit("\n"), F.lit("\r"))  # white space, but no line's end
    both = F.array(text, T.match_text(text))
    return F.array_join(F.array_distinct(F.concat(both, F.transform(both, T.without_numbering))), BETWEEN)


def heading_section(spellings: Column, doc_type: Column) -> Column:
    """The first section, in the order of the document type's table, of which a pattern fits one of a heading's spellings."""
    out = F.lit(None).cast("string")
    for kind, patterns in reversed(P.BY_TYPE.items()):
        out = F.when(doc_type == kind, _first_section(patterns, spellings)).otherwise(out)
    return out


def heading_able(body_font: Column) -> Column:
    """Whether a block may be a heading, by block_type, length, font_size and is_bold."""
    size = F.length(F.trim(F.col("content")))
    styled = (size < CANDIDATE) & ((F.col("font_size") >= body_font * HEADER_RATIO) | F.col("is_bold"))
    return ((F.col("block_type") == "heading") | (size <= SHORT) | styled) & F.col("block_type").isin("text", "heading")


def detected_section(doc_type: Column, body_font: Column) -> Column:
    """The section that a block's text begins, from block_type, content, spellings, font_size and is_bold; null if it is no
    heading."""
    return F.when(heading_able(body_font), heading_section(F.col("spellings"), doc_type))


def body_fonts(blocks: DataFrame) -> DataFrame:
    """doc and body_font: the most frequent size, to a tenth, of its text; the first seen on a tie; 10 without any."""
    texts = F.col("block_type").isin("text", "heading") & (F.col("font_size") > 0)
    counts = blocks.groupBy("doc", F.when(texts, F.round("font_size", 1)).alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.min("block_idx").alias("first")
    )
    best = F.max_by("size", F.when(F.col("size").isNotNull(), F.struct("n", -F.col("first"))))
    return counts.groupBy("doc").agg(F.coalesce(best, F.lit(10.0)).alias("body_font"))


def signals(kind: str) -> Column:
    """How often a type's signals stand in a text (sample; lower: the same in lower case). Most texts hold none, which a search
    for words shows faster than the expression."""
    named, shape = P.SIGNAL_WORDS[kind]
    able = reduce(or_, (F.contains("lower", F.lit(w)) for w in named))
    able = able if shape is None else able | F.col("lower").rlike(shape)
    return F.when(able, F.regexp_count("sample", F.lit(P.SIGNALS[kind]))).otherwise(F.when(F.col("sample").isNotNull(), 0))


def document_types(blocks: DataFrame) -> DataFrame:
    """doc and doc_type, by signals among its first 30 blocks: patent from two signals; paper if its signals are at least
    lecture's; else the most signals (lecture, paper, general); paper without any."""
    first = blocks.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("block_idx"))).filter(F.col("n") <= SAMPLE)
    text = F.when(F.col("block_type").isin("text", "heading"), F.struct("block_idx", "content"))
    lines = F.transform(F.array_sort(F.collect_list(text)), lambda x: x["content"])
    sample = first.groupBy("doc").agg(T.match_text(F.array_join(lines, " ")).alias("sample"))
    n = sample.withColumn("lower", F.lower("sample")).select("doc", *(signals(k).alias(k) for k in P.SIGNALS))
    most = F.greatest("lecture", "paper", "general")
    return n.withColumn(
        "doc_type",
        F.when(F.col("patent") >= 2, "patent")
        .when((F.col("paper") > 0) & (F.col("lecture") <= F.col("paper")), "paper")
        .when(most == 0, "paper")
        .when(F.col("lecture") == most, "lecture")
        .when(F.col("paper") == most, "paper")
        .otherwise("general"),
    )


def with_sections(blocks: DataFrame) -> DataFrame:
    """blocks (doc, block_idx, content, page, font_size, is_bold, block_type) with doc_type, body_font and section_type.

    Types and fonts are found first and written; they meet the blocks in one shuffle by document, which all windows share. What
    is asked of a block's text is asked before the windows, so they carry the text only where the result shows it.
    """
    kinds = materialized(document_types(blocks).select("doc", "doc_type").join(body_fonts(blocks), "doc"), "kinds")
    rows = blocks.join(kinds.hint("shuffle_hash"), "doc")
    rows = rows.withColumn("spellings", F.when(heading_able(F.col("body_font")), heading_spellings(F.col("content"))))
    rows = rows.withColumn("detected", detected_section(F.col("doc_type"), F.col("body_font"))).drop("spellings")
    return inferred_references(rows)


# Entries of a reference list, and an author's biography.
ENTRY_NUMBER, ENTRY_AUTHOR = r"^\s*(\[\d+\]|\d+\.)\s+", r"^[A-Z][A-Za-z'`\-]+,\s+[A-Z]\."
ENTRY_SIGNS = (r"(?i)\bet al\.", r"(?i)\bdoi\b|arxiv|retrieval|generation|language model")
#: How every entry begins, in a text whose spaces are as they were.
ENTRY_START = r"^\s*(?:\[\d+\]|\d+\.|[A-Z][A-Za-z'`\-]+,)\s"
BIOGRAPHY = r"(?i)(저\s*자\s*소\s*개|author\s*bio(?:graphy)?)"


def reference_like(content: Column) -> Column:
    """Whether a line looks like an entry of a reference list: it begins with an author, or with a number and then an author
    or signs of a citation."""
    line = F.trim(F.regexp_replace(content, r"\s+", " "))
    rest = F.trim(F.regexp_replace(line, ENTRY_NUMBER, ""))
    signs = reduce(or_, (rest.rlike(p) for p in (ENTRY_AUTHOR, *ENTRY_SIGNS)))
    return content.rlike(ENTRY_START) & F.when(line.rlike(ENTRY_NUMBER), signs).otherwise(line.rlike(ENTRY_AUTHOR))


def restarts(body_font: Column) -> Column:
    """Whether a block shows that the reference list is over: an author's biography, another section, or a large font."""
    text = F.trim(F.col("content"))
    bio = (F.contains(F.lower(text), F.lit("author")) | F.contains(text, F.lit("저"))) & text.rlike(BIOGRAPHY)
    other = F.coalesce(F.col("detected") != "references", F.lit(False))
    return bio | other | ((F.col("font_size") >= body_font * 1.5) & (F.length(text) >= 20))


def inferred_references(rows: DataFrame) -> DataFrame:
    """rows of with_sections() with section_type: headings (detected) fill forward. Reference lists that have no heading are
    found in papers: late in the document, from the first entry that has three among itself and the next fifteen blocks, to the
    first block on a later page that starts something else."""
    order = Window.partitionBy("doc").orderBy("block_idx")
    doc = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the same order, so rows are sorted once
    text = F.col("block_type").isin("text", "heading")
    paper = F.col("doc_type") == "paper"
    rows = rows.withColumns(
        {
            "entry": F.when(paper & text, reference_like(F.col("content")).cast("int")),
            "restarts": F.when(paper & text, restarts(F.col("body_font"))),
        }
    )
    rows = rows.withColumns(
        {
            "section_type": F.coalesce(F.last("detected", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("unknown")),
            "near": F.sum("entry").over(order.rowsBetween(0, REFERENCE_WINDOW - 1)),
            "pages": F.max("page").over(doc) + 1,
            "has_references": F.coalesce(F.max((F.col("detected") == "references").cast("int")).over(doc), F.lit(0)),
        }
    )
    late = F.col("page") >= F.greatest(F.floor(F.col("pages") * 0.65), F.col("pages") - 5)
    starts = paper & (F.col("has_references") == 0) & late & (F.col("entry") == 1) & (F.col("near") >= REFERENCE_LEAST)
    rows = rows.withColumn("start", F.min(F.when(starts, F.struct("block_idx", "page"))).over(doc))
    stop = F.col("restarts") & (F.col("block_idx") > F.col("start.block_idx")) & (F.col("page") > F.col("start.page"))
    rows = rows.withColumn("stop", F.min(F.when(stop, F.col("block_idx"))).over(doc))
    inside = (F.col("block_idx") >= F.col("start.block_idx")) & (F.col("stop").isNull() | (F.col("block_idx") < F.col("stop")))
    section = F.when(F.coalesce(inside, F.lit(False)), "references").otherwise(F.col("section_type"))
    return rows.withColumn("section_type", section).drop("pages", "has_references", "entry", "restarts", "near", "start", "stop")


def section_text(rows: DataFrame, section: str) -> DataFrame:
    """doc and text: the section's blocks in order, one to a line."""
    lines = F.array_sort(F.collect_list(F.struct("block_idx", "content")))
    out = rows.filter(F.col("section_type") == section).groupBy("doc")
    return out.agg(F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("text"))


def reference_text(rows: DataFrame) -> DataFrame:
    """doc and text: the references section, else the blocks that name references at their start."""
    near = F.contains(F.lower(F.substring("content", 1, 50)), F.lit("reference"))
    own = F.when(F.col("section_type") == "references", F.struct("block_idx", "content"))
    named = F.when(near, F.struct("block_idx", "content"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["content"]), "\n")
    both = rows.groupBy("doc").agg(text(own).alias("own"), text(named).alias("named"))
    return both.select("doc", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("named")).alias("text"))


def section_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "section_type").agg(F.count(F.lit(1)).alias("n_blocks"))


def title(rows: DataFrame) -> DataFrame:
    """doc and title: the text in the largest font on the first page (the first on a tie), 200 characters."""
    able = F.col("block_type").isin("text", "heading") & (F.col("page") == 0)
    best = F.max_by("content", F.when(able, F.struct("font_size", -F.col("block_idx"))))
    return rows.groupBy("doc").agg(F.substring(F.coalesce(best, F.lit("Unknown")), 1, 200).alias("title"))


def section_rank(section: Column, doc_type: str = "paper") -> Column:
    """Place of a section in its document type's order; 99 if it has none."""
    out = F.lit(99)
    for i, name in enumerate(P.ORDER[doc_type]):
        out = F.when(section == name, i).otherwise(out)
    return out

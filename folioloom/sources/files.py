"""Files in, blocks out: plain text, Markdown, office documents, query sets; and tables and reports out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.functions import text as T

LINES_A_PAGE, PARAGRAPHS_A_PAGE, LEAST_TEXT = 51, 41, 5
EXTENSIONS, TYPES, MOST_BYTES = (".pdf", ".docx", ".txt"), ("paper", "lecture", "patent"), 50 * 1024 * 1024
BLOCKS = "doc string, block_idx int, content string, page int, font_size double, is_bold boolean, block_type string, header_level int"


def line_blocks(texts: DataFrame, doc: str = "doc_id", body: str = "text") -> DataFrame:
    """BLOCKS-like rows of plain text: non-empty lines, # to ### as fonts 18, 14, 12, a page every 51 lines.
    Lines are numbered within their row, so nothing is shuffled."""
    stripped = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    each = texts.select(F.col(doc).alias("doc"), F.posexplode(F.filter(stripped, lambda x: x != "")).alias("block_idx", "content"))
    font = F.when(F.startswith("content", F.lit("# ")), 18.0).when(F.startswith("content", F.lit("## ")), 14.0).when(F.startswith("content", F.lit("### ")), 12.0).otherwise(10.0)
    each = each.withColumn("font_size", font)
    return each.select(
        "doc", "block_idx", "content", (F.floor(F.col("block_idx") / LINES_A_PAGE) + 1).cast("int").alias("page"), "font_size",
        (F.col("font_size") > 10).alias("is_bold"), F.lit("text").alias("block_type"), F.lit(0).alias("header_level"),
    )


def line_title(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """doc and title: the first line in font 14 or more without its marks, else the file's stem (names: doc, stem)."""
    first = F.min(F.when(F.col("font_size") >= 14, F.struct("block_idx", "content")))
    held = blocks.groupBy("doc").agg(first["content"].alias("line"))
    own = F.substring(F.regexp_replace("line", r"^[# ]+", ""), 1, 100)
    return names.join(held, "doc", "left").select("doc", F.coalesce(own, "stem").alias("title"))


def markdown_blocks(texts: DataFrame, doc: str = "doc", body: str = "text") -> DataFrame:
    """Blocks of Markdown: fenced code, headings, tables of two lines or more, list items, other lines of five characters.

    A line is code if an odd number of fences stands before it; neighbouring lines of one fence, or of one table, are an
    island and become one block.
    """
    each = texts.select(F.col(doc).alias("doc"), F.col("page"), F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    by = Window.partitionBy("doc", "page").orderBy("line_no")
    bare = F.trim(F.col("line"))
    each = each.withColumn("fence", F.startswith(bare, F.lit("```")))
    each = each.withColumn("fences", F.sum(F.col("fence").cast("int")).over(by))
    each = each.filter("NOT fence").withColumn("code", F.col("fences") % 2 == 1)
    each = each.withColumn("bar", ~F.col("code") & F.startswith(bare, F.lit("|")))
    new = F.coalesce((F.lag("bar").over(by) != F.col("bar")) | (F.lag("fences").over(by) != F.col("fences")), F.lit(True))
    each = each.withColumn("run", F.sum(new.cast("int")).over(by))
    kind = F.when(F.col("code"), "code").when(F.col("bar"), "bar").otherwise("line")
    each = each.withColumn("kind", kind)
    whole = each.filter("kind <> 'line'").groupBy("doc", "page", "run", "kind").agg(
        F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("line"),
    )
    lone = F.trim(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""))
    whole = whole.select(
        "doc", "page", "line_no", F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"), F.lit(0).alias("header_level"),
        F.when(F.col("kind") == "code", "code").when(F.col("n") >= 2, "table").otherwise("text").alias("block_type"),
        F.when(F.col("kind") == "code", F.trim("line")).when(F.col("n") >= 2, F.col("line")).otherwise(lone).alias("content"),
    ).filter("content <> ''")
    level = F.length(F.regexp_extract("line", r"^(#{1,3})\s+.+", 1))
    item = F.col("line").rlike(r"^\s*[-*+]\s+") | F.col("line").rlike(r"^\s*\d+\.\s+")
    content = (
        F.when(level > 0, F.trim(F.regexp_extract("line", r"^#{1,3}\s+(.+)", 1)))
        .when(item, F.trim(F.regexp_replace(F.trim(F.regexp_replace("line", r"^\s*[-*+]\s+", "")), r"^\s*\d+\.\s+", "")))
        .otherwise(bare)
    )
    lines = each.filter("kind = 'line'").select(
        "doc", "page", "line_no", F.when(level > 0, 14.0 + (3 - level) * 2).otherwise(10.0).alias("font_size"), (level > 0).alias("is_bold"),
        level.alias("header_level"), F.when(level > 0, "heading").when(item, "list_item").otherwise("text").alias("block_type"), content.alias("content"),
    )
    lines = lines.filter((F.col("content") != "") & ((F.col("block_type") != "text") | (F.length("content") >= LEAST_TEXT)))
    place = Window.partitionBy("doc").orderBy("page", "line_no")
    return lines.unionByName(whole).withColumn("block_idx", F.row_number().over(place) - 1).drop("line_no")


def span_blocks(spans: DataFrame) -> DataFrame:
    """Blocks of raw spans (doc, page, block_no, span_no, text, font, size, bold): joined text, mean font, bold if any
    span is, math if half of the spans are; under five characters nothing."""
    math = F.col("font").rlike(T.MATH_FONT) | (T.math_density(F.col("text")) >= 0.25)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"])
    rows = spans.filter(F.trim("text") != "").groupBy("doc", "page", "block_no").agg(
        F.trim(F.array_join(parts, " ")).alias("content"), F.round(F.avg("size"), 6).alias("font_size"), F.bool_or("bold").alias("is_bold"),
        F.avg(math.cast("int")).alias("share"),
    )
    rows = rows.filter(F.length("content") >= LEAST_TEXT)
    return rows.withColumn("block_type", F.when(F.col("share") >= 0.5, "math").otherwise("text")).drop("share")


def page_span_blocks(pages: DataFrame) -> DataFrame:
    """span_blocks() of whole pages (doc, page, spans: array of block_no, span_no, text, font, size, bold), as a parser gives them:
    a page's spans are sorted and cut into blocks within its row, so nothing is shuffled."""

    def of_sorted(s: Column) -> Column:
        every = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: (i == 0) | ~F.get(s, i)["block_no"].eqNullSafe(F.get(s, i - 1)["block_no"]))
        return F.transform(F.array(starts), lambda own: F.transform(own, lambda at, j: F.slice(s, at + 1, F.coalesce(F.get(own, j + 1), F.size(s)) - at)))[0]

    def block(s: Column) -> Column:
        total = lambda of: F.aggregate(s, F.lit(0.0), lambda sum_, x: sum_ + of(x))
        math = lambda x: (x["font"].rlike(T.MATH_FONT) | (T.math_density(x["text"]) >= 0.25)).cast("double")
        return F.struct(
            F.get(s, F.lit(0))["block_no"].alias("block_no"), F.trim(F.array_join(F.transform(s, lambda x: x["text"]), " ")).alias("content"),
            F.round(total(lambda x: x["size"]) / F.size(s), 6).alias("font_size"), F.exists(s, lambda x: x["bold"]).alias("is_bold"),
            F.when(total(math) / F.size(s) >= 0.5, "math").otherwise("text").alias("block_type"),
        )

    held = F.array_sort(F.filter("spans", lambda x: F.trim(x["text"]) != ""))
    blocks = F.transform(F.transform(F.array(held), of_sorted)[0], block)
    return pages.select("doc", "page", F.inline(F.filter(blocks, lambda b: F.length(b["content"]) >= LEAST_TEXT)))


def merged_blocks(raw: DataFrame, structured: DataFrame) -> DataFrame:
    """Structured blocks (doc, page, idx, content, ...) with font and bold of the raw block of their page whose first ten
    words share most with theirs (two at least, the first on a tie); formulas that only the raw ones have; and raw pages
    that have no structured block. Pages are joined by key, and words compared within a page."""
    head = lambda c, n: F.array_distinct(F.slice(T.words(F.col(c)), 1, n))
    r = raw.select("doc", "page", F.col("idx").alias("raw_idx"), F.col("content").alias("raw"), F.col("font_size").alias("raw_font"), F.col("is_bold").alias("raw_bold"))
    pairs = structured.join(r, ["doc", "page"])
    shared = F.size(F.array_intersect(head("content", 10), head("raw", 10)))
    pairs = pairs.withColumn("shared", shared).filter("shared >= 2")
    best = pairs.groupBy("doc", "page", "idx").agg(F.max(F.struct("shared", -F.col("raw_idx"), "raw_font", "raw_bold")).alias("b"))
    rows = structured.join(best, ["doc", "page", "idx"], "left").select(
        "doc", "page", "idx", "content", "block_type", F.coalesce("b.raw_font", "font_size").alias("font_size"), F.coalesce("b.raw_bold", "is_bold").alias("is_bold"), F.lit(0).alias("part"),
    )
    pages = structured.select("doc", "page").distinct()
    s = structured.select("doc", "page", F.col("content").alias("other"))
    math = raw.filter("block_type = 'math'").join(pages, ["doc", "page"], "left_semi")
    alike = math.join(s, ["doc", "page"]).filter(F.size(F.array_intersect(head("content", 8), head("other", 8))) >= 3)
    math = math.join(alike.select("doc", "page", "idx"), ["doc", "page", "idx"], "left_anti").withColumn("part", F.lit(1))
    alone = raw.join(pages, ["doc", "page"], "left_anti").withColumn("part", F.lit(0))
    keep = ["doc", "page", "idx", "content", "block_type", "font_size", "is_bold", "part"]
    return rows.unionByName(math.select(*keep)).unionByName(alone.select(*keep))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(files: DataFrame) -> DataFrame:
    """BLOCKS of office documents (path, content binary): a block for each non-empty paragraph, fonts by heading style, a
    page every 41 paragraphs. Documents are zipped XML, which the standard library reads on the executors."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace(" ", "_").lower()
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                n = 0
                for p in root.iter(f"{_W}p"):
                    text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
                    if not text:
                        continue
                    style = p.find(f"{_W}pPr/{_W}pStyle")
                    name = (style.get(f"{_W}val") if style is not None else "").lower().replace(" ", "")
                    font = 18.0 if "heading1" in name or "title" in name else 14.0 if "heading2" in name else 12.0 if "heading3" in name else 10.0
                    bold = p.find(f"{_W}r/{_W}rPr/{_W}b") is not None
                    rows.append((stem, n, text, n // PARAGRAPHS_A_PAGE + 1, font, bold, "text", 0))
                    n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(parsed, BLOCKS)


def docx_title(blocks: DataFrame) -> DataFrame:
    """doc and title: the first block in font 16 or more, cut to 100 characters, else the document's name."""
    first = F.min(F.when(F.col("font_size") >= 16, F.struct("block_idx", "content")))
    return blocks.groupBy("doc").agg(F.coalesce(F.substring(first["content"], 1, 100), F.first("doc")).alias("title"))


def upload_fault(name: Column, doc_type: Column, size: Column, head: Column) -> Column:
    """Why an upload is refused, or null: extension, type, size, first bytes."""
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    kind = T.mime(head)
    fits = (
        ((extension == ".pdf") & (kind == "application/pdf"))
        | ((extension == ".docx") & F.startswith(kind, F.lit("application/vnd")))
        | ((extension == ".txt") & (kind == "text/plain"))
    )
    return (
        F.when(~extension.isin(*EXTENSIONS), "extension").when(~doc_type.isin(*TYPES), "doc_type").when(size > MOST_BYTES, "size").when(~fits, "signature")
    )


def files_in(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of a folder's files, and doc."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("doc", T.document_id(F.regexp_extract("path", r"([^/]+)$", 1)))


def missing(requested: DataFrame, present: DataFrame, key: str = "doc") -> DataFrame:
    return requested.join(present.select(key), key, "left_anti")


#: Fields of a query.
QUERY = (
    "query:string, ground_truth:string, ground_truth_by_paper:map<string,string>, type:string, expected_route:string, "
    "applicable_papers:array<string>, answer_span:string, track:string"
)


def query_sets(spark: SparkSession, path: str) -> DataFrame:
    """Queries from JSON files that hold a list, or an object with the list under queries or samples; those without text
    go, and a ground truth that is only a placeholder is blank."""
    raw = spark.read.option("wholetext", "true").text(path)
    listed = F.from_json("value", f"array<struct<{QUERY}>>")
    inside = F.from_json("value", f"struct<queries:array<struct<{QUERY}>>,samples:array<struct<{QUERY}>>>")
    is_list = F.startswith(F.trim("value"), F.lit("["))
    rows = raw.select(F.inline(F.when(is_list, listed).otherwise(F.coalesce(inside["queries"], inside["samples"]))))
    rows = rows.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    placeholder = F.startswith("ground_truth", F.lit("PAPER_SPECIFIC"))
    return rows.withColumn("ground_truth", F.when(F.coalesce(placeholder, F.lit(True)), "").otherwise(F.col("ground_truth")))


def answer_sections(texts: DataFrame) -> DataFrame:
    """doc, section_no, title, body of answers (doc, text): split at # headings or bold numbered lines, marks removed."""
    each = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    head = F.coalesce(F.nullif(F.regexp_extract("line", r"^#{1,3}\s+(.+)", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\*\*\d+\.\s*(.+?)\*\*", 1), F.lit("")))
    each = each.withColumn("head", head)
    run = F.sum(F.col("head").isNotNull().cast("int")).over(Window.partitionBy("doc").orderBy("line_no"))
    each = each.withColumn("run", run).filter("head IS NOT NULL OR line <> ''")
    plain = F.regexp_replace("line", r"\*{1,2}(.+?)\*{1,2}", "$1")
    body = F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("line_no", plain.alias("text")))))
    rows = each.groupBy("doc", "run").agg(
        F.coalesce(F.regexp_replace(F.max("head"), r"^[*# ]+|[*# ]+$", ""), F.lit("")).alias("title"), F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("body")
    )
    no = F.row_number().over(Window.partitionBy("doc").orderBy("run"))
    return rows.select("doc", no.alias("section_no"), "title", "body")


def slide_rows(sections: DataFrame) -> DataFrame:
    """doc, section_no, title, line_no, text, is_bullet: what the slides of an answer say."""
    each = sections.select("doc", "section_no", F.when(F.col("title") == "", "Summary").otherwise(F.col("title")).alias("title"), F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    bullet = F.col("line").rlike(r"^[-*]\s") | F.col("line").rlike(r"^\d+\.\s")
    bare = F.regexp_replace(F.regexp_replace("line", r"^[-*]\s+", ""), r"^\d+\.\s+", "")
    return each.filter(F.trim("line") != "").select("doc", "section_no", "title", "line_no", bare.alias("text"), bullet.alias("is_bullet"))


def flashcards(texts: DataFrame) -> DataFrame:
    """doc, card_no, front, back of the JSON list between the card marks, or the first list in the text; no rows if it
    isn't one whose first card has a front."""
    marked = F.regexp_extract("text", r"(?s)\[FLASHCARD_START\](.*?)\[FLASHCARD_END\]", 1)
    any_list = F.regexp_extract("text", r"(?s)(\[.*\])", 1)
    both = F.contains("text", F.lit("[FLASHCARD_START]")) & F.contains("text", F.lit("[FLASHCARD_END]"))
    cards = F.from_json(F.trim(F.when(both, marked).otherwise(any_list)), "array<struct<front:string,back:string>>")
    rows = texts.select("doc", cards.alias("cards")).filter(F.coalesce(F.get("cards", F.lit(0))["front"], F.lit("")) != "")
    return rows.select("doc", F.posexplode("cards").alias("card_no", "card")).select("doc", "card_no", "card.front", "card.back")

"""References, patents, keywords, and stored responses of public catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.functions import patterns as P
from folioloom.functions import text as T

# How patents are written, and the hosts that documents may be taken from.
PATENT = rf"({T.COUNTRIES})[\s\-]?([\d\-,\.]+(?:[A-Z]\d?)?)"
HOSTS = ("arxiv.org", "export.arxiv.org", "patents.google.com", "www.kipris.or.kr", "kipris.or.kr")


def references(texts: DataFrame) -> DataFrame:
    """doc, ref_id, title, authors, year, arxiv_id for each entry of ten characters or more of texts (doc, text)."""
    entries = F.split(F.trim("text"), r"\n\s*(?=\[\d+\]|\d+[.)])")
    each = texts.select("doc", F.posexplode(entries).alias("pos", "entry")).withColumn("entry", F.trim("entry"))
    each = each.filter(F.length("entry") >= 10)
    each = each.withColumn("ref_id", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    body = F.trim(F.regexp_replace("entry", r"^\[?\d+[\].)]?\s*", ""))
    each = each.withColumn("body", body).filter("body <> ''")
    got = lambda p, i: F.nullif(F.regexp_extract("body", p, i), F.lit(""))
    parts = F.split("body", r"\.", 3)
    plain = F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))).otherwise(F.substring("body", 1, 160))
    author = got(r"^(.+?)[.,]", 1)
    year = got(r"\((\d{4})\)|,\s*(\d{4})", 0)
    return each.select(
        "doc", F.col("ref_id").cast("string").alias("ref_id"),
        F.coalesce(F.trim(got(r"[\"“](.+?)[\"”]", 1)), plain).alias("title"),
        F.when(author.isNotNull(), F.array(F.trim(author))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.regexp_extract(year, r"\d{4}", 0).alias("year"), got(r"(?i)arXiv[:\s]*(\d{4}\.\d{4,5})", 1).alias("arxiv_id"),
    )


def reference_summary(refs: DataFrame) -> DataFrame:
    """doc, ref_id, title, the first three authors, year and has_pdf."""
    return refs.select("doc", "ref_id", "title", F.array_join(F.slice("authors", 1, 3), ", ").alias("authors"), "year", F.col("arxiv_id").isNotNull().alias("has_pdf"))


def patents(texts: DataFrame) -> DataFrame:
    """doc, patent_no, patent_id, title for the distinct patent numbers of texts (doc, text), in order.

    The text is cut at each number, so the piece after it holds the title's neighbourhood without a search for places.
    """
    numbers = F.regexp_extract_all("text", F.lit(PATENT), F.lit(0))
    after = F.split("text", f"(?:{PATENT})")
    rows = texts.select("doc", F.col("text").alias("whole"), numbers.alias("found"), after.alias("after"))
    each = rows.select("doc", "whole", "after", "found", F.posexplode("found").alias("pos", "match"))
    country = F.substring("match", 1, 2)
    number = F.regexp_replace(F.regexp_replace(F.substring("match", 3, 1_000_000), r"^[\s\-]", ""), "[, ]", "")
    each = each.withColumn("patent_id", F.concat(country, number))
    first = F.row_number().over(Window.partitionBy("doc", "patent_id").orderBy("pos"))
    each = each.withColumn("copy", first).filter("copy = 1")
    each = each.withColumn("start", F.aggregate(
        F.sequence(F.lit(0), F.col("pos")), F.lit(0), lambda s, i: s + F.length(F.get("after", i)) + F.when(i < F.col("pos"), F.length(F.get("found", i))).otherwise(0)
    ))
    context = F.expr("substring(whole, greatest(0, start - 5) + 1, start + length(match) + 200 - greatest(0, start - 5))")
    each = each.withColumn("context", context)
    behind = F.trim(F.expr("substring(context, instr(context, patent_id) + length(patent_id), 1000000)"))
    each = each.withColumn("rest", F.when(F.contains("context", F.col("patent_id")), behind).otherwise(F.col("context")))
    quoted = F.regexp_extract("rest", "[\"'](.+?)[\"']", 1)
    phrase = F.trim(F.substring_index("rest", ".", 1))
    title = F.when(quoted != "", F.trim(quoted)).when(phrase != "", phrase).otherwise(F.col("patent_id"))
    no = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    return each.select("doc", no.alias("patent_no"), "patent_id", F.substring(title, 1, 200).alias("title"))


def keywords(texts: DataFrame, k: int = 10) -> DataFrame:
    """doc, keyword, n, rank: the most frequent words that aren't stop words, first seen on a tie."""
    words = F.regexp_extract_all("text", F.lit(T.KEYWORD), F.lit(0))
    each = texts.select("doc", F.posexplode(words).alias("pos", "keyword")).filter(~F.lower("keyword").isin(*P.STOPWORDS))
    n = each.groupBy("doc", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy("doc").orderBy(F.col("n").desc(), "first")
    return n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("first")


def search_url(words: Column) -> Column:
    """Where patents that hold these words are searched for."""
    return F.concat(F.lit("https://patents.google.com/?q="), F.url_encode(F.array_join(words, " ")))


def plain(html: Column) -> Column:
    """The text of a piece of HTML: its parts between tags, trimmed and put together."""
    parts = F.array_join(F.transform(F.split(html, r"<[^>]*>"), lambda x: F.trim(x)), "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        parts = F.replace(parts, F.lit(name), F.lit(sign))
    return parts


def element(page: Column, name: str, attribute: str, value: str) -> Column:
    """The text of a page's first element of that name with that attribute, null without one. The element ends at the first
    end tag of its name."""
    form = rf'(?s)<{name}\b[^>]*\b{attribute}="(?:[^"]*\s)?{value}(?:\s[^"]*)?"[^>]*>(.*?)</{name}>'
    return F.when(F.regexp_like(page, F.lit(form)), plain(F.regexp_extract(page, form, 1)))


def patent_pages(responses: DataFrame) -> DataFrame:
    """key, title, abstract (1000 characters), applicant, inventors, pdf_url, fetched, fetch_error from stored pages of a
    patent catalogue (key, status, html). A status of 404 is patent_not_found, none is timeout, another of 400 or more
    http_ with its number."""
    fault = (
        F.when(F.col("status").isNull(), "timeout").when(F.col("status") == 404, "patent_not_found")
        .when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string")))
    )
    rows = responses.withColumn("fetch_error", fault).withColumn("page", F.when(F.col("fetch_error").isNull(), F.coalesce("html", F.lit(""))))
    page = F.col("page")
    names = F.regexp_extract_all(page, F.lit(r'(?s)<dd\b[^>]*\bitemprop="inventor"[^>]*>(.*?)</dd>'), F.lit(1))
    return rows.select(
        "key", element(page, "span", "itemprop", "title").alias("title"), F.substring(element(page, "div", "class", "abstract"), 1, 1000).alias("abstract"),
        element(page, "dd", "itemprop", "assigneeOriginal").alias("applicant"), F.transform(names, plain).alias("inventors"),
        F.nullif(F.regexp_extract(page, r'<a\b[^>]*\bhref="([^"]*\.pdf)"', 1), F.lit("")).alias("pdf_url"), F.col("fetch_error").isNull().alias("fetched"), "fetch_error",
    )


def kipris_entries(responses: DataFrame) -> DataFrame:
    """key, title, applicant and fetched from stored XML answers of the Korean service (key, xml); only Korean patents are
    asked for there, and an answer that is no XML was not fetched."""
    rows = responses.filter(F.startswith("key", F.lit("KR")))
    good = F.regexp_like(F.trim(F.coalesce("xml", F.lit(""))), F.lit(r"(?s)^<.*>$"))
    at = lambda p: F.when(good, F.nullif(F.xpath_string("xml", F.lit(p)), F.lit("")))
    return rows.select("key", at("//inventionTitle").alias("title"), at("//applicantName").alias("applicant"), good.alias("fetched"))


def kipris_number(patent_id: Column) -> Column:
    """What the Korean service is asked by."""
    return F.replace(F.replace(patent_id, F.lit("KR"), F.lit("")), F.lit("-"), F.lit(""))


def similar_items(pages: DataFrame, k: int = 5) -> DataFrame:
    """key, place, patent_id, title of the first k items of stored result pages (key, html): result items, or articles where
    there are none. An item without a link to a patent is named similar_ and its place."""
    parts = lambda name: F.regexp_extract_all("html", F.lit(rf"(?s)<{name}\b.*?</{name}>"), F.lit(0))
    items = F.when(F.size(parts("search-result-item")) > 0, parts("search-result-item")).otherwise(parts("article"))
    each = pages.select("key", F.posexplode(F.slice(items, 1, k)).alias("place", "item"))
    own = F.nullif(F.regexp_extract("item", r'<a\b[^>]*\bhref="[^"]*/patent/(\w+)', 1), F.lit(""))
    head = F.when(F.regexp_like("item", F.lit(r"(?s)<h3\b.*?</h3>")), plain(F.regexp_extract("item", r"(?s)<h3\b[^>]*>(.*?)</h3>", 1)))
    title = F.coalesce(head, element(F.col("item"), "span", "class", "title"), F.lit(""))
    return each.select("key", "place", F.coalesce(own, F.concat(F.lit("similar_"), F.col("place").cast("string"))).alias("patent_id"), title.alias("title"))


def patent_summary(patents_: DataFrame) -> DataFrame:
    """patent_id, title, applicant, the first three inventors, fetched, has_pdf and fetch_error of patent_pages()."""
    return patents_.select(
        F.col("key").alias("patent_id"), "title", "applicant", F.array_join(F.slice("inventors", 1, 3), ", ").alias("inventors"), "fetched",
        F.col("pdf_url").isNotNull().alias("has_pdf"), "fetch_error",
    )


def feed_entries(responses: DataFrame) -> DataFrame:
    """key, title, abstract, pdf_url, arxiv_id, authors, fetched, fetch_error from stored Atom responses (key, xml)."""
    bare = F.regexp_replace("xml", r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = responses.select("key", bare.alias("x"))
    at = lambda p: F.xpath_string("x", F.lit(p))
    found = F.xpath_boolean("x", F.lit("/feed/entry"))
    return rows.select(
        "key", F.when(found, F.trim(at("/feed/entry[1]/title"))).alias("title"), F.when(found, F.trim(at("/feed/entry[1]/summary"))).alias("abstract"),
        F.when(found, F.nullif(at("/feed/entry[1]/link[@title='pdf']/@href"), F.lit(""))).alias("pdf_url"),
        F.when(found, F.nullif(F.regexp_extract(at("/feed/entry[1]/id"), r"(\d{4}\.\d{4,5})", 1), F.lit(""))).alias("arxiv_id"),
        F.when(found, F.xpath("x", F.lit("/feed/entry[1]/author/name/text()"))).alias("authors"),
        found.alias("fetched"), F.when(~found, "arxiv_not_found").alias("fetch_error"),
    )


def feed_query(arxiv_id: Column, title: Column) -> Column:
    by_title = F.concat(F.lit("ti:"), F.url_encode(F.substring(title, 1, 100)))
    return F.coalesce(F.concat(F.lit("id:"), arxiv_id), by_title)


def download_allowed(url: Column, content_type: Column, head: Column) -> Column:
    """Whether a PDF may be taken: web scheme, listed host, right content type and first bytes."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    typed = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))
    return scheme.isin("http", "https") & host.isin(*HOSTS) & typed & (F.substring(head, 1, 5) == "%PDF-")


def first_n(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first n of each group: what a polite client would fetch."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("nth") <= n).drop("nth")

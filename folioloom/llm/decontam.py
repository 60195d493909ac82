"""Benchmark decontamination with a positional inverted index.

The training side is an index of postings (term, document, position), stored once, for the terms of the benchmark, as no other
can be asked for. A benchmark item's windows are searched from their rarest terms: the postings of a window's two rarest
terms, each shifted by the term's offset, are intersected, which leaves the few places where the window may start. There
the lists of all the item's other terms are intersected too, so a phrase match is one in which every offset-adjusted list
meets; no text is read again. Proximity matches come from the same index: places where an item's rarest terms stand near
each other in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, small, working, written

#: Words of a window, and lists that are intersected over the whole index; the others are where these meet.
WINDOW, LISTS = 10, 2
#: An item's rarest distinct terms, and the words within which all of them make a proximity match.
NEAR_TERMS, NEAR = 5, 50
#: A word before A-Z are lower-cased, which moves no word's ends.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Stands for the end of a document; no word is empty.
END = ""


def raw_terms(text: Column) -> Column:
    """The words of a text in order, as they are written; null for a null text."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def terms(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased; null for a null text."""
    return F.transform(raw_terms(text), ascii_lower)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id with a hash of the text, which together name a row (or repeated rows), and the text."""
    return docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_key"), docs["text"])


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words, first (from 0) and length for each window of each item: runs of that many words, or the whole
    of an item that has fewer. Items without words have none. Items that are repeated count once."""
    split = items.select(items["item_id"], F.coalesce(terms(items["text"]), F.array().cast("array<string>")).alias("words")).distinct()
    split = split.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size))
    return split.select("item_id", "words", F.explode(starts).alias("first"), F.least(F.lit(size), F.size("words")).alias("length"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The positional index of the vocabulary's terms (term_no, term) over keyed docs: term_no, doc_id, text_key, pos
    (from 0). Where the vocabulary holds END, each row's end is a posting too, whose pos is its number of words. A
    document's words are cut where they lie; only a vocabulary too large for broadcast makes them move."""
    none = F.array().cast("array<string>")
    every = F.array_append(F.coalesce(raw_terms(docs["text"]), none), F.lit(END))
    found = docs.select("doc_id", "text_key", F.posexplode(every).alias("pos", "raw"))
    found = found.select("doc_id", "text_key", "pos", ascii_lower(F.col("raw")).alias("term"))
    return found.join(small(vocabulary), "term").select("term_no", "doc_id", "text_key", "pos")


def numbered(names: DataFrame) -> DataFrame:
    """term_no and term for the distinct terms (column term) of a benchmark, and END as number -1. Written, so that the
    numbers, which are dealt by partition, are a term's own."""
    found = names.select("term").filter(F.col("term") != END).distinct().select(F.monotonically_increasing_id().alias("term_no"), "term")
    end = names.sparkSession.range(1).select(F.lit(-1).cast("long").alias("term_no"), F.lit(END).alias("term"))
    return written(found.unionByName(end), "decon-terms")


def rarest(found: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """For each window its rarest terms: item_id, words, first, length, term, offset (within the item), bit (a power
    of two of its own) and every (the sum of the window's bits). Ties go to the earlier word."""
    words = F.slice("words", F.col("first") + 1, F.col("length"))
    each = found.withColumn("window", F.monotonically_increasing_id()).select(
        "item_id", "words", "first", "length", "window", F.posexplode(words).alias("at", "term")
    )
    once = each.groupBy("window", "term").agg(F.min(F.struct("at", "item_id", "words", "first", "length")).alias("x"))
    once = once.select("window", "term", "x.*").join(counts, "term", "left")
    order = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "at")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= lists)
    bit = F.expr("shiftleft(1, rank - 1)")
    every = F.sum(bit).over(Window.partitionBy("window")).cast("int")
    # a window with a term that no document holds occurs nowhere
    never = F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("window"))
    return (
        ranked.withColumns({"bit": bit, "every": every, "least": never})
        .filter("least > 0")
        .select("item_id", "words", "first", "length", "term_no", (F.col("first") + F.col("at")).alias("offset"), "bit", "every")
    )


def places(index: DataFrame, rare: DataFrame) -> DataFrame:
    """doc_id, text_key, item_no, start: where an item, laid over a document from start (which may be negative), has
    a window whose rarest terms all stand where they should. rare: item_no, first, term_no, offset, bit, every.
    Bits and not counts are gathered, as repeated rows have their postings twice."""
    lists = index.join(small(rare), "term_no").select(
        "doc_id", "text_key", "item_no", "first", (F.col("pos") - F.col("offset")).alias("start"), "bit", "every"
    )
    met = lists.groupBy("doc_id", "text_key", "item_no", "first", "start").agg(
        F.bit_or("bit").alias("met"), F.max("every").alias("every")
    )
    return met.filter("met = every").select("doc_id", "text_key", "item_no", "start").distinct()


def indexed(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vocabulary of words (column term), the index of keyed docs over it, and term_no, term and n (postings) for each of
    its terms that a document holds; all written."""
    vocabulary = numbered(words)
    index = written(postings(docs, vocabulary), "decon-index")
    counts = index.filter("term_no >= 0").groupBy("term_no").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary, index, written(counts.join(vocabulary, "term_no"), "decon-counts")


def phrase_hits(found: DataFrame, vocabulary: DataFrame, index: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_key, item_id, pos and length: each place (pos from 0, in words) where one of the windows found
    stands in a document of the index. Written."""
    item_no = F.xxhash64("item_id", "words")
    rare = rarest(found, counts).withColumn("item_no", item_no).drop("item_id", "words")
    laid = written(places(index, written(rare, "decon-rare")), "decon-places")
    # the item's words, each where it should be
    items = written(found.select("item_id", "words", item_no.alias("item_no")).distinct(), "decon-items")
    asked = items.select("item_no", F.posexplode("words").alias("offset", "term")).join(vocabulary, "term").drop("term")
    asked = laid.join(small(written(asked, "decon-asked")), "item_no")
    at = (F.col("start") + F.col("offset")).alias("at")
    asked = asked.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "item_no", "start", "offset", F.col("term_no").alias("asked_no"), at)
    docs = written(laid.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct(), "decon-docs")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    near = index.filter("term_no >= 0").join(small(docs), same, "left_semi")
    lists = asked.join(near, same & (F.col("asked_no") == F.col("term_no")) & (F.col("at") == F.col("pos")))
    # a set, as repeated rows have their postings twice
    lists = lists.groupBy("id", "key", "item_no", "start").agg(F.sort_array(F.collect_set("offset")).alias("met"))
    # a window stands where `length` offsets in a row are met
    whole = lists.join(small(items.select("item_no", "item_id", F.least(F.lit(size), F.size("words")).alias("length"))), "item_no")
    starts = F.sequence(F.lit(0), F.size("met") - F.col("length"))
    stands = F.filter(starts, lambda i: F.get("met", i + F.col("length") - 1) - F.get("met", i) == F.col("length") - 1)
    hits = whole.filter(F.size("met") >= F.col("length")).select("id", "key", "item_id", "start", "length", F.explode(F.transform(stands, lambda i: F.get("met", i))).alias("first"))
    return written(hits.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "item_id", (F.col("start") + F.col("first")).alias("pos"), "length"), "decon-hits")


def near_hits(queries: DataFrame, index: DataFrame, within: int = NEAR) -> DataFrame:
    """doc_id, text_key, query_id, pos: places in a document of the index where all terms of a query (query_id, term_no: a
    row for each distinct term) stand within that many words, pos being the first of them. Written.

    Postings are dealt to blocks of `within` positions and the one before; only blocks that hold all of a query's terms are
    looked into, and such a block has at most 2 * within postings, however frequent the terms are.
    """
    each = written(queries.withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), "near-terms")
    block = F.floor(F.col("pos") / within)
    rows = index.join(small(each), "term_no").select("query_id", "lists", "doc_id", "text_key", "term_no", "pos", F.explode(F.array(block - 1, block)).alias("block"))
    by = ["query_id", "doc_id", "text_key", "block"]
    full = rows.groupBy(*by).agg(F.size(F.collect_set("term_no")).alias("held"), F.first("lists").alias("lists"), F.sort_array(F.collect_set(F.struct("pos", "term_no"))).alias("around"))
    full = full.filter(F.col("held") == F.col("lists"))
    # a place counts in the block that it lies in
    own = F.filter("around", lambda a: F.floor(a["pos"] / within) == F.col("block"))
    ahead = lambda a: F.filter("around", lambda b: (b["pos"] >= a["pos"]) & (b["pos"] < a["pos"] + within))
    firsts = F.filter(own, lambda a: F.size(F.array_distinct(F.transform(ahead(a), lambda b: b["term_no"]))) == F.col("lists"))
    found = full.select("query_id", "doc_id", "text_key", F.explode(firsts).alias("x"))
    return written(found.select("query_id", "doc_id", "text_key", F.col("x.pos").alias("pos")), "near-hits")


def proximity_hits(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """near_hits() of queries (query_id, terms array) over keyed docs, which are indexed for it.

    A query counts its distinct terms that aren't null; one without any has no hits, and neither has a null or empty text.
    Repeated rows and repeated queries count once; an empty table gives an empty result; extra columns are ignored.
    """
    with working(docs.sparkSession) as tables:
        words = queries.select("query_id", F.explode("terms").alias("term")).dropna(subset=["term"]).distinct()
        vocabulary, index, _ = indexed(docs, words)
        found = near_hits(words.join(vocabulary, "term").select("query_id", "term_no"), index, within)
        tables.keep(found)
    return found


def near_items(items: DataFrame, vocabulary: DataFrame, index: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, text_key and n_near: items (item_id, words) whose NEAR_TERMS rarest distinct terms (all, if they have fewer,
    but at least two) stand within NEAR words of each other. A term that no document holds is a term like others, so its
    item has none."""
    each = items.select("item_id", F.xxhash64("item_id", "words").alias("query_id"), F.explode(F.array_distinct("words")).alias("term"))
    each = each.join(vocabulary, "term").join(counts.select("term_no", "n"), "term_no", "left")
    rank = Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "term")
    terms_of = each.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= NEAR_TERMS)
    terms_of = terms_of.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).filter("of > 1")
    hits = near_hits(terms_of.select("query_id", "term_no"), index)
    return hits.groupBy("doc_id", "text_key").agg(F.count_distinct("query_id").alias("n_near"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with an
    occurring window), items_sha256 (of their ids, sorted as strings, joined by commas), contaminated, and n_near (items
    with a proximity match, see near_items).

    Null and empty texts have no words and no hits; null or empty items have no window, and an item_id that is null
    is left out of the ids but counted. Repeated rows give repeated results, repeated items count once. Ties between
    terms of one frequency go to the earlier word. Empty tables give empty results or no hits. Extra columns are
    ignored. docs is read once, for the index, which holds each row's end and so also its number of words.
    """
    named = keyed(docs)
    by = ["doc_id", "text_key"]
    with working(docs.sparkSession) as tables:
        found = written(windows(items, size), "decon-windows")
        words = found.select(F.explode("words").alias("term"))
        vocabulary, index, counts = indexed(named, words)
        hits = phrase_hits(found, vocabulary, index, counts, size)
        covered = hits.select(*by, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("at"))
        n_hit = covered.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_hit"))
        ids = hits.groupBy(*by).agg(
            F.size(F.collect_set(F.struct("item_id"))).cast("long").alias("n_items"),
            F.collect_set(F.col("item_id").cast("string")).alias("ids"),
        )
        near = near_items(found.select("item_id", "words").distinct(), vocabulary, index, counts)
        nothing = F.lit(None).cast("long")
        every = n_hit.select(*by, "n_hit", nothing.alias("n_items"), F.lit(None).cast("array<string>").alias("ids"), nothing.alias("n_near"))
        every = every.unionByName(ids.select(*by, nothing.alias("n_hit"), "n_items", "ids", nothing.alias("n_near")))
        every = every.unionByName(near.select(*by, nothing.alias("n_hit"), nothing.alias("n_items"), F.lit(None).cast("array<string>").alias("ids"), "n_near"))
        every = every.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
            *(F.max(c).alias(c) for c in ("n_hit", "n_items", "n_near")), F.first("ids", ignorenulls=True).alias("ids")
        )
        every = written(every.withColumn("sha", F.sha2(F.concat_ws(",", F.sort_array("ids")), 256)).drop("ids"), "decon-found")
        rows = index.filter("term_no = -1").select(*by, F.col("pos").cast("long").alias("n_words"))
        out = rows.join(small(every), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
        none = F.lit(0).cast("long")
        hit = F.coalesce("n_hit", none)
        out = out.select(
            "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"),
        )
        out = written(out, "decon-rows")
        tables.keep(out)
    return out


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs, with their columns, in which no window occurs; nulls, repeats and empty tables as in
    contamination()."""
    with working(docs.sparkSession) as tables:
        found = written(windows(items, size), "decon-windows")
        hits = phrase_hits(found, *indexed(keyed(docs), found.select(F.explode("words").alias("term"))), size)
        bad = written(hits.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct(), "decon-bad")
        tables.keep(bad)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own_row"), docs["doc_id"], F.xxhash64(docs["text"]).alias("text_key"))
    return rows.join(small(bad), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_anti").select("own_row.*")

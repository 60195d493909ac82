"""BM25 with dynamic pruning: the rows of retrieval.bm25, from fewer postings.

Postings lie in blocks, one for each term and block of documents, with the highest frequency and the shortest document in it, so
a bound of what the term can add to a document there is known without reading the block. A query's rarest terms give a score
that the k-th best document reaches at least. Terms whose bounds together stay below it cannot bring a document in by themselves:
their blocks are read only where documents found by the other terms could still reach it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.operators.retrieval import DIGITS, RETRIEVED, Index, document_frequencies, idf, query_terms, term_weight, top
from folioloom.operators.tables import materialized, scratch, small

#: Documents of a block, on average.
DOCUMENTS = 1024
#: Postings of a query's rarest terms, for each of its k documents, from which the first bound is made.
FIRST = 4
#: Scores are rounded, so a document this little below a bound is kept.
HAIR = 10.0**-DIGITS


class Blocks(NamedTuple):
    """lists: term, block, n, max_tf, min_dl, docs (array of doc, tf, dl); frequencies (term, df); number of documents and their
    mean length; number of blocks of documents."""

    lists: DataFrame
    frequencies: DataFrame
    n_docs: int
    avg_dl: float
    blocks: int


class Found(NamedTuple):
    """hits: query, doc, score, rank; read: query, step, postings (in the blocks that were read) and in_all (those of all blocks of
    the query's terms, in the step 'all')."""

    hits: DataFrame
    read: DataFrame


def block_of(doc: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc.cast("string")), F.lit(blocks)).cast("int")


def blocks_of(index: Index, documents: int = DOCUMENTS) -> Blocks:
    """The index in blocks, written: dealt by block of documents and sorted by term, so that a document's postings lie together
    and files are skipped by term."""
    stats = (index.documents.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl")) if index.totals is None else index.totals).first()
    n, avg = (stats["n_docs"], float(stats["avg_dl"] or 0.0)) if stats else (0, 0.0)
    blocks = max(1, -(-n // documents))
    own = block_of(F.col("doc"), blocks).alias("block")
    if index.bags is None:
        posted = index.postings.select("*", own).repartition("block")
    else:  # a document is dealt as one row, and its postings grouped where it lies
        dealt = index.bags.select("doc", "dl", F.col("words.term").alias("terms"), F.col("words.n").alias("ns"), own).repartition("block")
        each = dealt.select("doc", "dl", "block", F.explode(F.arrays_zip("terms", "ns")).alias("x"))
        posted = each.select("doc", "dl", "block", F.col("x.terms").alias("term"), F.col("x.ns").cast("long").alias("tf"))
    lists = posted.groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.sort_array(F.collect_list(F.struct("doc", "tf", "dl"))).alias("docs")
    )
    lists = materialized(lists.sortWithinPartitions("term"), "blocks")
    frequencies = document_frequencies(index.postings) if index.frequencies is None else index.frequencies
    return Blocks(lists, materialized(frequencies, "frequencies"), n, avg, blocks)


def _scores(blocks: Blocks, lists: DataFrame, terms: DataFrame) -> DataFrame:
    """query, block, doc and score over the postings of lists for the terms (query, term, w). Blocks lie together in their files,
    so sums are made before the shuffle."""
    each = lists.join(small(terms.select("query", F.col("term").alias("own_term"), "w")), F.col("term") == F.col("own_term"))
    each = each.select("query", "block", "w", F.inline("docs"))
    score = F.sum(F.col("w") * term_weight(F.col("tf"), F.col("dl"), F.lit(blocks.avg_dl)))
    return each.groupBy("query", "block", "doc").agg(score.alias("score"))


def _least(scores: DataFrame, k: int, name: str) -> DataFrame:
    """query and the k-th best score, of queries with so many documents."""
    best = top(scores, ["query"], k, "place", F.col("score").desc())
    kth = best.groupBy(F.col("query").alias(f"{name}_query")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias(name))
    return kth.filter(F.col("n") == k).drop("n")


def search(blocks: Blocks, queries: DataFrame, k: int = RETRIEVED, key: str = "item_id", body: str = "text") -> Found:
    """The k best documents of each query by BM25, ties by document, as retrieval.bm25() gives them, and the postings read."""
    spark = queries.sparkSession
    with scratch(spark) as tables:
        terms = query_terms(queries, key, body).join(blocks.frequencies, "term")
        terms = terms.withColumn("w", F.col("qtf") * idf(F.lit(blocks.n_docs), F.col("df")))
        held = blocks.lists.join(small(materialized(terms.select("term").distinct(), "pruned-names")), "term")
        bound = F.col("w") * term_weight(F.col("max_tf"), F.col("min_dl"), F.lit(blocks.avg_dl))
        heads = materialized(held.select("term", "block", "n", "max_tf", "min_dl"), "pruned-heads")
        # each term's highest bound in any block
        highest = heads.groupBy(F.col("term").alias("head_term")).agg(F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
        terms = terms.join(highest, F.col("term") == F.col("head_term")).withColumn("most", bound).drop("head_term", "max_tf", "min_dl")
        rising = Window.partitionBy("query").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        terms = materialized(terms.withColumn("before", F.coalesce(F.sum("df").over(rising), F.lit(0))), "pruned-terms")
        first = terms.filter(F.col("before") < FIRST * k)
        least = materialized(_least(_scores(blocks, held, first), k, "least"), "pruned-least")
        # from the lowest bound up, terms that cannot reach the score together
        lowest = Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        terms = terms.join(small(least), F.col("query") == F.col("least_query"), "left").withColumn("together", F.sum("most").over(lowest))
        terms = terms.withColumn("weak", F.coalesce(F.col("together") < F.col("least") - HAIR, F.lit(False)))
        terms = materialized(terms.drop("least_query"), "pruned-split")
        strong, weak = terms.filter("NOT weak"), materialized(terms.filter("weak"), "pruned-weak")
        scores = materialized(_scores(blocks, held, strong), "pruned-scores")
        least = materialized(_least(scores, k, "least"), "pruned-better")
        # what the weak terms can add in a document's block
        more = heads.join(small(weak.select("query", F.col("term").alias("own_term"), "w")), F.col("term") == F.col("own_term")).withColumn("most", bound)
        more = materialized(more.groupBy(F.col("query").alias("more_query"), F.col("block").alias("more_block")).agg(F.sum("most").alias("more")), "pruned-more")
        able = scores.join(small(more), (F.col("query") == F.col("more_query")) & (F.col("block") == F.col("more_block")), "left")
        able = able.join(small(least), F.col("query") == F.col("least_query"), "left")
        able = able.filter(F.col("least").isNull() | (F.col("score") + F.coalesce("more", F.lit(0.0)) >= F.col("least") - HAIR))
        able = materialized(able.select("query", "block", "doc", "score"), "pruned-able")
        # the weak terms' blocks that hold such documents
        places = able.select("query", "block").distinct()
        asked = materialized(places.join(small(weak.select("query", "term", "w")), "query").select("query", F.col("block").alias("own_block"), F.col("term").alias("own_term"), "w"), "pruned-asked")
        some = held.join(small(asked), (F.col("term") == F.col("own_term")) & (F.col("block") == F.col("own_block")))
        some = some.select("query", "block", "w", F.inline("docs")).repartition("block")
        added = F.col("w") * term_weight(F.col("tf"), F.col("dl"), F.lit(blocks.avg_dl))
        some = some.join(able.select("query", "block", "doc").repartition("block"), ["query", "block", "doc"], "left_semi").select("query", "block", "doc", added.alias("score"))
        whole = able.repartition("block").unionByName(some).groupBy("query", "doc").agg(F.round(F.sum("score"), DIGITS).alias("score"))
        hits = materialized(top(whole, ["query"], k, "rank", F.col("score").desc(), F.col("doc")), "pruned-hits")
        # postings in the blocks of each step
        sizes = heads.groupBy("term").agg(F.sum("n").alias("postings"))
        count = lambda step, own: own.join(sizes, "term").groupBy("query").agg(F.sum("postings").alias("postings")).withColumn("step", F.lit(step))
        third = asked.join(heads, (F.col("term") == F.col("own_term")) & (F.col("block") == F.col("own_block"))).groupBy("query").agg(F.sum("n").alias("postings")).withColumn("step", F.lit("third"))
        read = count("first", first).unionByName(count("second", strong)).unionByName(third).unionByName(count("all", terms))
        read = materialized(read.select("query", "step", "postings"), "pruned-read")
        tables.keep(hits, read)
    return Found(hits, read)

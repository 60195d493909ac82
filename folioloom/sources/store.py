"""A store of chunks and their index: documents are replaced, deleted and read by collection, each change one commit.

A commit (see snapshots) holds the new chunks, their postings, and what they change in the numbers that scores need: how many
chunks hold a term and how many words there are. So the work of an upload follows the upload and not the collection, and chunks
and index are of one version at any time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import retrieval
from folioloom.operators.tables import materialized, scratch
from folioloom.sources import snapshots
from folioloom.sources.snapshots import GONE, Version

CHUNKS, POSTINGS, FREQUENCIES = "chunks", "postings", "frequencies"


def chunks_in(spark: SparkSession, path: str, at: Version | None = None, collections: Iterable | None = None, docs: Iterable | None = None) -> DataFrame:
    """The chunks of the store at path, of its latest version or another one; only those of some collections or documents, if
    these are named."""
    return snapshots.live(spark, path, CHUNKS, at, collections, docs)


def chunk_postings(chunks: DataFrame, body: str) -> DataFrame:
    """collection, doc, chunk_id, dl and words (array of term and n) of chunks: a chunk's postings stay in one row."""
    split = chunks.select("collection", "doc", "chunk_id", T.tokens(F.col(body)).alias("words"))
    return split.select("collection", "doc", "chunk_id", F.size("words").cast("long").alias("dl"), T.counted(F.col("words")).alias("words"))


def changes(posted: DataFrame, sign: int) -> DataFrame:
    """collection, term, df and words that postings add to the merged numbers, or take away. The empty term, which no word is,
    stands for each chunk itself."""
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("n")))
    posted = posted.select("collection", "dl", F.explode(F.concat(own, "words")).alias("x")).select("collection", "dl", "x.term")
    words = F.sum(F.when(F.col("term") == "", F.col("dl")).otherwise(0))
    return posted.groupBy("collection", "term").agg((F.count(F.lit(1)) * sign).alias("df"), (words * sign).alias("words"))


def _segment(spark: SparkSession, path: str, base: Version, new: DataFrame | None, gone: DataFrame, indexed: bool, body: str) -> dict[str, snapshots.Rows]:
    tables = {} if new is None else {CHUNKS: new}
    if base.no:
        tables[GONE] = gone
    if indexed:
        if new is not None:
            tables[POSTINGS] = chunk_postings(new, body)

        def frequencies(written: dict[str, DataFrame]) -> DataFrame:
            parts = [changes(written[POSTINGS], 1)] if POSTINGS in written else []
            if POSTINGS in base.schemas:
                parts.append(changes(snapshots.live(spark, path, POSTINGS, base, wanted=gone), -1))
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            return snapshots.summed(every)

        tables[FREQUENCIES] = frequencies
    return tables


def changed(spark: SparkSession, path: str, new: DataFrame | None, gone: DataFrame, indexed: bool = False, body: str = "content") -> Version:
    """The version without the documents of gone (collection, doc), and with new chunks."""

    def build(base: Version) -> dict[str, snapshots.Rows]:
        return _segment(spark, path, base, new, gone, POSTINGS in base.schemas or (indexed and not base.no), body)

    now = snapshots.commit(spark, path, build, (FREQUENCIES,))
    return snapshots.compact(spark, path) if len(now.segments) > snapshots.SEGMENTS else now


def store_chunks(chunks: DataFrame, path: str, indexed: bool = False, body: str = "content") -> None:
    """Puts chunks (collection, doc, ...) into the store. A document that is there already is replaced as a whole; all
    others, of its collection too, stay. An empty table changes nothing. A store whose first chunks (with chunk_id) were put
    in with indexed=True keeps their index in step from then on."""
    spark = chunks.sparkSession
    with scratch(spark):
        chunks = materialized(chunks, "store-new")
        if not chunks.isEmpty():
            changed(spark, path, chunks, materialized(chunks.select("collection", "doc").distinct(), "store-gone"), indexed, body)


def delete_documents(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Removes the documents of gone (collection, doc); those that the store doesn't hold are passed over."""
    with scratch(spark):
        gone = materialized(gone.select("collection", "doc").distinct(), "store-gone")
        if snapshots.versions(spark, path) and not gone.isEmpty():
            changed(spark, path, None, gone)


def delete_collection(spark: SparkSession, path: str, collection: str) -> None:
    if snapshots.versions(spark, path):
        delete_documents(spark, path, chunks_in(spark, path, collections=[collection]).select("collection", "doc"))


def frequencies_in(spark: SparkSession, path: str, at: Version | None = None, collections: Iterable | None = None) -> DataFrame:
    """collection, term, df and words, merged over the segments: df is the number of chunks that hold the term, and in the row of
    the empty term, which has their words, the number of chunks."""
    return snapshots.summed(snapshots.live(spark, path, FREQUENCIES, at, collections))


def index_in(spark: SparkSession, path: str, at: Version | None = None, collections: Iterable | None = None) -> retrieval.Index:
    """The index of a store's chunks (doc is the chunk's id), as one index over these collections, all by default. Nothing is
    counted anew: what scores need comes from the merged numbers."""
    at = snapshots.version(spark, path) if at is None else at
    bags = snapshots.live(spark, path, POSTINGS, at, collections).select(F.col("chunk_id").alias("doc"), "dl", "words")
    each = bags.select("doc", "dl", F.explode("words").alias("x"))
    posted = each.select("doc", "x.term", F.col("x.n").cast("long").alias("tf"), "dl")
    merged = frequencies_in(spark, path, at, collections).groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    totals = merged.filter("term = ''").select(F.col("df").alias("n_docs"), (F.col("words") / F.col("df")).alias("avg_dl"))
    return retrieval.Index(posted, bags.select("doc", "dl"), merged.filter("term <> ''").select("term", "df"), totals, bags)


def index_place(path: str, collection: str) -> str:
    """The folder of a collection's saved index: a safe and short name, different for different collections (see
    text.index_file_name)."""
    safe = re.sub(r"[^A-Za-z0-9_.-]", "_", collection)[:80]
    return f"{path}/{safe}__{hashlib.sha1(collection.encode()).hexdigest()[:10]}"


def document_json(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc and document, the JSON of documents (doc, title, total_pages, metadata map) with their blocks in order."""
    own = [c for c in blocks.columns if c not in ("doc", "block_idx")]
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", *own))), lambda b: F.struct(*(b[c].alias(c) for c in own)))
    held = blocks.groupBy("doc").agg(parts.alias("blocks"))
    every = documents.join(held, "doc", "left")
    return every.select("doc", F.to_json(F.struct(F.col("doc").alias("doc_id"), "title", "total_pages", "metadata", F.coalesce("blocks", F.array()).alias("blocks"))).alias("document"))


def document_blocks(documents: DataFrame, fields: str) -> DataFrame:
    """The blocks of document JSON (column document), numbered again, with their document's id, title and pages. fields:
    the blocks' columns as DDL."""
    kind = f"doc_id string, title string, total_pages int, metadata map<string,string>, blocks array<struct<{fields}>>"
    rows = documents.select(F.from_json("document", kind).alias("d"))
    each = rows.select(F.col("d.doc_id").alias("doc"), "d.title", F.coalesce("d.total_pages", F.lit(0)).alias("total_pages"), F.posexplode("d.blocks").alias("block_idx", "block"))
    return each.select("doc", "title", "total_pages", "block_idx", "block.*")


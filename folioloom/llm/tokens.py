"""Exact histogram of encoded lengths.

Every whole document is encoded with an existing tokenizer and only its length is kept; documents of one length are one
row. Suffix sums over the lengths then give, for every context limit, what truncation at it keeps.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, written

#: Ranks of a byte-level BPE; its place on every executor is a parameter.
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how that vocabulary's text is split before its pieces are encoded.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths of one range of the two-step sums.
RANGE = 1024


def length_counter(vocabulary: str = VOCABULARY):
    """A function from text to its number of tokens."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens of each row of docs; 0 for a null or empty text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = length_counter(vocabulary)
        for batch in slices(batches, 0):
            found = [count(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["n_tokens"])

    return docs.select(F.col("text").cast("string")).mapInArrow(encoded, "n_tokens long")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each length that occurs: limit (the length), n_docs, n_docs_upto, quantile (the share of documents not
    longer), tokens_upto (in documents not longer), n_truncated (documents longer), truncated_total (tokens kept when
    every document is cut to the limit), total_docs and total_tokens.

    A limit between two lengths keeps truncated_total of the lower one plus n_truncated for each token above it.
    Null and empty texts have length 0. Repeated rows count each. An empty table gives no row. Extra columns are
    ignored. Sums run within ranges of 1024 lengths and then over ranges, so no task gets all lengths.
    """
    counts = written(lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    counts = counts.withColumn("part", F.floor(F.col("n_tokens") / RANGE))
    tokens = F.col("n_tokens") * F.col("n_docs")
    parts = counts.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum(tokens).alias("part_tokens"))
    above = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    none = F.lit(0).cast("long")
    # a row for every 1024 lengths up to the longest text
    parts = parts.select(
        "part", F.coalesce(F.sum("part_docs").over(above), none).alias("docs_after"), F.coalesce(F.sum("part_tokens").over(above), none).alias("tokens_after"),
        F.sum("part_docs").over(every).alias("total_docs"), F.sum("part_tokens").over(every).alias("total_tokens"),
    )
    longer = Window.partitionBy("part").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = counts.join(parts, "part").withColumns(
        {
            "n_truncated": F.col("docs_after") + F.coalesce(F.sum("n_docs").over(longer), none),
            "tokens_longer": F.col("tokens_after") + F.coalesce(F.sum(tokens).over(longer), none),
        }
    )
    upto = F.col("total_tokens") - F.col("tokens_longer")
    docs_upto = F.col("total_docs") - F.col("n_truncated")
    return found.select(
        F.col("n_tokens").alias("limit"), "n_docs", docs_upto.alias("n_docs_upto"), (docs_upto / F.col("total_docs")).alias("quantile"),
        upto.alias("tokens_upto"), "n_truncated", (upto + F.col("n_tokens") * F.col("n_truncated")).alias("truncated_total"),
        "total_docs", "total_tokens",
    )

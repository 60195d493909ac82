"""Models behind functions, each with a deterministic offline default.

A provider takes and returns DataFrames or Columns, so a real model can stand in as a pandas UDF that loads it once
for each worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions import text as T

#: Words whose buckets a worker remembers.
REMEMBERED = 300_000
_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    """The number in the first digits of a word's MD5."""
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) >= REMEMBERED:
            _buckets.clear()
        found = _buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16)
    return found


def bucket_counts(words: pa.Array, dims: int) -> pa.Array:
    """How many of each row's words fall into each bucket, divided by the length of these numbers as a vector."""
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    each = words.flatten().dictionary_encode()
    buckets = np.array([_bucket(w) % dims for w in each.dictionary.to_pylist()], np.int64)
    place = np.repeat(np.arange(len(words)) * dims, sizes) + (buckets[each.indices.to_numpy()] if len(each) else 0)
    counts = np.bincount(place.astype(np.int64), minlength=len(words) * dims).reshape(-1, dims).astype(float)
    units = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-12)
    return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * dims, units.ravel())


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Bag of words hashed into `dims` buckets (by the first digits of their MD5), of unit length: a stand-in for a model. The
    JVM cuts words; a worker hashes each distinct word once and counts a batch's buckets together."""

    @F.arrow_udf("array<double>")
    def embedded(words: pa.Array) -> pa.Array:
        return bucket_counts(words, dims)

    return embedded(T.tokens(F.coalesce(text, F.lit(""))))


def top_sentences(query: Column, context: Column, prompt: Column | None = None, n: int = 2) -> Column:
    """The sentences of the context most like the question, best first, as an answer."""
    asked = F.array_distinct(T.words(F.lower(query)))
    scored = F.transform(T.sentences(context), lambda s, i: F.struct(T.overlap_score(asked, s).alias("score"), (-i).alias("at"), s.alias("s")))
    best = F.slice(F.reverse(F.array_sort(scored)), 1, n)
    return F.array_join(F.transform(best, lambda x: x["s"]), " ")


def overlap_label(answer: Column, context: Column, labels: tuple[str, str, str]) -> Column:
    """A verdict by the share of the answer's words that the context holds."""
    own = F.array_distinct(T.words(F.lower(answer)))
    share = F.size(F.array_intersect(own, T.words(F.lower(context)))) / F.greatest(F.size(own), F.lit(1))
    return F.when(share >= 0.7, labels[0]).when(share >= 0.3, labels[1]).otherwise(labels[2])


@dataclass(frozen=True)
class Providers:
    """embed(text), score(query, text), generate(query, context, prompt), judge(answer, context, labels), rewrite(query), and
    write(prompt), which is None where no model writes."""

    embed: Callable[[Column], Column] = hashed_embedding
    score: Callable[[Column, Column], Column] = field(default=lambda q, t: T.overlap_score(F.array_distinct(T.words(F.lower(q))), t))
    generate: Callable[[Column, Column, Column], Column] = top_sentences
    judge: Callable[[Column, Column, tuple], Column] = overlap_label
    rewrite: Callable[[Column], Column] = field(default=lambda q: q)
    write: Callable[[Column], Column] | None = None

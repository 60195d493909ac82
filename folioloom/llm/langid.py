"""Language ID by rank-order profiles.

The most frequent 1- to 3-grams of letters, by rank, are a language's profile. A document's own most frequent n-grams
are compared with each: the sum of how far each n-gram is out of place, and the longest distance for one that the
profile lacks. The least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices

#: N-grams of a profile, and the distance of one that a profile lacks.
PROFILE = 300
#: Counted n-grams that a task holds before it hands them on.
HELD = 2_000_000
#: No language: the text is null or has no letter.
UNKNOWN = "und"
#: Characters that are turned into n-grams at once; counts of parts add up to those of the whole text.
PART = 1_000_000


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    found = np.zeros(0x110000, bool)
    found[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return found


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as sorted numbers, with their counts. Letters are lower-cased; each run of other
    characters, and the text's ends, are one boundary mark, code point 1: three code points of 21 bits make a number."""
    letter, found, held = _letters(), [], np.ones(1, np.uint64)
    starts = range(0, len(text), PART)
    for at in starts:
        points = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        points = np.where(letter[points], points, np.uint64(1))
        fresh = len(points)
        points = np.concatenate([held, points, np.ones(int(at == starts[-1]), np.uint64)])
        points = points[np.concatenate([[True], (points[1:] != 1) | (points[:-1] != 1)])]
        pairs = (points[:-1] << np.uint64(21)) | points[1:]
        threes = (pairs[:-1] << np.uint64(21)) | points[2:]
        begun = len(held) - 1  # pairs that the part before has counted
        found += [points[len(held) :], pairs[begun:], threes]
        held = points[-2:] if fresh else held
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.concatenate(found)
    return np.unique(codes[codes != 1], return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams; ties go to the smaller number."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"],
            )
        held.clear()

    for batch in slices(batches, 1):
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            held.setdefault(lang.as_py(), []).append(grams(text.as_py()))
        for lang, parts in held.items():
            held[lang] = [merged(parts)]
        if sum(len(p[0][0]) for p in held.values()) > HELD:
            yield from out()
    yield from out()


def profiles(labelled: DataFrame) -> dict[str, list[int]]:
    """Each language's profile, most frequent n-gram first, from all rows of labelled (lang, text) that have both.
    At most PROFILE n-grams of each language reach the driver."""
    rows = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    found: dict[str, list[int]] = {}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


class Profiles:
    """Languages' ranks by n-gram, for one lookup of a document's n-grams."""

    def __init__(self, of: dict[str, list[int]]):
        self.langs = sorted(of)
        self.codes = np.unique(np.array([g for x in of.values() for g in x], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), np.iinfo(np.int64).max // 2, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, of[lang]), i] = np.arange(len(of[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language, and how near its profile is: 1 if all n-grams are in their places, 0 if it has none."""
        codes, counts = grams(text or "")
        if not self.langs or not len(codes):
            return UNKNOWN, 0.0
        own = ranked(codes, counts).view(np.int64)
        at = np.searchsorted(self.codes, own)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        off = np.minimum(np.abs(self.ranks[at] - np.arange(len(own))[:, None]), PROFILE).sum(axis=0)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (PROFILE * len(own)))


def predicted(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs. Rows whose crc32 of the doc_id's text leaves `fold`
    when divided by `folds` are held out of the profiles, and so are rows without lang.

    A null text, or one without a letter, is 'und' with score 0, and so is all if no row could be learned from. Ties
    between languages go to the first by name. A null doc_id counts as empty text. Repeated rows give repeated results,
    an empty table an empty one. Extra columns are ignored; lang, source and doc_id have no part in a prediction.
    """
    own = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    rows = docs.select("doc_id", (own % folds == fold).alias("held_out"), "lang", F.col("text").cast("string"))
    known = docs.sparkSession.sparkContext.broadcast(profiles(rows.filter("NOT held_out")))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Profiles(known.value).judge
        for batch in slices(batches, 2):
            found = [judge(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return rows.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(judged, schema)

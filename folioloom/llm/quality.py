"""Quality rules by compression bands.

A text's compressed size over its size (zstandard) is low if it repeats itself and near 1 if it is noise. Both ratios,
of the whole text and of its fixed chunks, must lie in a band that depends on the length: short texts have little to
refer back to and so compress less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: (Size in bytes from which the band holds, lowest ratio of the whole text, highest one, highest one of wide texts).
#: Prose that names few things twice stays well inside; a text at half the usual ratio of its length says everything
#: twice. The highest ones lie just above what 99 of 100 pieces of clean prose of that size reach (wide ones: Korean).
BANDS = (
    (0, 0.0, 9.0, 9.0),
    (160, 0.42, 0.92, 1.02),
    (200, 0.42, 0.87, 1.02),
    (240, 0.42, 0.82, 1.00),
    (320, 0.38, 0.79, 0.93),
    (400, 0.38, 0.75, 0.88),
    (480, 0.38, 0.72, 0.84),
    (560, 0.38, 0.70, 0.82),
    (640, 0.33, 0.68, 0.80),
    (800, 0.33, 0.65, 0.77),
    (960, 0.33, 0.625, 0.735),
    (1280, 0.29, 0.60, 0.70),
    (1920, 0.29, 0.575, 0.65),
    (2560, 0.26, 0.555, 0.63),
    (4096, 0.26, 0.535, 0.60),
    (8192, 0.22, 0.51, 0.56),
    (65536, 0.18, 0.48, 0.52),
)
#: Part of a text's or chunk's bytes that continue a character, from which it is wide; below that, limits lie in proportion
#: between those of plain and of wide texts, so no letter more or less changes the band.
WIDE = 1 / 16
#: Two scripts side by side repeat less than either: (share of continuing bytes, what it adds to the highest ratio), with straight
#: lines between. Measured on pieces of documentation in Korean and English.
MIXED = ((1 / 16, 0.0), (1 / 8, 0.05), (3 / 8, 0.05), (5 / 8, 0.0))
#: Bytes of a chunk; a remainder shorter than MIN_CHUNK belongs to the chunk before it.
CHUNK, MIN_CHUNK = 4096, 1024
#: Lowest ratio of a chunk (the highest is that of BANDS at its size), and the largest part of a text's chunks that may
#: lie outside.
CHUNK_LOW, BAD_CHUNKS = 0.20, 0.25
LEVEL = 3

#: Base rule: least words, and most words (in hundredths) that lie in repeated 8-word windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks int, n_bad_chunks int, low double, high double"
)
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_CONTINUING = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_rng = np.random.default_rng(20240601)
_FACTORS = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        keys += mixed[k : k + n] * _FACTORS[k]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    span = np.arange(WINDOW)
    sure = (ids[a[:, None] + span] == ids[b[:, None] + span]).all(axis=1)  # equal keys, but the windows decide
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([a[sure], b[sure]]))
    marks[starts] += 1
    np.subtract.at(marks, starts + WINDOW, 1) if len(starts) else None
    return int((np.cumsum(marks)[:-1] > 0).sum())


def chunks(size: int) -> list[tuple[int, int]]:
    """Starts and ends of the fixed chunks of a text of that many bytes."""
    ends = list(range(CHUNK, size + 1, CHUNK)) or [size]
    if size - ends[-1] >= MIN_CHUNK:
        ends.append(size)
    else:
        ends[-1] = size
    return list(zip([0, *ends[:-1]], ends, strict=True))


def band(text: bytes) -> tuple[float, float]:
    """Lowest and highest ratio allowed to a text, by its size and by its share of bytes that continue a character."""
    share = (len(text) - len(text.translate(None, _CONTINUING))) / max(1, len(text))
    low, high, wider = next(b[1:] for b in reversed(BANDS) if len(text) >= b[0])
    return low, high + (wider - high) * min(1.0, share / WIDE) + float(np.interp(share, *zip(*MIXED, strict=True)))


def judge(text: bytes | None, compress) -> tuple:
    """The columns of SCHEMA after doc_id."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    repeat = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeat > MOST_REPEATED * len(words)
    low, high = band(text)
    ratio = len(compress(text)) / len(text) if text else 0.0
    parts = chunks(len(text))
    bad = 0
    if len(text) >= CHUNK:
        for a, b in parts:
            part = text[a:b]
            r = len(compress(part)) / len(part) if len(parts) > 1 else ratio
            bad += not CHUNK_LOW <= r <= band(part)[1]
    kept = not failed and low <= ratio <= high and bad <= BAD_CHUNKS * len(parts)
    return (
        len(words), len(text.translate(None, _NOT_CHARS)), len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeat, failed, kept, ratio, len(parts), bad, low, high,
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in slices(batches, 1):
        texts = batch.column(1).cast(pa.binary())
        rows = [judge(t.as_py(), compress) for t in texts]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def verdicts(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text).

    A null or empty text has no words, so it fails the base rule. Repeated rows give repeated results; extra columns
    are ignored. Whole texts are read, however long; a task holds one batch of them.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judged, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that verdicts() keeps: the same rule over the whole rows, unshuffled."""
    schema = docs.schema
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in slices(batches, at):
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([judge(t.as_py(), compress)[6] for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, schema)

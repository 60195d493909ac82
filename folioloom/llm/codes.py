"""Vector codes by product quantization, its codebooks fitted with Yinyang k-means on integers.

Entries of a codebook are put into groups. For each part of a vector a state keeps its entry and, for each group, a lower
bound of the distance to the group's other entries. After the entries have moved, bounds fall by the farthest move in their
group; only groups whose bound no longer exceeds the distance to the own entry are looked at again. Distances that decide are
exact integers, and of equal ones the lower index wins, so the result is that of plain Lloyd rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import small, working, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries for each group.
GROUP = 10
#: Bounds are halves, rounded down; this is the largest of them.
_MOST = 65504.0
_LONGEST = 2**63 - 1


class Codebooks(NamedTuple):
    """entries (part, entry, position) as integers; groups (part, entry), numbered from 0 in each part."""

    entries: np.ndarray
    groups: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, key: str = "vec_id", body: str = "embedding", *others: str) -> DataFrame:
    """key, v (integers) and the other columns of rows whose vectors hold finite numbers only; an integer beyond a long is the
    nearest long."""
    finite = F.forall(body, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col(body).isNotNull() & (F.size(body) > 0) & finite)
    return kept.select(F.col(key), F.transform(body, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"), *others)


def exact(rows: np.ndarray, entries: np.ndarray) -> bool:
    """Whether sums of products of these integers are exact as 64-bit floats."""
    most = max(int(abs(x).max()) if x.size else 0 for x in (rows, entries))
    return 4 * rows.shape[-1] * most * most < 2**53


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (row, entry): floats that hold exact integers, or Python's integers where those wouldn't."""
    if rows.dtype == object:
        return ((rows[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return (rows**2).sum(axis=1)[:, None] - 2 * (rows @ entries.T) + (entries**2).sum(axis=1)[None, :]


def grouped(entries: np.ndarray) -> np.ndarray:
    """Groups (part, entry) of entries near each other: a few rounds of k-means over each codebook. Groups decide what is
    looked at, and not the result."""
    out = np.zeros(entries.shape[:2], np.int64)
    for p, own in enumerate(entries.astype(np.float64)):
        centres = own[:: GROUP].copy()
        for _ in range(5):
            near = ((own[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            for g in np.unique(near):
                centres[g] = own[near == g].mean(axis=0)
        out[p] = np.unique(near, return_inverse=True)[1]
    return out


def lowered(x: np.ndarray) -> np.ndarray:
    """Bounds as halves that are not above them."""
    x = np.clip(x, 0.0, _MOST)
    half = x.astype(np.float16)
    return np.where(half.astype(np.float64) > x, np.nextafter(half, np.float16(0)), half)


def roots(squared: np.ndarray, off: float) -> np.ndarray:
    """Square roots, off by a hair to the safe side."""
    return np.sqrt(squared.astype(np.float64)) * (1.0 + off)


def assigned(v: np.ndarray, books: Codebooks, near: np.ndarray | None, low: np.ndarray | None, fell: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The entry of each part of v (row, part, position), new bounds (row, part, group), squared distances (row, part), and how
    many distances were made. near, low: those of the round before, none at first; fell: the farthest moves (part, group)."""
    n, parts, _ = v.shape
    count = books.entries.shape[1]
    width = int(books.groups.max()) + 1
    own_near, own_low = np.zeros((n, parts), np.int64), np.full((n, parts, width), _MOST, np.float16)
    found = np.zeros((n, parts), object if v.dtype == object else np.float64)
    at, made = np.arange(n), 0
    for p in range(parts):
        rows, entries, groups = v[:, p], books.entries[p].astype(v.dtype), books.groups[p]
        order = np.argsort(groups, kind="stable")
        starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
        if near is None:
            d = distances(rows, entries)
            made += d.size
            best = d.argmin(axis=1)
            least = d[at, best]
            bound = None
        else:
            best = near[:, p].astype(np.int64)
            first = least = ((rows - entries[best]) ** 2).sum(axis=1)
            bound = np.maximum(low[:, p].astype(np.float64) - fell[p][None, :], 0.0) * (1.0 - 1e-9)
            d = np.full((n, count), np.inf, object if v.dtype == object else np.float64)
            open_groups = bound <= roots(least, 1e-9)[:, None]
            made += n
            for g in range(len(starts)):
                asked = np.flatnonzero(open_groups[:, g])
                members = np.flatnonzero(groups == g)
                if not len(asked):
                    continue
                some = distances(rows[asked], entries[members])
                made += some.size
                d[asked[:, None], members] = some
                nearest = some.argmin(axis=1)
                other, index = some[np.arange(len(asked)), nearest], members[nearest]
                better = (other < least[asked]) | ((other == least[asked]) & (index < best[asked]))
                least, best = least.copy(), best.copy()
                least[asked[better]], best[asked[better]] = other[better], index[better]
        own_near[:, p], found[:, p] = best, least
        d[at, best] = np.inf
        others = np.minimum.reduceat(d[:, order], starts, axis=1)
        others = roots(np.where(others == np.inf, _MOST**2, others), -1e-9)
        if bound is not None:
            held = ~open_groups[:, : len(starts)]
            # an entry that was left counts in its group's bound from now on
            left = held & (groups[near[:, p].astype(np.int64)][:, None] == np.arange(len(starts))[None, :]) & (best != near[:, p])[:, None]
            kept = np.where(left, np.minimum(bound[:, : len(starts)], roots(first, -1e-9)[:, None]), bound[:, : len(starts)])
            others = np.where(held, kept, others)
        own_low[:, p, : len(starts)] = lowered(others)
    return own_near, own_low, found, made


def _parts(column: pa.Array, books: Codebooks) -> np.ndarray:
    """Lists of integers as (row, part, position): floats where these are exact, else Python's integers."""
    parts, _, width = books.entries.shape
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, width)
    return flat.astype(np.float64) if exact(flat, books.entries) else flat.astype(object)


def _moved(before: Codebooks, after: Codebooks) -> np.ndarray:
    """The farthest move of an entry (part, group), not below the true one."""
    moves = roots(((before.entries.astype(object) - after.entries.astype(object)) ** 2).sum(axis=2), 1e-9)
    out = np.zeros((len(moves), int(before.groups.max()) + 1))
    for p in range(len(moves)):
        np.maximum.at(out[p], before.groups[p], moves[p])
    return out


def stepped(state: DataFrame, books: Codebooks, fell: np.ndarray | None) -> DataFrame:
    """state (…, v, near, low) with the entries and bounds of another assignment, and error, the sum of squared distances."""
    first = fell is None
    schema = StructType([*(f for f in state.schema if f.name not in ("near", "low", "error", "made")), *(StructField(c, BinaryType()) for c in ("near", "low"))]).add("error", "long").add("made", "long")
    kept = [f.name for f in schema][:-4]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, width = books.entries.shape[0], int(books.groups.max()) + 1
        for batch in batches:
            if not len(batch):
                continue
            v = _parts(batch.column("v"), books)
            near = low = None
            if not first:
                near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(len(batch), parts)
                low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float16).reshape(len(batch), parts, width)
            near, low, found, made = assigned(v, books, near, low, fell)
            error = [min(int(x), _LONGEST) for x in found.sum(axis=1)]
            own = [pa.array([x.tobytes() for x in near.astype(np.uint8)], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(error, pa.int64())]
            counted = pa.array([made] + [0] * (len(batch) - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own, counted], names=schema.names)

    return state.drop("error", "made").mapInArrow(rows, schema)


def recentred(state: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks with each entry replaced by its parts' mean, rounded down; an entry without parts stays. Each task sums its
    own rows; only a row for each part and entry leaves it."""
    parts, count, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * count, width), object), np.zeros(parts * count, np.int64)
        for batch in batches:
            if len(batch):
                v = _parts(batch.column("v"), books)
                near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(len(batch), parts)
                slot = (near.astype(np.int64) + np.arange(parts) * count).ravel()
                flat = v.reshape(-1, width)
                n += np.bincount(slot, minlength=parts * count)
                own = np.zeros((parts * count, width), v.dtype)
                np.add.at(own, slot, flat)
                total += np.array([[int(x) for x in r] for r in own], object) if v.dtype != object else own
        used = np.flatnonzero(n)
        columns = [pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), *(pa.array([str(x) for x in total[used, i]], pa.string()) for i in range(width))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *(f"s{i}" for i in range(width))])

    kind = ", ".join(["slot int, n long", *(f"s{i} string" for i in range(width))])
    each = state.select("v", "near").mapInArrow(sums, kind)
    wide = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    entries = books.entries.astype(object).reshape(-1, width).copy()
    for r in each.groupBy("slot").agg(F.sum("n").alias("n"), *wide).collect():  # one row for each entry
        entries[r["slot"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return Codebooks(entries.reshape(parts, count, width).astype(np.int64), books.groups)


def fitted(vectors: DataFrame, *others: str, key: str = "vec_id", body: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks] | None:
    """The last state (key, others, v, near, low, error) and codebooks; None without a usable vector. Runs inside working()."""
    rows = written(integers(vectors, key, body, *others), "codes-rows")
    usable = F.size("v") % parts == 0
    first = rows.filter(usable).orderBy(F.col(key).asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if first is None:
        return None
    rows = rows.filter(F.size("v") == first["n"])
    starts = [r["v"] for r in rows.orderBy(F.col(key).asc_nulls_last(), "v").select("v").limit(entries).collect()]
    start = np.array(starts, np.int64).reshape(len(starts), parts, -1).transpose(1, 0, 2)
    books = Codebooks(start, grouped(start))
    state, fell = rows, None
    for i in range(rounds):
        state = written(stepped(state, books, fell), f"codes-state-{i}")
        before, books = books, recentred(state, books)
        fell = _moved(before, books)
    return written(stepped(state, books, fell), "codes-state"), books


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error and codebooks_sha256 of vectors (vec_id, embedding, label).

    Rows whose vector is null or empty, or holds a null, NaN or infinity, go; so do those of another length than the first kept
    vector's, by vec_id, whose length the parts divide. A null vec_id comes last. Rows that repeat a vec_id are vectors of their
    own, ordered by their components. With fewer vectors than entries the codebooks are that small. Errors beyond a long are the
    largest long. A null label is a label. An empty table gives no row. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    with working(spark) as tables:
        found = fitted(vectors, "label", parts=parts, entries=entries, rounds=rounds)
        if found is None:
            kind = dict(vectors.dtypes)["vec_id"]
            return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
        state, books = found
        state = state.select("vec_id", "label", F.lower(F.hex("near")).alias("code"), "error")
        total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
        sums = written(state.groupBy(F.col("label").alias("own_label")).agg(total.alias("label_error")), "codes-labels")
        out = state.join(small(sums), F.col("label").eqNullSafe(F.col("own_label")))
        out = written(out.select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256")), "codes")
        tables.keep(out)
    return out


def decoded(rows: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """rows with the vector (array of doubles) that each code stands for."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in e)) for e in part)) for part in books.entries))
    digits = F.sequence(F.lit(0), F.lit(len(books.entries) - 1))
    at = lambda p: F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.withColumn("vector", F.flatten(F.transform(digits, lambda p: F.get(F.get(entries, p), at(p)))))

"""Approximate nearest neighbours: an inverted file of cells around trained centres, kept as versions of a store.

Centres are trained on a bounded sample; every vector is then assigned to the cell of its nearest centre. A search looks into the
cells nearest to each query only and scores their vectors exactly, so with all cells it is the exact search. Cells are the
collections of a snapshot store: upserts and deletions are commits, and cells that no query asks for are neither listed nor
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from folioloom.operators import retrieval
from folioloom.operators.retrieval import QUERY_BLOCK, Best, matrix
from folioloom.operators.tables import materialized, scratch
from folioloom.sources import snapshots

VECTORS, CENTRES = "vectors", "centres"
#: Collections of the table of centres: these, and the part of them that a search needs.
CENTRE, PART = -1, -2
#: Vectors that centres are trained on, rounds of training, and cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 50_000, 10, 4096
#: Recall that a search has on the sample, for its number of cells if nothing else is said; the sample's queries that it is
#: measured with, and the neighbours of each.
RECALL, MEASURED, NEIGHBOURS = 0.95, 200, 20


def finite(vectors: DataFrame, key: str, body: str) -> DataFrame:
    """doc, v of rows whose vector is there, not empty and holds finite numbers only; other columns stay."""
    own = F.forall(F.col(body), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(body).isNotNull() & (F.size(body) > 0) & own)
    others = [c for c in vectors.columns if c not in (key, body)]
    return rows.select(F.col(key).alias("doc"), F.col(body).cast("array<double>").alias("v"), *others)


def trained(rows: DataFrame, cells: int) -> tuple[np.ndarray, float]:
    """Unit centres of rows (doc, v) by k-means on directions, and the part of them that a search needs for RECALL. SAMPLE rows
    are read, those whose ids hash lowest, so that the sample is the same each time."""
    some = rows.select(F.xxhash64(F.col("doc").cast("string")).alias("h"), "v").orderBy("h", "v").limit(SAMPLE)
    x = matrix(some.select("v").toArrow().column("v").combine_chunks())
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[: min(cells, len(x))].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centres)) > 0
        centres[held] = sums[held]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres, needed(x, centres)


def needed(x: np.ndarray, centres: np.ndarray) -> float:
    """The smallest part of the cells, nearest first, that holds RECALL of the nearest neighbours of some of the vectors: far
    less for vectors in clusters than for those without any."""
    asked = x[:: max(1, len(x) // MEASURED)][:MEASURED]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    cell = (x @ centres.T).argmax(axis=1)
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")  # a cell's place for each query
    places = np.sort(np.take_along_axis(order, cell[near], axis=1).ravel())
    return float(places[int(np.ceil(RECALL * len(places))) - 1] + 1) / len(centres)


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (doc, v, ...) with collection, the number of the cell whose centre is nearest (the lowest of equal ones)."""
    schema = StructType([StructField("collection", LongType()), *rows.schema])
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS vectors

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = np.round(matrix(batch.column("v")) @ shared.value.T, 9).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), *batch.columns], names=["collection", *batch.schema.names])

    return rows.mapInArrow(cells, schema)


def build(vectors: DataFrame, path: str, cells: int | None = None, key: str = "vec_id", body: str = "embedding") -> None:
    """Writes the index of vectors (key, body, and columns that searches filter by) at path. cells: the square root of the number
    of vectors by default, MOST_CELLS at most. Vectors that are null or hold null, NaN or infinity are left out."""
    spark = vectors.sparkSession
    with scratch(spark):
        rows = materialized(finite(vectors, key, body), "ann-rows")
        n = rows.count()
        centres, part = trained(rows, cells or min(MOST_CELLS, max(1, round(n**0.5)))) if n else (np.zeros((1, 1)), 1.0)
        # no cell has these numbers, so no vector that goes takes a centre along
        kept = spark.createDataFrame([(CENTRE, i, c.tolist()) for i, c in enumerate(centres)] + [(PART, 0, [part])], "collection long, doc long, v array<double>")
        own = materialized(assigned(rows, centres), "ann-cells")
        snapshots.commit(spark, path, lambda base: {CENTRES: kept, VECTORS: own})


def centres_of(spark: SparkSession, path: str, at: snapshots.Version) -> np.ndarray:
    found = snapshots.live(spark, path, CENTRES, at, collections=[CENTRE]).orderBy("doc").select("v").toArrow()  # MOST_CELLS rows
    return matrix(found.column("v").combine_chunks())


def _gone(spark: SparkSession, path: str, at: snapshots.Version, docs: DataFrame) -> DataFrame:
    """collection and doc of the index's vectors among docs (doc)."""
    held = snapshots.live(spark, path, VECTORS, at).select("collection", "doc")
    return held.join(docs, "doc", "left_semi")


def upsert(vectors: DataFrame, path: str, key: str = "vec_id", body: str = "embedding") -> None:
    """Puts vectors into the index in place of those with the same ids, as one commit; centres stay."""
    spark = vectors.sparkSession
    with scratch(spark):
        rows = materialized(finite(vectors, key, body), "ann-new")

        def change(base: snapshots.Version) -> dict[str, DataFrame]:
            new = materialized(assigned(rows, centres_of(spark, path, base)), "ann-new-cells")
            # a vector may have left its cell
            return {VECTORS: new, snapshots.GONE: materialized(_gone(spark, path, base, rows.select("doc")), "ann-old")}

        snapshots.commit(spark, path, change)


def remove(spark: SparkSession, path: str, docs: DataFrame) -> None:
    """Deletes the vectors of docs (doc) from the index."""
    with scratch(spark):
        snapshots.commit(spark, path, lambda base: {snapshots.GONE: materialized(_gone(spark, path, base, docs.select("doc")), "ann-gone")})


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = retrieval.RETRIEVED, probes: int | None = None, where: Column | None = None, at: snapshots.Version | None = None) -> DataFrame:
    """query, doc, score, rank: the best k by cosine among the vectors in each query's `probes` nearest cells (by default as many
    as the sample needed for RECALL) that pass the filter. queries: query, vector."""
    at = snapshots.version(spark, path) if at is None else at
    centres = centres_of(spark, path, at)
    if not probes:
        part = snapshots.live(spark, path, CENTRES, at, collections=[PART]).first()["v"][0]
        probes = int(np.ceil(part * len(centres)))
    probes = min(len(centres), probes)
    asked = materialized(queries.select("query", F.col("vector").cast("array<double>").alias("v")), "ann-queries")
    number = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for i in range(number):
        block = (asked if number == 1 else asked.filter(F.pmod(F.xxhash64("query"), F.lit(number)) == i)).toArrow()  # about QUERY_BLOCK vectors
        names, vectors = block.column("query").combine_chunks(), matrix(block.column("v").combine_chunks())
        if not len(names):
            continue
        asking = None if probes == len(centres) else asked_cells(vectors, centres, probes)
        rows = snapshots.live(spark, path, VECTORS, at, collections=None if asking is None or len(asking) == len(centres) else sorted(asking))
        rows = (rows if where is None else rows.filter(where)).select("doc", "v", "collection")
        schema = StructType([StructField("query", asked.schema["query"].dataType), StructField("doc", rows.schema["doc"].dataType), StructField("score", DoubleType())])
        best = rows.mapInArrow(_scored(spark.sparkContext.broadcast((names, vectors, asking)), k), schema)
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind = f"query {asked.schema['query'].dataType.simpleString()}, doc string, score double, rank int"
        return spark.createDataFrame([], kind)
    return retrieval.top(found, ["query"], k, "rank", F.col("score").desc(), F.col("doc"))


def asked_cells(vectors: np.ndarray, centres: np.ndarray, probes: int) -> dict[int, np.ndarray]:
    """The queries, by number, that look into each cell: one sort of all pairs."""
    near = np.argsort(-np.round(vectors @ centres.T, 9), axis=1, kind="stable")[:, :probes].ravel()
    order = np.argsort(near, kind="stable")
    cells, first = np.unique(near[order], return_index=True)
    return {int(c): own for c, own in zip(cells, np.split(order // probes, first[1:]), strict=True)}


def _scored(shared, k: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, asking = shared.value
        best = Best(names, k)
        for batch in batches:
            if asking is None:  # all queries look into all cells
                best.add(batch.column("doc"), matrix(batch.column("v")), vectors, np.arange(len(names)))
                continue
            cells = batch.column("collection").to_numpy()
            for cell in np.unique(cells):
                queries = asking.get(int(cell))
                if queries is not None:
                    own = pa.array(np.flatnonzero(cells == cell))
                    best.add(batch.column("doc").take(own), matrix(batch.column("v").take(own)), vectors[queries], queries)
        yield from best.rows()

    return scored

"""Near-duplicates by b-bit MinHash.

A Scheme says how wide shingles are and how alike links must be; what follows gives op5's, of three words and 0.85.
Rows with equal sets of shingles are one node, whose number has nothing to do with their doc_id, so a doc_id may stand in
several nodes. Every node gets 120 minima; bands of five make buckets, and the low four bits of each minimum are packed
into words. Within a bucket the share of equal low bits, corrected for chance collisions, estimates the similarity. First the pairs of each bucket's spanning forest by estimate are compared
on full sets, which merges nodes into components with a comparison or so for each node. Then all pairs that may still be
links across components are compared within their bucket's task, bucket by bucket, so no row is made for a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small, working, written

#: Low bits kept of each minimum.
BITS = 4


@dataclass(frozen=True)
class Scheme:
    """Shingles of `width` words; a link if 100 * intersection >= least * union; `bands` bands of `rows` minima."""

    width: int
    least: int
    bands: int
    rows: int

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def proposed(self) -> float:
        """Estimates at least this high are confirmed on full sets: five standard deviations below the similarity of links."""
        chance = 1 / 2**BITS
        equal = chance + (1 - chance) * self.least / 100
        deviation = (equal * (1 - equal) / self.minima) ** 0.5 / (1 - chance)
        return int(100 * (self.least / 100 - 5 * deviation)) / 100


#: The contract of op5. At a similarity of 0.85 the chance that no band of five is equal in both is (1 - 0.85^5)^24, under
#: one in a million.
OP5 = Scheme(3, 85, 24, 5)
#: Near copies of the pipeline. At a similarity of 0.8 that chance is (1 - 0.8^4)^27, under one in a million too.
STAGE = Scheme(5, 80, 27, 4)
#: A heavier bucket is divided by further bands for the spanning forests, and into blocks for the other comparisons. A node
#: weighs 1, and 1 more for each HEAVY shingles, so a task holds at most about LARGE * HEAVY shingles (128 MB).
LARGE, FURTHER, HEAVY = 2048, 6, 8192

_rng = np.random.default_rng(97)
#: Factors for 128 minima at most, bands of 8 rows at most, 64 bands at most and shingles of 16 words at most.
_ODD = _rng.integers(1, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, 64, dtype=np.uint64)
_SHINGLE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)



def signed_schema(schemes: tuple[Scheme, ...]) -> str:
    """doc_id, text_key (a hash of the text; with doc_id it names a row or repeated ones), set_key (equal if the sets of
    all schemes are), and each scheme's number of shingles, bands and planes."""
    each = (f"n_{i} long, bands_{i} array<long>, planes_{i} array<long>" for i in range(len(schemes)))
    return ", ".join(["doc_id long, text_key long, set_key binary", *each])



def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, scheme: Scheme = OP5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of runs of the scheme's width, or of all words if there are fewer;
    none without words. Words are split at ASCII white space, A-Z lower-cased."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w.as_buffer() if w.is_valid else b"") for w in coded.dictionary], np.uint64)
    words = names[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.uint64)
    blank = len(names) > 0 and np.asarray(pc.equal(pc.binary_length(flat), 0))
    width = scheme.width
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs += words[k : k + len(runs)] * _SHINGLE[k]
    runs = mixed(runs)
    found = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            found.append(np.unique(runs[a : b - width + 1]))
        elif b - a == 0 or (b - a == 1 and blank[a]):
            found.append(np.zeros(0, np.uint64))
        else:
            part = words[a:b] * _SHINGLE[: b - a]
            found.append(mixed(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
    return found


def minima(shingles: np.ndarray, scheme: Scheme = OP5) -> np.ndarray:
    """The scheme's minima of a set that isn't empty."""
    odd = _ODD[: scheme.minima, None]
    low = np.full(scheme.minima, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[None, i : i + 2048] * odd).min(axis=1), out=low)
    return low


def packed(low: np.ndarray, scheme: Scheme = OP5) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of minima: band hashes (scheme.bands a row) and the low bits, as BITS planes of two words each."""
    bands = mixed((low.reshape(-1, scheme.bands, scheme.rows) * _MIX[: scheme.rows]).sum(axis=2, dtype=np.uint64) + _BAND[: scheme.bands])
    planes = []
    for bit in range(BITS):
        bits = np.zeros((len(low), 128), np.uint8)
        bits[:, : scheme.minima] = (low >> np.uint64(bit)) & np.uint64(1)
        planes.append(np.packbits(bits, axis=1).view(np.uint64))
    return bands, np.concatenate(planes, axis=1) if len(low) else np.zeros((0, 2 * BITS), np.uint64)


def likeness(planes: np.ndarray, others: np.ndarray, scheme: Scheme = OP5) -> np.ndarray:
    """Estimated similarity of each row of planes to each row of others, corrected for chance collisions."""
    words = planes.shape[1] // BITS
    unlike = np.zeros((len(planes), len(others), words), np.uint64)
    for bit in range(BITS):
        at = slice(bit * words, (bit + 1) * words)
        unlike |= planes[:, None, at] ^ others[None, :, at]
    equal = 1 - np.bitwise_count(unlike).sum(axis=2) / scheme.minima
    chance = 1 / 2**BITS
    return (equal - chance) / (1 - chance)


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    offsets = np.arange(0, (len(values) + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64).reshape(-1)))


def _signed(batches: Iterator[pa.RecordBatch], schemes: tuple[Scheme, ...]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in signed_schema(schemes).split(", ")]
    for batch in slices(batches, 2):
        digests, columns = [b""] * len(batch), []
        for scheme in schemes:
            sets = shingle_sets(batch.column(2), scheme)
            none = np.zeros(scheme.minima, np.uint64)
            low = np.array([minima(s, scheme) if len(s) else none for s in sets], np.uint64)
            bands, planes = packed(low.reshape(-1, scheme.minima), scheme)
            digests = [d + xxhash.xxh3_128_digest(s.tobytes()) for d, s in zip(digests, sets, strict=True)]
            columns += [pa.array([len(s) for s in sets], pa.int64()), _lists(bands), _lists(planes)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *columns], names=names)


def _sets(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        sets = shingle_sets(batch.column(1), scheme)
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["node", "shingles"])


def by_bucket(batches: Iterator[pa.RecordBatch], found: Callable, lists: int) -> Iterator[list[np.ndarray]]:
    """For rows (bucket, ..., list columns) sorted by bucket: found(columns) of each bucket with two rows or more. The
    last `lists` columns are lists of one width, and come as matrices; a bucket may span batches."""
    rest: list[np.ndarray] | None = None

    def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        plain = [np.asarray(batch.column(i)) for i in range(batch.num_columns - lists)]
        wide = [batch.column(i) for i in range(batch.num_columns - lists, batch.num_columns)]
        return plain + [np.asarray(c.flatten()).view(np.uint64).reshape(len(batch), -1) for c in wide]

    for batch in batches:
        if not len(batch):
            continue
        columns = columns_of(batch)
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        bounds = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist()]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i > 1:
                yield found(*(c[i:j] for c in columns))
        rest = [c[bounds[-1] :] for c in columns]
    if rest is not None and len(rest[0]) > 1:
        yield found(*rest)


def fitting(sizes: np.ndarray, others: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Whether sets of these sizes can be alike enough."""
    return 100 * np.minimum(sizes, others) >= scheme.least * np.maximum(sizes, others)


def spanning_pairs(
    bucket: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, planes: np.ndarray, scheme: Scheme
) -> set[tuple[int, int]]:
    """The pairs a < b of a bucket's spanning forest of the highest estimates, as far as these are proposed as links."""
    proposed = scheme.proposed
    found = set()
    best, by = np.full(len(nodes), -1.0), np.zeros(len(nodes), np.int64)
    outside = np.ones(len(nodes), bool)
    at = 0
    for _ in range(len(nodes) - 1):
        outside[at] = False
        alike = likeness(planes[at : at + 1], planes, scheme)[0]
        alike[~fitting(sizes[at], sizes, scheme)] = -1
        nearer = alike > best
        best[nearer], by[nearer] = alike[nearer], at
        at = int(np.where(outside, best, -2.0).argmax())
        if best[at] >= proposed and nodes[at] != nodes[by[at]]:
            found.add(tuple(sorted((int(nodes[at]), int(nodes[by[at]])))))
    return found


def across(
    bucket: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, comps: np.ndarray, planes: np.ndarray, bands: np.ndarray, scheme: Scheme
):
    """All pairs across components of a bucket that may be links, as arrays of row, row and estimate: one of each pair is
    outside the bucket's most frequent component. A pair that shares an earlier band is left to that band's bucket."""
    names, counts = np.unique(comps, return_counts=True)
    own = np.flatnonzero(comps != names[counts.argmax()])
    band = np.flatnonzero(bands[0] == bucket[:1].view(np.uint64)[0])
    earlier = int(band[0]) if len(band) else 0  # a divided bucket is no band's, and leaves no pair to others
    rows, columns, scores = [], [], []
    step = max(1, 500_000 // len(nodes))
    for i in range(0, len(own), step):
        part = own[i : i + step]
        alike = likeness(planes[part], planes, scheme)
        able = (alike >= scheme.proposed) & fitting(sizes[part, None], sizes, scheme) & (comps[part, None] != comps)
        r, c = np.nonzero(able)
        if earlier and len(r):
            fresh = ~(bands[part[r], :earlier] == bands[c, :earlier]).any(axis=1)
            r, c = r[fresh], c[fresh]
        rows.append(part[r]), columns.append(c), scores.append(alike[r, c])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns]), np.concatenate([np.zeros(0), *scores])


def _pairs(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for found in by_bucket(batches, partial(spanning_pairs, scheme=scheme), 1):
        fresh = sorted(found - seen)
        seen.update(fresh)
        if fresh:
            a, b = zip(*fresh, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(seen) > 1_000_000:
            seen.clear()


def _active(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """bucket and node of the rows that take part in a pair of across()."""

    def found(bucket, nodes, sizes, comps, planes, bands):
        r, c, _ = across(bucket, nodes, sizes, comps, planes, bands, scheme)
        return bucket, nodes[np.unique(np.concatenate([r, c]))]

    for bucket, nodes in by_bucket(batches, found, 2):
        if len(nodes):
            yield pa.RecordBatch.from_arrays([pa.array(bucket[: len(nodes)]), pa.array(np.unique(nodes))], names=["bucket", "node"])


def common(one: np.ndarray, other: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(one) > len(other):
        one, other = other, one
    at = other.searchsorted(one)
    at[at == len(other)] = 0
    return int((other[at] == one).sum()) if len(one) else 0


def _confirmed(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among the pairs of across(), each confirmed on its full sets unless links found before it in the
    bucket have joined its components. The sets travel as binary beside the rows."""
    held: dict[int, np.ndarray] = {}
    unfinished: tuple[int, set] = (0, set())

    def noted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches without their sets, which are held for the batch and the bucket that it goes on with."""
        nonlocal unfinished
        for batch in it:
            if not len(batch):
                continue
            for node in set(held) - unfinished[1]:
                del held[node]
            nodes = batch.column(1).to_pylist()
            for node, data in zip(nodes, batch.column(6), strict=True):
                if node not in held:
                    held[node] = np.frombuffer(data.as_py(), np.uint64)
            buckets = np.asarray(batch.column(0))
            last = set(np.array(nodes)[buckets == buckets[-1]].tolist())
            unfinished = (buckets[-1], last | (unfinished[1] if unfinished[0] == buckets[0] == buckets[-1] else set()))
            yield batch.select([0, 1, 2, 3, 4, 5])

    def found(bucket, nodes, sizes, comps, planes, bands):
        r, c, scores = across(bucket, nodes, sizes, comps, planes, bands, scheme)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        links = []
        for i in np.argsort(-scores, kind="stable"):
            x, y = root(int(comps[r[i]])), root(int(comps[c[i]]))
            if x != y:
                a, b = int(nodes[r[i]]), int(nodes[c[i]])
                both = common(held[a], held[b])
                if 100 * both >= scheme.least * (len(held[a]) + len(held[b]) - both):
                    parent[x] = y
                    links.append((a, b))
        return links

    for links in by_bucket(noted(batches), found, 2):
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def star_components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node that is reachable over edges (a, b); nodes without an edge are absent.

    Alternating large and small stars: neighbours move to the smallest neighbour until every component is one star.
    Minima come from partial sums, so a node with very many neighbours is no single task's burden.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    fingerprint = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    last = fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        stars = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        stars = written(stars, "large-stars")
        low = stars.groupBy("a").agg(F.min("b").alias("low"))
        joined = stars.join(low, "a")
        following = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(joined.select("a", F.col("low").alias("b")))
        edges = written(following.filter("a <> b").distinct(), "small-stars")
        now = fingerprint(edges)
        if now == last:  # distinct edges with the count and hash of those before
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            )
        last = now


def weight() -> Column:
    """What a node counts in its bucket."""
    return (1 + F.floor(F.col("n_shingles") / HEAVY)).cast("long")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """bucket, node, n_shingles and held (the bucket's weight) of the nodes in buckets with two nodes or more, written. The
    buckets' counts come back by joins and not over a window: heavy ones, which are few, in broadcast, so no task ever
    gets a whole heavy bucket."""
    each = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(weight()).alias("held"))
    counts = written(counts.filter("n > 1").drop("n"), "bucket-counts")
    heavy = small(counts.filter(F.col("held") > LARGE))
    light = each.join(heavy.select("bucket"), "bucket", "left_anti").join(small(counts.filter(F.col("held") <= LARGE)), "bucket")
    return written(light.unionByName(each.join(heavy, "bucket")), "bucket-members")


def divided(members: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """bucket and node of members for the spanning forests, with heavy buckets divided by each of a few further bands, and
    what is still too heavy into parts that all hold the bucket's first node. What this leaves out, blocks() brings
    together."""
    if members.filter(F.col("held") > LARGE).isEmpty():
        return members.select("bucket", "node")
    own = members.filter(F.col("held") > LARGE).select("bucket", "node").join(nodes.select("node", "n_shingles", "bands"), "node")
    start = F.pmod("bucket", F.lit(scheme.bands)).cast("int")
    further = F.transform(
        F.sequence(F.lit(1), F.lit(FURTHER)),
        lambda i: F.xxhash64("bucket", i, F.get("bands", F.pmod(start + i * 5, F.lit(scheme.bands)).cast("int"))),
    )
    again = own.select(F.explode(further).alias("bucket"), "node", "n_shingles")
    sizes = again.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(weight()).alias("held"), F.min("node").alias("first"))
    again = again.join(sizes.filter("n > 1"), "bucket")
    part = F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("held") / LARGE)).cast("int")  # other parts in each bucket
    parts = again.withColumn("part", part).select(F.xxhash64("bucket", "part").alias("bucket"), "node", "first")
    firsts = parts.select("bucket", F.col("first").alias("node")).distinct()
    return members.filter(F.col("held") <= LARGE).select("bucket", "node").unionByName(
        parts.select("bucket", "node").unionByName(firsts).distinct()
    )


def blocks(members: DataFrame, comps: DataFrame) -> DataFrame:
    """bucket and node for the comparisons across components: heavy buckets of members as pairs of blocks, so that each
    node outside a bucket's heaviest component meets all nodes of the bucket, and no task gets much over LARGE of them."""
    named = members.join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    large = written(named.filter(F.col("held") > LARGE), "large-buckets")
    main = large.groupBy("bucket", "comp").agg(F.sum(weight()).alias("n"))
    main = main.groupBy("bucket").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    large = large.join(small(written(main.filter(F.col("all") > F.col("most")), "main-components")), "bucket")
    half = max(1, LARGE // 2)
    rows, columns = F.ceil((F.col("all") - F.col("most")) / half).cast("int"), F.ceil(F.col("all") / half).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = large.select("bucket", "node", F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"), own(columns).alias("j"))
    outside = large.filter(F.col("comp") != F.col("main"))
    outside = outside.select("bucket", "node", own(rows).alias("i"), F.explode(F.sequence(F.lit(0), columns - 1)).alias("j"))
    cells = every.unionByName(outside).select(F.xxhash64("bucket", "i", "j").alias("bucket"), "node").distinct()
    return members.filter(F.col("held") <= LARGE).select("bucket", "node").unionByName(cells)


def linked(docs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """node and comp for the nodes (node, doc_id, text_key, n_shingles, bands, planes) that have a link to another."""
    members = bucket_members(nodes)
    features = nodes.select("node", "n_shingles", "planes", "bands")
    wide = written(divided(members, nodes, scheme).join(features, "node"), "bucket-planes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_buckets = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket", "node")
    pairs = in_buckets(wide.select("bucket", "node", "n_shingles", "planes")).mapInArrow(partial(_pairs, scheme=scheme), "a long, b long")
    pairs = written(pairs.distinct(), "spanning-pairs")
    sets = sets_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), scheme)
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    links = pairs.join(left, "a").join(right, "b").filter(100 * both >= scheme.least * either).select("a", "b").distinct()
    none = docs.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("comp"))
    comps = merged(none, written(links, "spanning-links"))
    if not members.filter(F.col("held") > LARGE).isEmpty():
        wide = written(blocks(members, comps).join(features, "node"), "block-planes")
    now = wide.join(small(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = now.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("bucket")
    now = written(now.join(several, "bucket", "left_semi").select("bucket", "node", "n_shingles", "comp", "planes", "bands"), "mixed-buckets")
    active = written(in_buckets(now).mapInArrow(partial(_active, scheme=scheme), "bucket long, node long"), "active")
    sets = sets_of(docs, nodes, active.select("node"), scheme)
    as_bytes = sets.mapInArrow(_as_bytes, "node long, shingles binary")
    rows = now.join(active, ["bucket", "node"]).join(as_bytes, "node")
    rows = rows.select("bucket", "node", "n_shingles", "comp", "planes", "bands", "shingles")
    links = in_buckets(rows).mapInArrow(partial(_confirmed, scheme=scheme), "a long, b long").distinct()
    return merged(comps, written(links, "other-links"))


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """node and shingles of the wanted nodes, from the text of one row of each, written."""
    places = nodes.select("node", F.col("doc_id").alias("id"), F.col("text_key").alias("key")).join(small(written(wanted.distinct(), "wanted")), "node", "left_semi")
    texts = rows_of(docs).join(small(written(places, "wanted-rows"), 400_000), (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("key")))
    return written(texts.select("node", "text").mapInArrow(partial(_sets, scheme=scheme), "node long, shingles array<long>"), "shingle-sets")


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [np.asarray(x.values).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["node", "shingles"])


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) that links between nodes make of comps. Links are first contracted to the components
    that they join, so a round's graph is no larger than what it adds."""
    ends = comps.withColumnsRenamed({"node": "id", "comp": "named"})
    contracted = links.join(small(ends), F.col("a") == F.col("id"), "left").select(F.coalesce("named", "a").alias("a"), "b")
    contracted = contracted.join(small(ends), F.col("b") == F.col("id"), "left").select("a", F.coalesce("named", "b").alias("b"))
    stars = written(star_components(contracted), "stars")
    moved = stars.withColumnsRenamed({"node": "old", "comp": "new"})
    kept = comps.join(small(moved), F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return written(kept.unionByName(stars.join(comps.select("node"), "node", "left_anti")), "components")


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text of each row."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"].cast("string").alias("text"))


def classes(docs: DataFrame, schemes: tuple[Scheme, ...]) -> tuple[DataFrame, DataFrame]:
    """The signed rows (signed_schema), and for each node set_key, comp (nodes that links of any scheme join share it) and
    component_id (their smallest doc_id). Both written. Rows without words or without doc_id are in no node."""
    signed = written(rows_of(docs).mapInArrow(partial(_signed, schemes=schemes), signed_schema(schemes)), "signed")
    full = signed.filter("n_0 > 0 AND doc_id IS NOT NULL")
    own = [c for c in signed.columns if c not in ("doc_id", "text_key", "set_key")]
    nodes = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), *(F.first(c).alias(c) for c in own))
    # written before it is read, the numbers are the nodes' own
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", "row.*", *own), "nodes")
    found = []
    for i, scheme in enumerate(schemes):
        features = [F.col(f"{c}_{i}").alias(b) for c, b in (("n", "n_shingles"), ("bands", "bands"), ("planes", "planes"))]
        found.append(linked(docs, nodes.select("node", "doc_id", "text_key", *features), scheme))
    if len(found) > 1:
        edges = reduce(DataFrame.unionByName, (x.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")) for x in found))
        found = [written(star_components(edges), "joint-components")]
    comps = found[0].join(nodes.select("node", "doc_id"), "node")
    least = small(written(comps.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least-ids"))
    moved = small(written(comps.select("node", "comp").join(least, "comp"), "linked-nodes"))
    named = nodes.select("node", "set_key", "doc_id").join(moved, "node", "left")
    named = named.select("set_key", F.coalesce("comp", "node").alias("comp"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return signed, written(named, "named")


def components(docs: DataFrame, scheme: Scheme = OP5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for each row of docs.

    Null and empty texts, and texts without words, have an empty set and no link. Every row is a document of its own, also
    where rows share a doc_id: their texts are linked only if they are alike, each row has the component of its own text,
    and doc_id alone ties nothing. A row without doc_id is linked with nothing, has no component and is kept. Ties go to
    the smallest doc_id. An empty table gives an empty result. Extra columns are ignored.
    """
    with working(docs.sparkSession) as tables:
        signed, named = classes(docs, (scheme,))
        rows = signed.select("doc_id", F.col("n_0").alias("n_shingles"), "set_key")
        rows = rows.join(small(named.select("set_key", F.col("component_id").alias("named")), 400_000), "set_key", "left")
        own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("named")).otherwise(F.col("doc_id"))
        out = rows.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
        out = written(out, "near-components")
        tables.keep(out)
    return out


def dropped(docs: DataFrame, schemes: tuple[Scheme, ...]) -> tuple[DataFrame, DataFrame]:
    """doc_id and text_key of the rows that go, as another row of their component stays, and of the rows that are
    repeated. Both written."""
    signed, named = classes(docs, schemes)
    rows = signed.filter("n_0 > 0 AND doc_id IS NOT NULL").select("doc_id", "text_key", "set_key")
    rows = rows.join(small(named.select("set_key", "comp"), 400_000), "set_key").select("doc_id", "text_key", "comp")
    # the first row of each component, and components with others
    ends = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.max(F.struct("doc_id", "text_key")).alias("last"))
    ends = small(written(ends.filter("first <> last").select("comp", "first"), "component-firsts"))
    gone = rows.join(ends, "comp").filter(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key").distinct()
    again = signed.filter("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(gone, "dropped"), written(again.select("doc_id", "text_key"), "repeated")


def unique(docs: DataFrame, schemes: tuple[Scheme, ...] = (OP5,)) -> DataFrame:
    """The rows of docs, with their columns, but for those that links of any scheme join to a row with a smaller doc_id
    (or the same doc_id and another text with a smaller hash).

    Rows go, and not ids: a row goes only if a row of its component stays. Rows with one doc_id and one text are kept
    once, the first by their columns as JSON. Rows without words, or without doc_id, are linked with nothing. An empty
    table gives an empty result; extra columns stay, whatever their names. Texts are shuffled only where rows are repeated.
    """
    spark = docs.sparkSession
    with working(spark) as tables:
        gone, again = dropped(docs, schemes)
        tables.keep(gone, again)
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own_row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"))
    out = own.join(small(gone), ["doc_id", "text_key"], "left_anti")
    if not again.isEmpty():
        again = small(again)
        once = out.join(again, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key")
        once = once.agg(F.min_by("own_row", F.to_json("own_row")).alias("own_row"))
        out = out.join(again, ["doc_id", "text_key"], "left_anti").unionByName(once.select("own_row", "doc_id", "text_key"))
    return out.select("own_row.*")

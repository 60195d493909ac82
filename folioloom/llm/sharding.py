"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group. Every group is placed by itself, the largest first: it goes to the shard, among those with room
for it, whose residual capacity has the highest dot product with the group's vector of bytes, tokens and rows. A group of
more bytes than a shard's share is cut by a hash of the row's id into pieces first, as no placing could keep sizes near
equal; no other group is cut.

Groups are placed in levels of falling size. A level's groups are dealt by hash into cells, and each cell is placed by a task
of its own into its part of what the levels before left in each shard; only the shards' sums reach the driver. So placing is
as wide as the input, and what the cells of one level leave uneven is made good by the next, whose groups are smaller.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, word_count, working, written

#: Parts of a shard (in bytes, tokens or rows, whichever is most) from which a group belongs to the first level, the
#: second one, and the last.
LEVELS = (1 / 256, 1 / 65536, 0.0)
#: About how many groups a cell holds: so many, or so many for each shard.
CELL, FOR_SHARD = 50_000, 128
#: A group that is cut has pieces of about this part of a shard.
WHOLE = 0.5
#: Ranges by hash in which rows are numbered within a shard.
RANGES = 512
#: How far over what is left of a shard a group may go and still have room.
SLACK = 1e-4


def place(vectors: np.ndarray, left: np.ndarray, start: int = 0) -> np.ndarray:
    """The shard of each item, given the items' vectors (bytes, tokens, rows) and what is left in each shard, in the same
    units.

    Items go largest first (by their largest number; ties in the order given). An item with room in all three dimensions
    somewhere goes where the dot product is highest, else so among the shards with room in bytes; without any, where
    most bytes are left. Ties go to the first shard from `start` on, in a circle.
    """
    left = np.roll(left, -start, axis=0).astype(float)
    found = np.zeros(len(vectors), np.int64)
    slack = SLACK * np.maximum(left.max(axis=0, initial=0.0), 0.0)
    for i in np.argsort(-vectors.max(axis=1, initial=0.0), kind="stable"):
        v = vectors[i]
        fits = left + slack >= v
        room = fits.all(axis=1)
        if not room.any():
            room = fits[:, 0]
        s = int(np.where(room, left @ v, -np.inf).argmax()) if room.any() else int(left[:, 0].argmax())
        left[s] -= v
        found[i] = s
    return (found + start) % len(left)


def _cell(left: list[list[float]], caps: list[float], rest: list[float]) -> Callable[[pa.Table], pa.Table]:
    """What places a cell's items (cell, group_key, piece, b, t, r) into its part of what is left: as much of each shard's rest
    as the cell has of all items that are still to be placed."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group_key", "ascending"), ("piece", "ascending")])
        sizes = np.stack([table.column(c).to_numpy() for c in "btr"], axis=1)
        part = sizes.sum(axis=0) / np.maximum(rest, 1)
        shards = place(sizes / caps, np.array(left) * part, int(table.column("cell")[0].as_py()) * 7919 % len(left))
        return table.select(["group_key", "piece", "b", "t", "r"]).append_column("shard", pa.array(shards, pa.int32()))

    return pack


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Each row's size (UTF-8 bytes plus 1; null: 1), CRC, tokens and group: a hash of the text, equal for equal texts."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        *(docs[c] for c in keep),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        word_count(docs["text"]).alias("tokens"),
        F.xxhash64(docs["text"]).alias("group_key"),
    )


def placed(slim: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """group_key and pieces of the groups that are cut (fewer than there are shards), and group_key, piece, shard and level
    of every group or piece. Both written. slim: doc_id, group_key, size, tokens."""
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    with working(slim.sparkSession) as tables:
        groups = written(slim.groupBy("group_key").agg(*sums), "shard-groups")
        caps = [max(1, (x or 0) / shards) for x in groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).first()]
        cuts = groups.filter(F.col("b") > caps[0]).select("group_key", (F.floor(F.col("b") / (caps[0] * WHOLE)) + 1).cast("int").alias("pieces"))
        cuts = written(cuts, "shard-cuts")
        cut = slim.join(F.broadcast(cuts), "group_key").groupBy("group_key", piece().alias("piece")).agg(*sums)
        items = groups.join(F.broadcast(cuts), "group_key", "left_anti").withColumn("piece", F.lit(0)).unionByName(cut)
        share = F.greatest(*(F.col(c) / cap for c, cap in zip("btr", caps, strict=True)))
        level = F.lit(len(LEVELS) - 1)
        for i in reversed(range(len(LEVELS) - 1)):
            level = F.when(share >= LEVELS[i], i).otherwise(level)
        items = written(items.withColumn("level", level), "shard-items")
        of_level = {x.level: x for x in items.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).collect()}
        left, out = np.ones((shards, 3)), []
        for i in sorted(of_level):
            rest = [float(sum(x[c] for j, x in of_level.items() if j >= i)) for c in "btr"]
            cells = -(-of_level[i].n // max(CELL, FOR_SHARD * shards))
            cell = F.pmod(F.xxhash64("group_key", "piece"), F.lit(cells)).cast("long")
            own = items.filter(F.col("level") == i).select(cell.alias("cell"), "group_key", "piece", "b", "t", "r")
            own = own.repartition(cells, "cell").groupBy("cell").applyInArrow(_cell(left.tolist(), caps, rest), "group_key long, piece int, b long, t long, r long, shard int")
            own = written(own, f"shard-placed-{i}")
            for x in own.groupBy("shard").agg(F.sum("b"), F.sum("t"), F.sum("r")).collect():  # a row for each shard
                left[x[0]] -= np.array(x[1:]) / caps
            out.append(own.select("group_key", "piece", "shard", F.lit(i).alias("level")))
        if not out:
            out = [items.select("group_key", "piece", F.lit(0).alias("shard"), "level")]
        every = out[0]
        for x in out[1:]:
            every = every.unionByName(x)
        every = written(every, "shard-of-group")
        tables.keep(cuts, every)
    return cuts, every


def piece():
    """Which of its group's pieces a row belongs to."""
    return F.coalesce(F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.col("pieces")), F.lit(0)).cast("int")


def with_shard(rows: DataFrame, cuts: DataFrame, every: DataFrame) -> DataFrame:
    """rows (doc_id, group_key and more) with the column shard, from placed(). Rows of large groups find theirs in broadcast,
    so no hot group is shuffled; the others are shuffled by group only if there are too many groups for that."""
    first = small(every.filter("level = 0").select("group_key", "piece", F.col("shard").alias("shard_of_large")))
    rows = rows.join(F.broadcast(cuts), "group_key", "left").withColumn("piece", piece()).drop("pieces")
    rows = rows.join(first, ["group_key", "piece"], "left")
    # rows that have their shard are spread by a number of their own
    key = F.when(F.col("shard_of_large").isNull(), F.col("group_key")).otherwise(F.monotonically_increasing_id())
    others = every.filter("level > 0").select(F.col("group_key").alias("other_key"), F.col("piece").alias("other_piece"), F.col("shard").alias("other_shard"))
    rows = rows.withColumn("own_key", key).join(small(others), (F.col("own_key") == F.col("other_key")) & (F.col("piece") == F.col("other_piece")), "left")
    return rows.withColumn("shard", F.coalesce("shard_of_large", "other_shard")).drop("piece", "shard_of_large", "own_key", "other_key", "other_piece", "other_shard")


def slot_range(order: list[str]):
    """The range of a row, by a hash of what orders it."""
    return F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(RANGES)).cast("int")


def first_slots(sharded: DataFrame, order: list[str]) -> DataFrame:
    """shard, slot_range and first_slot, the number of rows in the shard's ranges before, written."""
    counts = sharded.groupBy("shard", slot_range(order).alias("slot_range")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slot_range").rowsBetween(Window.unboundedPreceding, -1)
    return written(counts.select("shard", "slot_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot")), "shard-starts")


def numbered(sharded: DataFrame, starts: DataFrame, order: list[str]) -> DataFrame:
    """sharded with slot, gapless from 0 in each shard. Rows are numbered within ranges of a hash, and the ranges' first
    slots shift the numbers, so no task gets a whole shard."""
    within = Window.partitionBy("shard", "slot_range").orderBy(*order)
    return (
        sharded.withColumn("slot_range", slot_range(order))
        .join(small(starts), ["shard", "slot_range"])
        .withColumn("slot", (F.col("first_slot") + F.row_number().over(within) - 1).cast("long"))
        .drop("slot_range", "first_slot")
    )


def pack(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of each row of docs, and its tokens.

    Equal texts share a shard, unless they hold more bytes than a shard's share: then they are cut into pieces of about
    half of it. A null text is an empty one of its own group and has size 1. Rows that are repeated are rows of their
    own. Ties in placing go to the group with the smaller hash and to the first shard in a circle. An empty table gives
    an empty result. Extra columns are ignored.
    """
    order = ["doc_id", "text_crc32", "size"]
    with working(docs.sparkSession) as tables:
        slim = written(measured(docs, "doc_id"), "shard-rows")
        cuts, every = placed(slim, shards)
        slim = written(with_shard(slim, cuts, every), "sharded-rows")
        out = written(numbered(slim, first_slots(slim, order), order), "numbered-rows")
        tables.keep(out)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )


def pack_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """As pack(), with the columns of docs: the rows themselves, each with its shard and slot. The rows' own columns
    travel in one struct, so none can clash."""
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own_row"), "doc_id", "text")
    order = ["doc_id", "text_crc32", "size"]
    with working(docs.sparkSession) as tables:
        slim = written(measured(docs, "doc_id"), "shard-rows")
        cuts, every = placed(slim, shards)
        out = with_shard(measured(own, "own_row", "doc_id"), cuts, every)
        starts = first_slots(with_shard(slim, cuts, every), order)
        tables.keep(cuts, every, starts)
    out = numbered(out, starts, order)
    extra = ["size", "text_crc32", "shard", "slot"]
    named = [F.col(c).alias(c if c.lower() not in {x.lower() for x in docs.columns} else f"{c}_of_shard") for c in extra]
    return out.select("own_row.*", *named, F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


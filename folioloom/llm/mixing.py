"""Mixing sources to target weights by capped water-filling.

All words are shared out to the sources by weight; a source takes its size times CAP at most, and the excess goes to
the others by weight until none is above. Then every document is taken as often as its target holds its source whole. A
seeded hash order of its documents fills the rest until the next one is too long, and the largest documents that still fit,
from a table of sizes, fill what is left of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, word_count, working, written

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"
#: Characters of the hash's hex form that make a range of documents, and ranges within that: 256 ranges each time.
PREFIXES = (2, 4)
#: Significant bits of a size in a source's table of sizes: those below 2 ** BITS are exact.
BITS = 15
#: A key above all keys.
ABOVE = "~"


def order_key(doc_id, seed: str = SEED):
    """A document's place in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and order key of each row."""
    return docs.select(
        docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), order_key(docs["doc_id"], seed).alias("key")
    )


def bucket(size: Column) -> Column:
    """A size cut to BITS significant bits."""
    bits = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, bits), bits)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with the sum of each column over all rows before, in order; written. Rows are dealt by range and summed within a
    range, so no task gets all of them."""
    dealt = written(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), name)
    totals = dealt.groupBy("range_no").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    zero = F.lit(0).cast("long")
    starts = totals.select("range_no", *(F.coalesce(F.sum(n).over(before), zero).alias(f"from_{n}") for n in sums))
    own = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(small(written(starts, f"{name}-starts")), "range_no")
    return written(found.select(*rows.columns, *((F.col(f"from_{n}") + F.coalesce(F.sum(c).over(own), zero)).alias(n) for n, c in sums.items())), f"{name}-sums")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size with target. Sources that their share by weight would fill beyond cap times their size are
    clamped there, and what they leave is shared by weight among the others, until none is above: in the order of size by
    weight these are the first ones, up to the first whose share of all that is left stays below its limit."""
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, "mix-sources")
    weighed = ranked.withColumns(
        {
            "weight": F.element_at(cycle, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")),
            "most": (F.col("source_size") * cap).cast("long"),
        }
    )
    weighed = weighed.withColumn("ratio", F.col("most") / F.col("weight"))
    every, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    if every is None:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    lined = running(weighed, [F.col("ratio"), F.col("rank")], {"most_before": F.col("most"), "weight_before": F.col("weight")}, "mix-ratios")
    level = (F.lit(every) - F.col("most_before")) / (F.lit(weight) - F.col("weight_before"))
    open_ = F.when(level * F.col("weight") < F.col("most"), F.struct("ratio", "rank", level.alias("level")))
    found = lined.agg(F.min(open_)["level"]).first()[0]
    most = F.col("most").cast("double")
    target = most if found is None else F.least(most, F.lit(found) * F.col("weight"))
    return lined.select("source", "source_size", target.alias("target"))


def same_source() -> Column:
    return F.col("source").eqNullSafe(F.col("name"))


def quotas(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source: name, source_size, target, whole (times that every document is taken), gap (words to take
    besides), last (documents not above the gap in size whose keys are not above it are taken once more) and room (what they
    leave of the gap).

    Words are summed by source and range of keys, then by the ranges within the one in which the gap closes, and only the
    last such range, one of 65,536, is ordered by key. So a source of any size is never sorted in one task.
    """
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(written(totals, "mix-totals"), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a hair below a whole number is that number
    whole = F.floor(ratio + 1e-9)
    rest = F.floor(F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")) + 1e-6).cast("long")
    quota = written(sources.withColumnRenamed("source", "name").withColumns({"whole": whole, "gap": rest}), "mix-quota")
    fits = slim.join(small(quota.filter("gap > 0").select("name", "gap")), same_source())
    fits = fits.filter((F.col("size") <= F.col("gap")) & (F.col("size") > 0))
    edge, full = fits.withColumn("start", F.lit(0).cast("long")), None
    for n, length in enumerate(PREFIXES):
        part = F.substring("key", 1, length).alias("part")
        sums = edge.groupBy("name", part).agg(F.sum("size").alias("words"), F.first("gap").alias("gap"), F.first("start").alias("start"))
        sums = written(sums, f"mix-ranges-{n}")
        full = sums.groupBy("name").agg(F.sum("words").alias("all_words")) if full is None else full
        upto = F.sum("words").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        # the first range that overfills, and the words before it
        cut = sums.withColumn("upto", F.col("start") + upto).filter("upto > gap").groupBy("name")
        cut = cut.agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("start"))).alias("cut"))
        cut = written(cut.select(F.col("name").alias("cut_name"), F.col("cut.part").alias("cut_part"), F.col("cut.start").alias("cut_start")), f"mix-cuts-{n}")
        edge = fits.join(small(cut), F.col("name").eqNullSafe(F.col("cut_name")) & (F.substring("key", 1, length) == F.col("cut_part")))
        edge = edge.withColumn("start", F.col("cut_start")).drop("cut_name", "cut_part", "cut_start")
    edge = edge.groupBy("name", "key").agg(F.sum("size").alias("words"), F.first("start").alias("start"), F.first("gap").alias("gap"))
    along = Window.partitionBy("name").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("start") + F.sum("words").over(along))
    # with no key that fits, the last one is above the ranges before and below this range's keys
    ends = edge.groupBy(F.col("name").alias("end_name")).agg(
        F.coalesce(F.max(F.expr("CASE WHEN upto <= gap THEN key END")), F.substring(F.min("key"), 1, PREFIXES[-1])).alias("last"),
        F.coalesce(F.max(F.expr("CASE WHEN upto <= gap THEN upto END")), F.first("start")).alias("words"),
    )
    found = full.withColumnRenamed("name", "full_name").join(ends, F.col("full_name").eqNullSafe(F.col("end_name")), "left")
    found = found.select("full_name", F.coalesce("last", F.lit(ABOVE)).alias("last"), F.coalesce("words", "all_words").alias("words"))
    quota = quota.join(found, F.col("name").eqNullSafe(F.col("full_name")), "left").drop("full_name")
    quota = quota.withColumns({"last": F.coalesce("last", F.lit("")), "room": F.col("gap") - F.coalesce("words", F.lit(0))})
    return written(quota.drop("words"), "mix-quotas")


def along_order() -> Column:
    """Whether the seeded order takes a document once more: from size, key and the columns of quotas()."""
    return (F.col("size") > 0) & (F.col("key") <= F.col("last")) & (F.col("size") <= F.col("gap"))


def within(limits: DataFrame) -> Column:
    return F.col("source").eqNullSafe(F.col("limit_name")) & (bucket(F.col("size")) == F.col("limit_bucket"))


def fitting(sizes_of: Column, room: Column) -> Column:
    """room, picks (bucket, t, n) and exact: from a source's table of sizes (bucket, most, n; falling), how many documents of
    each bucket to take, the largest first; then one more of the smallest left if that ends nearer."""
    kind = "array<struct<bucket: bigint, t: bigint, n: bigint>>"
    start = F.struct(room.alias("room"), F.array().cast(kind).alias("picks"), F.lit(None).cast("struct<bucket: bigint, most: bigint, n: bigint>").alias("low"))

    def step(acc: Column, x: Column) -> Column:
        t = F.least(x["n"], F.floor(acc["room"] / x["most"]))
        pick = F.array(F.struct(x["bucket"].alias("bucket"), t.alias("t"), x["n"].alias("n")))
        low = F.struct(x["bucket"].alias("bucket"), x["most"].alias("most"), x["n"].alias("n"))
        return F.struct(
            (acc["room"] - t * x["most"]).alias("room"), F.when(t > 0, F.concat(acc["picks"], pick)).otherwise(acc["picks"]).alias("picks"),
            F.when(t < x["n"], low).otherwise(acc["low"]).alias("low"),
        )

    def end(acc: Column) -> Column:
        exact = ~F.exists(acc["picks"], lambda p: p["bucket"] >= 2**BITS)
        nearer = exact & F.coalesce(acc["low"]["most"] - acc["room"] < acc["room"], F.lit(False))
        more = F.array(F.struct(acc["low"]["bucket"].alias("bucket"), F.lit(1).cast("long").alias("t"), acc["low"]["n"].alias("n")))
        room_left = acc["room"] - F.when(nearer, acc["low"]["most"]).otherwise(0)
        return F.struct(room_left.alias("room"), F.when(nearer, F.concat(acc["picks"], more)).otherwise(acc["picks"]).alias("picks"), exact.alias("exact"))

    return F.aggregate(sizes_of, start, step, end)


def filled(slim: DataFrame, quota: DataFrame) -> DataFrame:
    """limit_name, limit_bucket, upto: of a source's documents in a bucket of sizes, those that the seeded order leaves and whose
    keys are not above upto are taken once more, until no document fits what is left of the source's gap.

    A round counts the documents left by source and size, goes down each source's table of sizes, which is short whatever
    the number of documents, and takes the first keys of the buckets chosen. Documents of a bucket are few by then: keys
    beyond four times their share of the hash's range are left out before any are ordered, and what is missing then is left
    to the next round. Only buckets of sizes that aren't exact need another round.
    """
    limits = quota.limit(0).select(F.col("name").alias("limit_name"), F.lit(0).cast("long").alias("limit_bucket"), F.lit("").alias("upto"))
    state, number = written(quota.filter("room > 0").select("name", "gap", "last", "room"), "mix-open-0"), 0
    while not state.isEmpty():
        number += 1
        left = slim.join(small(state), same_source()).filter((F.col("size") > 0) & ~along_order())
        left = left.join(small(limits), within(limits), "left").filter(F.col("key") > F.coalesce("upto", F.lit("")))
        left = left.withColumn("bucket", bucket(F.col("size")))
        counts = left.groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.first("room").alias("room"))
        tables = counts.groupBy("name").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(F.struct("bucket", "most", "n")), asc=False).alias("sizes"))
        chosen = written(tables.select("name", F.col("room").alias("before"), fitting(F.col("sizes"), F.col("room")).alias("x")), f"mix-chosen-{number}")
        picks = chosen.select(F.col("name").alias("pick_name"), F.explode("x.picks").alias("p"))
        picks = written(picks.groupBy("pick_name", F.col("p.bucket").alias("pick_bucket")).agg(F.sum("p.t").alias("t"), F.max("p.n").alias("n")), f"mix-picks-{number}")
        few = left.join(small(picks), F.col("name").eqNullSafe(F.col("pick_name")) & (F.col("bucket") == F.col("pick_bucket")))
        place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32
        few = few.filter(place <= (F.col("t") * 4 + 64) / F.col("n"))
        keys = few.groupBy("name", "bucket", "key", "t").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("words"))
        along = Window.partitionBy("name", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
        keys = keys.withColumn("taken", F.sum("m").over(along)).filter("taken <= t")
        taken = written(keys.groupBy("name", "bucket").agg(F.max("key").alias("upto"), F.sum("words").alias("words")), f"mix-taken-{number}")
        new = taken.select(F.col("name").alias("limit_name"), F.col("bucket").alias("limit_bucket"), "upto")
        limits = written(limits.unionByName(new).groupBy("limit_name", "limit_bucket").agg(F.max("upto").alias("upto")), f"mix-limits-{number}")
        words = taken.groupBy(F.col("name").alias("taken_name")).agg(F.sum("words").alias("words"))
        ends = chosen.join(words, F.col("name").eqNullSafe(F.col("taken_name"))).select(
            F.col("name").alias("end_name"), "words", (F.col("x.exact") & (F.col("words") == F.col("before") - F.col("x.room"))).alias("done")
        )
        state = state.join(ends, F.col("name").eqNullSafe(F.col("end_name"))).filter("NOT done AND room > words")
        state = written(state.select("name", "gap", "last", (F.col("room") - F.col("words")).alias("room")), f"mix-open-{number}")
    return limits


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and times of each row of docs.

    Null and empty texts have size 0 and take no words. A null source is a source, ranked last. Rows of one doc_id in
    a source share a place in the order and are taken together, those of one size where the rest is filled. What a source
    takes is short of its target by less than any of its documents that isn't taken once more, or above it by less than it was
    short before the last one. An empty table gives an empty result; a source without
    words has target 0. Extra columns are ignored. The same rows and seed give the same result.
    """
    with working(docs.sparkSession) as tables:
        slim = written(sizes(docs, seed), "mix-rows")
        quota = quotas(slim, weights, cap)
        out = once_more(slim, quota, filled(slim, quota))
        out = out.select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), F.col("times").cast("int").alias("times")
        )
        out = written(out, "mix-taken")
        tables.keep(out)
    return out


def once_more(rows: DataFrame, quota: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (source, size, key, ...) with their source's quota and times, how often each is taken."""
    rows = rows.join(small(quota), same_source()).join(small(limits), within(limits), "left")
    picked = (F.col("size") > 0) & (F.col("room") > 0) & F.coalesce(F.col("key") <= F.col("upto"), F.lit(False))
    return rows.withColumn("times", F.col("whole") + (along_order() | picked).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix takes it; nulls, repeats and empty tables as in
    mixed(). Texts aren't shuffled."""
    with working(docs.sparkSession) as tables:
        slim = written(sizes(docs, seed), "mix-rows")
        quota = quotas(slim, weights, cap)
        limits = written(filled(slim, quota), "mix-limits")
        tables.keep(quota, limits)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("own_row"), docs["source"], order_key(docs["doc_id"], seed).alias("key"), word_count(docs["text"]).alias("size"))
    rows = once_more(rows, quota, limits).filter("times > 0")
    copies = rows.select("own_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return copies.select("own_row.*")

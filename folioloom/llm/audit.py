"""What filters do to each other: every order of five filters, from one CUBE over their failure flags.

A document's flags are made once. Counts of the 32 patterns of flags in each part are cubed; a row of the cube whose
selected flags are all false counts the survivors of that set of filters. A step of an order turns one set of filters into
another, so all it removes, keeps and loses is the difference of two such rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, small, word_count, working, written

#: The filters, in the order of the bits of a set: A is the highest.
FILTERS = "ABCDE"
#: Least words; least distinct words and most capitals, in hundredths of words and of code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"


def bit(letter: str) -> int:
    return 1 << (len(FILTERS) - 1 - FILTERS.index(letter))


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails A to D, each by its letter."""
    words = word_count(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    capitals = F.coalesce(F.regexp_count(text, F.lit("[A-Z]")), F.lit(0))
    return {
        "A": words < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * words,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_key (equal for equal texts) and the flags A to D of each row."""
    text = F.coalesce(docs["text"], F.lit(""))
    part = F.coalesce(docs["source"].cast("string"), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    return docs.select(docs["doc_id"], part.alias("part"), key.alias("text_key"), *(f.alias(n) for n, f in text_failures(text).items()))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether a label of the document says so. Rows without an id have no label."""
    known = labels.filter(labels["doc_id"].isNotNull()).groupBy("doc_id")
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = rows.filter("doc_id IS NOT NULL").join(small(written(known, "audit-labels")), "doc_id", "left")
    both = named.unionByName(rows.filter("doc_id IS NULL"), allowMissingColumns=True)  # in a join they would all meet in one task
    return both.fillna(False, ["good", "toxic"])


def patterns(rows: DataFrame) -> DataFrame:
    """part, A to E, n, good, toxic: documents for each pattern of flags, and how many of them are good and toxic.

    Copies of a text share the flags A to D, so E needs no row for each: cells of one text, part and label are counted, with
    the smallest id and the rows that have it. A text's cells then show the smallest id of all. Rows of one text are
    summed before they are shuffled, so a text of very many copies is no hot group.
    """
    own = ["text_key", "part", *FILTERS[:-1], "good", "toxic"]
    ids = rows.groupBy(*own, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    held = F.col("doc_id").isNotNull()
    cells = ids.groupBy(*own).agg(
        F.sum("n").alias("n"), F.sum(F.when(held, 0).otherwise(F.col("n"))).alias("no_id"), F.min(F.when(held, F.struct("doc_id", "n"))).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("text_key"))
    passing = F.col("no_id") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    cells = cells.withColumn("passing", passing)
    split = F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("m")))
    each = cells.select("part", *FILTERS[:-1], "good", "toxic", F.inline(split)).filter("m > 0")
    times = lambda flag: F.sum(F.when(F.col(flag), F.col("m")).otherwise(0))
    return each.groupBy("part", *FILTERS).agg(F.sum("m").alias("n"), times("good").alias("good"), times("toxic").alias("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """part, chosen (a set of filters as bits), n, good, toxic: what passes all chosen filters, for all 32 sets."""
    cube = counted.cube(*FILTERS, "part").agg(F.grouping_id().alias("g"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    passed = cube.filter((F.col("g").bitwiseAND(1) == 0) & ~F.greatest(*(F.coalesce(F.col(c), F.lit(False)) for c in FILTERS)))
    sets = 1 << len(FILTERS)
    passed = passed.select("part", (sets - 1 - F.shiftright("g", 1)).cast("int").alias("chosen"), "n", "good", "toxic")
    every = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("chosen"))
    return every.join(passed, ["part", "chosen"], "left").fillna(0, ["n", "good", "toxic"])


def orders() -> list[tuple]:
    """filter_order, step, letter, and the sets before and after the step."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            found.append(("".join(order), step, letter, before, before | bit(letter)))
            before |= bit(letter)
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each
    source of docs (doc_id, text, source), labels (doc_id, quality, toxic) known.

    A null text is empty: it fails A and, if a smaller id's text is empty too, E. A null source is the empty one. A null
    doc_id is no smaller than any, has none smaller and has no label; rows that share the smallest id of a text all pass E.
    Several labels of a document count as one that is good or toxic if any is. Empty docs give no row; empty labels lose
    nothing. Extra columns are ignored.
    """
    spark = docs.sparkSession
    with working(spark) as tables:
        rows = written(flagged(docs), "audit-rows")
        counted = written(patterns(labelled(rows, labels)), "audit-patterns")
        sets = written(survivors(counted), "audit-sets")
        steps = spark.createDataFrame(orders(), "filter_order string, step int, letter string, was int, now int")
        before = sets.withColumnRenamed("chosen", "was").join(F.broadcast(steps), "was")  # 600 steps
        after = sets.select("part", F.col("chosen").alias("now"), F.col("n").alias("kept"), F.col("good").alias("good_kept"), F.col("toxic").alias("toxic_kept"))
        pairs = before.join(after, ["part", "now"]).withColumn("removed", F.col("n") - F.col("kept"))
        own = Window.partitionBy("part", "letter")  # 120 rows
        at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(own)
        out = pairs.select(
            "part", "filter_order", "step", "kept", "removed", (at(1) - F.col("removed")).alias("redundant"), at(len(FILTERS)).alias("unique_fails"),
            (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost"), F.sum("removed").over(own).alias("shapley"),
        )
        out = written(out, "audit-steps")
        tables.keep(out)
    return out

"""Language-model scores: the likelihood of a text over all its segmentations into subwords.

The vocabulary is an existing tokenizer's, and its pieces' scores weight all segmentations. As these scores are ranks and not
log probabilities, a piece's first weight is that of its rank (Zipf and Mandelbrot's law); rounds of expectation
maximization over the lattices of all training words then fit the weights to the corpus, counting every segmentation by
its probability. A word's probability is the sum over all ways to cut it into pieces, by forward recursion in log
space; a text's is the product over its words and an end.

Texts are coded once into blocks: a block holds its own dictionary and its documents as runs of numbers. Only the
dictionaries are summed over the corpus, and scores return to each block's dictionary, so no task needs all words.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, working, written

VOCABULARY = os.environ.get("TOKENIZER_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Added to a word's count (base score) and to a piece's.
SMOOTH = 0.1
#: Bytes of text in a block.
BLOCK = 48_000_000
#: Stands before a word's first letter in the vocabulary.
MARK = "▁"
#: Rounds of expectation maximization, and what is added to a rank before its first weight is taken.
ROUNDS, SHIFT = 2, 2.7
#: Expected counts are summed over the corpus in these parts of one, as whole numbers.
PARTS = 1_000_000
#: The text's end: no word holds a space.
END = b" "

#: A document has its packed ids; a word of a block's dictionary its number as key, and its training count n.
CODED = "block long, key long, held_out boolean, ids binary, word binary, n long"
SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
LOG10 = math.log(10)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks: a row for each document and one for each of the block's distinct tokens, with its training count."""
    task, made = TaskContext.get().partitionId(), 0
    names = [x.split()[0] for x in CODED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()]
    pack = zstandard.ZstdCompressor(level=1).compress
    known: dict[bytes, int] = {}
    ids: list[np.ndarray] = []
    docs: list[tuple] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal made, size
        block = (task << 24) | made
        made += 1
        counts = np.zeros(len(known), np.int64)
        for (_, held), own in zip(docs, ids, strict=True):
            if not held:
                counts += np.bincount(own, minlength=len(known))
        for at in range(0, len(docs), 1024):
            part, runs = docs[at : at + 1024], ids[at : at + 1024]
            columns = {"key": [d for d, _ in part], "held_out": [h for _, h in part], "ids": [pack(r.tobytes()) for r in runs]}
            yield row_batch(block, columns, len(part))
        for at in range(0, len(known), 100_000):
            words = list(islice(known, at, at + 100_000))
            columns = {"key": range(at, at + len(words)), "word": words, "n": counts[at : at + len(words)]}
            yield row_batch(block, columns, len(words))
        known.clear(), ids.clear(), docs.clear()
        size = 0

    def row_batch(block: int, columns: dict, rows: int) -> pa.RecordBatch:
        columns |= {"block": [block] * rows}
        arrays = [pa.array(columns[n], k) if n in columns else pa.nulls(rows, k) for n, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in slices(batches, 2):
        for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            words.append(END)
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            docs.append((doc, held))
            size += sum(map(len, words))
            if size > BLOCK:
                yield from out()
    if docs:
        yield from out()


def coded(docs: DataFrame, fold: int = 0, folds: int = 10) -> DataFrame:
    """CODED, written. Rows whose crc32 of the doc_id's text leaves `fold` when divided by `folds` are held out."""
    own = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    rows = docs.select(F.col("doc_id").cast("long"), (own % folds == fold).alias("held_out"), F.col("text").cast("string"))
    return written(rows.mapInArrow(_coded, CODED), "lm-blocks")


@lru_cache(maxsize=2)
class Vocabulary:
    """The pieces of a vocabulary: their numbers, and their trie as sorted arrays (for one lookup of many characters)."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=file)
        self.size = model.get_piece_size()
        usable = [i for i in range(self.size) if not model.is_control(i) and not model.is_unknown(i)]
        self.pieces = {model.id_to_piece(i): i for i in usable if not model.is_byte(i)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in usable if model.is_byte(i)}
        # by score, ties by number; bytes stand for what has no piece and come last
        order = sorted(self.pieces.values(), key=lambda i: (-model.get_score(i), i)) + sorted(self.bytes.values())
        self.ranks = {i: n for n, i in enumerate(order, 1)}
        steps: dict[tuple[int, int], int] = {}
        at_node = [-1]
        for piece, i in self.pieces.items():
            node = 0
            for c in piece:
                node = steps.setdefault((node, ord(c)), len(at_node))
                if node == len(at_node):
                    at_node.append(-1)
            at_node[node] = i
        keys = np.array([node << 21 | c for node, c in steps], np.int64)
        turn = np.argsort(keys)
        self.keys, self.children = keys[turn], np.array(list(steps.values()), np.int64)[turn]
        self.at_node = np.array(at_node, np.int64)

    def first_counts(self) -> dict[int, float]:
        """A weight for each piece from its rank, summing to 1."""
        weights = {i: 1 / (r + SHIFT) for i, r in self.ranks.items()}
        total = sum(weights.values())
        return {i: w / total for i, w in weights.items()}


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The logarithms of the sums of exp(values) over the segments that begin at starts."""
    top = np.maximum.reduceat(values, starts)
    top[top == -np.inf] = 0.0
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, np.diff(np.append(starts, len(values))))), starts))


class Lattice:
    """All ways to cut words into pieces, weighted by counts of pieces and of ends, each with `smooth` added."""

    def __init__(self, vocabulary: str, counts: dict[int, float], ends: float, smooth: float = SMOOTH):
        self.of = of = Vocabulary(vocabulary)
        total = math.log(sum(counts.get(i, 0) for i in of.ranks) + ends + smooth * (len(of.ranks) + 1))
        log = lambda n: math.log(n + smooth) - total
        self.log = np.full(of.size, -np.inf)
        for i in of.ranks:
            self.log[i] = log(counts.get(i, 0))
        self.unknown = log(0)  # a character that a vocabulary without bytes lacks
        self.end = log(ends)

    def of_character(self, c: str) -> float:
        """A character that is no piece, by its bytes."""
        return sum(self.log[self.of.bytes[b]] if b in self.of.bytes else self.unknown for b in c.encode("utf-8", "replace"))

    def edges(self, words: list[str]) -> tuple:
        """The lattices of many words at once, a word's places (before each character, and its end) numbered in a row: word of
        each edge, first and last place, log weight, piece (or, from size on, characters that are none), those
        characters, and each word's first place and length."""
        of = self.of
        chars = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        p, node, length = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        found, single = [], np.zeros(len(chars), bool)
        while len(p):
            key = node << 21 | chars[p + length]
            length += 1
            at = np.minimum(np.searchsorted(of.keys, key), len(of.keys) - 1)
            ok = of.keys[at] == key
            p, node = p[ok], of.children[at[ok]]
            piece = of.at_node[node]
            whole = piece >= 0
            if length == 1:
                single[p[whole]] = True
            found.append((p[whole], np.full(int(whole.sum()), length), piece[whole]))
            more = p + length < ends[p]
            p, node = p[more], node[more]
        lone = np.flatnonzero(~single)
        others, which = np.unique(chars[lone], return_inverse=True)
        others = [chr(c) for c in others]
        found.append((lone, np.ones(len(lone), np.int64), of.size + which))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        weights = np.concatenate([self.log, np.array([self.of_character(c) for c in others])])
        first = np.cumsum(sizes) - sizes + np.arange(len(words))
        source = start + word[start]
        return word[start], source, source + length, weights[piece], piece, others, first, sizes

    def passed(self, size: int, source: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """For each place the logarithm of the summed weights of all ways to it from the places in begin; edges go from source
        to target in the order of steps."""
        reached = np.full(size, -np.inf)
        reached[begin] = 0.0
        order = np.lexsort((target, steps))
        source, target, weight, steps = source[order], target[order], weight[order], steps[order]
        new = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        bounds = np.flatnonzero(np.append(True, steps[1:] != steps[:-1])).tolist() + [len(steps)]
        parts = np.searchsorted(new, bounds).tolist()
        with np.errstate(divide="ignore"):
            for (i, j), (a, b) in zip(zip(bounds[:-1], bounds[1:], strict=True), zip(parts[:-1], parts[1:], strict=True), strict=True):
                reached[target[new[a:b]]] = summed(reached[source[i:j]] + weight[i:j], new[a:b] - i)
        return reached

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """The natural logarithm of each word's sum over all segmentations, by forward recursion."""
        if not words:
            return np.zeros(0)
        word, source, target, weight, _, _, first, sizes = self.edges(words)
        return self.passed(int(sizes.sum()) + len(words), source, target, weight, target - first[word], first)[first + sizes]

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each counted so many times: forward and backward recursion."""
        if not words:
            return np.zeros(self.of.size)
        word, source, target, weight, piece, others, first, sizes = self.edges(words)
        size, last = int(sizes.sum()) + len(words), first + sizes
        forward = self.passed(size, source, target, weight, target - first[word], first)
        backward = self.passed(size, target, source, weight, last[word] - source, last)
        share = np.exp(forward[source] + weight + backward[target] - forward[last][word]) * np.asarray(times)[word]
        counts = np.bincount(piece, share, self.of.size + len(others))
        for c, n in zip(others, counts[self.of.size :], strict=True):
            for b in c.encode("utf-8", "replace"):
                if b in self.of.bytes:
                    counts[self.of.bytes[b]] += n
        return counts[: self.of.size]


def fitted(words: DataFrame, ends: int, vocabulary: str, rounds: int = ROUNDS) -> tuple[dict[int, float], float, float]:
    """Counts of pieces, of ends and what to add to each, for Lattice: after rounds of expectation maximization from the
    vocabulary's ranks over all training words (word, c). One number for each piece of the vocabulary reaches the driver
    in a round."""
    model: tuple = (Vocabulary(vocabulary).first_counts(), 0.1, 1e-12)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    for _ in range(rounds if total else 0):
        shared = words.sparkSession.sparkContext.broadcast(model)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(vocabulary, *shared.value)
            totals = np.zeros(lattice.of.size)
            for batch in slices(batches, 0):
                totals += lattice.expected([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], np.asarray(batch.column(1)))
            parts = np.rint(totals * PARTS).astype(np.int64)
            at = np.flatnonzero(parts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(parts[at])], names=["piece", "n"])

        found = words.select("word", "c").mapInArrow(counted, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        model = ({r["piece"]: r["n"] / PARTS for r in found.collect()}, float(ends), SMOOTH)
    return model


def scores(docs: DataFrame, vocabulary: str = VOCABULARY, fold: int = 0, folds: int = 10) -> DataFrame:
    """SCORED for each row of docs: score is the lattice's log10 probability of the text, base_score the smoothed
    unigram one of its words.

    A null or empty text has the end as its only token. A null doc_id counts as empty text in the choice of held-out
    rows. Without training rows every count is 0 and all scores follow from smoothing alone. Repeated rows count and
    are scored each; an empty table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    with working(spark) as tables:
        out = _scores(docs, vocabulary, fold, folds)
        tables.keep(out)
    return out


def _scores(docs: DataFrame, vocabulary: str, fold: int, folds: int) -> DataFrame:
    blocks = coded(docs, fold, folds)
    words = blocks.filter("word IS NOT NULL")
    totals = written(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    trained = totals.filter("c > 0")
    n, v = trained.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = trained.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    fit = fitted(trained.filter(F.col("word") != F.lit(END)), ends, vocabulary)
    model = docs.sparkSession.sparkContext.broadcast(fit)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, *model.value)
        for batch in slices(batches, 0):
            own = batch.column(0).to_pylist()
            log = lattice.log_probabilities([w.decode("utf-8", "replace") for w in own])
            log[[w == END for w in own]] = lattice.end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log / LOG10)], names=["word", "c", "own"])

    by_word = written(totals.mapInArrow(weighed, "word binary, c long, own double"), "lm-weights")
    back = words.select("block", "key", "word").join(by_word, "word")
    back = back.select("block", "key", F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("ids"), "c", "own")
    texts = blocks.filter("ids IS NOT NULL").select(
        "block", "key", "held_out", "ids", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("own")
    )

    def of_block(table: pa.Table) -> pa.Table:
        own, rows = table.filter(pc.is_valid(table.column("c"))), table.filter(pc.is_valid(table.column("ids")))
        order = np.argsort(own.column("key").to_numpy())
        c, log = own.column("c").to_numpy()[order], own.column("own").to_numpy()[order]
        base = np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1)))
        unpack = zstandard.ZstdDecompressor().decompress
        found = []
        for packed in rows.column("ids"):
            x = np.frombuffer(unpack(packed.as_py()), np.int32)
            found.append((len(x), int((c[x] > 0).sum()), n, float(base[x].sum()), float(log[x].sum())))
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        arrays = [rows.column("key"), rows.column("held_out"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))]
        return pa.table(arrays, names=[x.split()[0] for x in SCORED.split(", ")])

    # a block is a task's work: as many tasks as blocks, so none gets more as the input grows
    count = blocks.select("block").distinct().count()
    parts = max(count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(texts.unionByName(back).repartition(parts, "block").groupBy("block").applyInArrow(of_block, SCORED), "lm-scores")

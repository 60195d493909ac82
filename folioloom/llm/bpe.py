"""BPE encoding by dynamic programming over prefixes, and decoding.

Exactly one token can end the encoding of a prefix. An automaton over the vocabulary finds the tokens that end at a
place; of these the one is right whose predecessor, the last token of the prefix before it, stays apart from it when both
are merged as BPE does. Following last tokens back from the end gives the ids, in time linear in the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: A tokenizer's file; its place on every executor is a parameter.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/word_bpe_49k.json")
#: Entries of a worker's memories of pieces, words and pairs.
REMEMBERED = 300_000
#: Text is cut here before anything else, as no token of a tokenizer that drops white space reaches over it.
_GAPS = re.compile(r"[\x20\x09-\x0D]+")
#: Plain pieces, and the words of their lower-case form: what the tokenizer's own normalizer and pattern give for them. The
#: letters are those of ASCII and Latin-1, which have one form each.
_PLAIN = re.compile(r"[!-;=-~\xC0-\xD6\xD8-\xF6\xF8-\xFF]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFF]+")
#: Characters of a text that are handled at once; longer only where no white space is.
BLOCK = 1 << 18
#: The normalizer and pre-tokenizer for which _PLAIN and _WORDS hold.
_LOWER_CASE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_NEVER = 1 << 60
#: Moves a letter that ends a word out of the way of letters that don't; all letters of a byte alphabet lie below.
_END = 0x1000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Tokens, merges and automaton of a tokenizer whose pre-tokenizer gives byte-level words."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        known = Tokenizer.from_file(path)
        self.normalize, self.words = known.normalizer.normalize_str, known.pre_tokenizer.pre_tokenize_str
        self.plain = {k: stated[k] for k in ("normalizer", "pre_tokenizer")} == _LOWER_CASE and all(t["content"].startswith("<") for t in stated["added_tokens"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.names = {i: name for name, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.names |= {i: name for name, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        ids = {self.inner(name): i for name, i in model["vocab"].items() if name not in self.special}
        #: rank and result of merging a pair of ids
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = ids[self.inner(a)], ids[self.inner(b)]
            both = model["vocab"][self.names[a] + self.names[b]]
            if both in made or any(p in made and made[p][0] > rank for p in (a, b)):
                raise ValueError(f"merge {rank} of {path} is not the only one of its token, or comes before its parts")
            self.merges[a, b], made[both] = (rank, both), (rank, a, b)
        self.letters = {name: i for name, i in ids.items() if len(name) == 1}
        self.right, self.left = {}, {}
        for i in ids.values():  # in the order of ids, parts may come later: the spines are walked down
            self.right[i], self.left[i] = self._spine(made, i, 2), self._spine(made, i, 1)
        self.automaton = ahocorasick.Automaton()
        for name, i in ids.items():
            if self.merged(name) == [i]:  # else the token never comes about
                self.automaton.add_word(name, (len(name), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.word_ids: dict[str, tuple[int, ...]] = {}
        own = range(0xDF, 0x100)
        self.byte_level = {c: self.words(chr(c))[0][0] for c in own if chr(c).isalpha()} if self.plain else {}

    def inner(self, name: str) -> str:
        """A token with its last letter moved if it ends a word, so that every symbol is one character."""
        if self.suffix and name.endswith(self.suffix):
            name = name[: -len(self.suffix)]
            return name[:-1] + chr(ord(name[-1]) + _END)
        return name

    @staticmethod
    def _spine(made: dict, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge of a token as it grows, smallest first, each with the rank of the merge that ends it."""
        found, until = [], _NEVER
        while True:
            found.append((token, until))
            if token not in made:
                return found[::-1]
            until, token = made[token][0], made[token][side]

    def merged(self, word: str) -> list[int]:
        """The plain rule, for a token's own text: merge the pair of lowest rank, the leftmost first."""
        own = [self.letters[c] for c in word]
        while len(own) > 1:
            rank, at = min((self.merges.get(p, (_NEVER, 0))[0], n) for n, p in enumerate(zip(own, own[1:])))
            if rank == _NEVER:
                break
            own[at : at + 2] = [self.merges[own[at], own[at + 1]][1]]
        return own

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens beside each other stay two tokens.

        Merges happen in the order of their ranks, so at any time one token of a's right edge and one of b's left edge
        touch. They merge if such a merge comes before what ends either; of equal ranks the left one comes first.
        """
        edge_a, edge_b, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, end_x), (y, end_y) = edge_a[i], edge_b[j]
            rank = self.merges.get((x, y), (_NEVER, 0))[0]
            if rank < end_x and rank <= end_y and rank != _NEVER:
                found = False
                break
            if end_x == end_y == _NEVER:
                found = True
                break
            if end_x <= end_y:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED * 4:
            self.pairs.clear()
        self.pairs[a << 20 | b] = found
        return found

    def learn_words(self, words: list[str]) -> None:
        """The ids of pre-tokenized words: their prefixes' last tokens, all words in one line, a line break between any two."""
        line = "\n".join([w[:-1] + chr(ord(w[-1]) + _END) for w in words] if self.suffix else words)
        last: list[int | None] = [None] * (len(line) + 1)
        size = [0] * (len(line) + 1)
        at = 0
        for word in words:
            last[at] = -1  # a word's start
            at += len(word) + 1
        done, pairs = -1, self.pairs
        for end, (length, token) in self.automaton.iter(line):
            if end == done:
                continue
            before = last[end + 1 - length]
            if before is None:
                continue
            if before >= 0:
                apart = pairs.get(before << 20 | token)
                if apart is False or (apart is None and not self.apart(before, token)):
                    continue
            last[end + 1], size[end + 1], done = token, length, end
        at = 0
        for word in words:
            found, end = [], at + len(word)
            while end > at:
                if not size[end]:
                    raise ValueError(f"no token ends at {end - at} of {word[:40]!r}")
                found.append(last[end])
                end -= size[end]
            self.word_ids[word] = tuple(found[::-1])
            at += len(word) + 1

    def parts(self, text: str) -> list[str | int]:
        """The pre-tokenized words of a piece, and the ids of special tokens in it."""
        if self.plain and _PLAIN.fullmatch(text):
            text = text.lower()
            words = _WORDS.findall(text)
            return words if text.isascii() else [w if w.isascii() else w.translate(self.byte_level) for w in words]
        found: list[str | int] = []
        for part in self.split_special(text):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += [word for word, _ in self.words(self.normalize(part))]
        return found

    def learn(self, pieces: list[str]) -> None:
        """Makes pieces known that aren't yet; if there are too many by then, all others are forgotten."""
        wanted = set(pieces)
        new = wanted.difference(self.ids_of)
        if not new:
            return
        if len(self.ids_of) + len(new) > REMEMBERED:
            self.ids_of.clear(), self.text_of.clear()
            new = wanted
        cut = {piece: self.parts(piece) for piece in new}
        words = {w for parts in cut.values() for w in parts if type(w) is str}
        if len(self.word_ids) + len(words) > REMEMBERED:
            self.word_ids.clear()
        if fresh := words.difference(self.word_ids):
            self.learn_words(list(fresh))
        names, of = self.names, self.word_ids
        for piece, parts in cut.items():
            ids = [i for w in parts for i in (of[w] if type(w) is str else (w,))]
            self.ids_of[piece] = struct.pack(f"<{len(ids)}I", *ids)
            self.text_of[piece] = " ".join([names[i] for i in ids])

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The text's pieces between white space, a bounded number at a time."""
        at = 0
        while at < len(text):
            gap = _GAPS.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = gap.start() if gap else len(text)
            yield _GAPS.split(text[at:end])
            at = gap.end() if gap else len(text)

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, and digest of what they decode to: tokens with a space between any two, as this
        kind of tokenizer names no decoder. The whole text is read, and neither list is held at once."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        for pieces in self.blocks(text):
            self.learn(pieces)
            n = self.add(pieces, n, ids, decoded)
        return n, ids.hexdigest(), decoded.hexdigest()

    def add(self, pieces: list[str], n: int, ids, decoded) -> int:
        """Adds known pieces to the digests of a text that has n ids so far; its number of ids then."""
        block = b"".join(map(self.ids_of.__getitem__, pieces))
        if block:
            ids.update(block)
            decoded.update(((" " if n else "") + " ".join(filter(None, map(self.text_of.__getitem__, pieces)))).encode())
        return n + len(block) // 4

    def encode_all(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """encode() of each text; the new words of all that are one block are learned at once."""
        found = [self.encode(t) if len(t) > BLOCK else None for t in texts]
        cut = [_GAPS.split(t) if x is None else [] for t, x in zip(texts, found, strict=True)]
        self.learn([p for pieces in cut for p in pieces])
        for i, pieces in enumerate(cut):
            if found[i] is None:
                ids, decoded = hashlib.sha256(), hashlib.sha256()
                found[i] = self.add(pieces, 0, ids, decoded), ids.hexdigest(), decoded.hexdigest()
        return found

    def ids(self, text: str) -> list[int]:
        """All ids of a text."""
        found = bytearray()
        for pieces in self.blocks(text):
            self.learn(pieces)
            found += b"".join(map(self.ids_of.__getitem__, pieces))
        return np.frombuffer(bytes(found), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each worker."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs.

    A null text is empty: no token, and both digests are those of nothing. Special tokens' names in a text are those tokens.
    A text of any length is encoded whole, in linear time. A null doc_id stays null and repeated rows count each; an empty
    table gives none. Extra columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in slices(batches, 1):
            known = known or vocabulary(path)
            n, ids, decoded = zip(*known.encode_all([t.as_py() or "" for t in batch.column(1)]), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(rows, SCHEMA)


def encoded_ids(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each row of docs, for training files; nulls as in encoded()."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in slices(batches, 1):
            known = known or vocabulary(path)
            ids = pa.array([known.ids(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(rows, "doc_id long, ids array<int>")


def decoded_texts(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or vocabulary(path)
            found = [None if x.as_py() is None else known.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long"), rows["ids"]).mapInArrow(texts, "doc_id long, text string")

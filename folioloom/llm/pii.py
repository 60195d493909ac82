"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base entities and keys of a plain shape are seeds. The words before a token, or those after it, are lexical patterns; tokens
that could be identifiers and stand in the same context are a pattern's instances. Patterns and instances form a graph,
scored in rounds: a pattern is trusted by the share of its instances that are, and what a trusted pattern leads to is
trusted and speaks for further patterns in the next round, until a round trusts no new pattern. The patterns that this
leaves are looked up in all texts: one that mostly stands beside ordinary words is none, however good its instances, and the
rounds run again without it. Instances that trusted patterns lead to are found, though no base pattern knows their shape.
Keys are found by their shape too, an addition that is counted by itself.

What a text holds is one row; the graph is built from these rows, and the spans go back to them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small, working, written

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans that the method adds; it comes after the others at one start.
LEARNT = "id"
#: Distinct trusted instances, and instances in all, that a pattern needs; the share of its instances (with DOUBT untrusted
#: ones added) from which it is trusted.
SUPPORT, INSTANCES, TRUST, DOUBT = 3, 4, 0.5, 1.0
#: Least part of a pattern's occurrences in all texts that stand beside a token like an identifier, and patterns that one
#: pass over the texts looks up.
SHARE, LOOKED_UP = 0.5, 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[0-9A-Za-z@+]++(?:[._/-]++[0-9A-Za-z@+]++)*+=*+")
_CONTEXT = re.compile(r"[^\W\d_]+|[=:#]")
#: Keys of a plain shape: long hexadecimal digits, letters and digits after a short prefix, capitals mixed with digits.
_KEY = re.compile(r"(?:[0-9a-f]{16,}|[A-Za-z]{2,6}[-_][0-9A-Za-z]{16,}|[A-Z][0-9A-Z]{19,})\Z")
#: Characters around a token in which whole words of its contexts are looked for (the second ones if the first hold too few
#: words), and words or signs of the patterns before and after it.
REACH, WIDTHS, AFTER = (64, 512), (2, 3), 2

FOUND = (
    "row_id string, doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base array<struct<start:long,kind:int,end:long>>, "
    "tokens array<struct<start:long,end:long,instance:string,patterns:array<string>,seed:boolean,base:boolean>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping. Starts are looked for at each @ only, so long runs of letters cost nothing."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1) if start == at else end
        at = text.find("@", max(at + 1, end if m else at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four groups of digits joined by single dots, leftmost; dropped if a part is over 255. Each run of digits and
    dots is cut at its dots once, however long it is."""
    for run in _DOTTED.finditer(text):
        groups = run.group().split(".")
        if len(groups) < 4:
            continue
        starts, at = [], run.start()
        for g in groups:
            starts.append(at)
            at += len(g) + 1
        i = 0
        while i + 3 < len(groups):
            four = groups[i : i + 4]
            if all(four):
                if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in four):
                    yield starts[i], starts[i + 3] + len(four[3])
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, in order; kind by its place in KINDS."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in ips(text)]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def words_before(text: str, at: int) -> list[str]:
    """The last words or signs of the line before a place, whole ones only."""
    found: list[str] = []
    for reach in REACH:
        first = max(0, at - reach)
        line = text[first:at].rpartition("\n")
        found = _CONTEXT.findall(line[2].lower())
        if line[1] or not first:
            return found
        if found and text[first - 1].isalpha() and text[first].isalpha():
            found = found[1:]
        if len(found) >= max(WIDTHS):
            return found
    return found


def words_after(text: str, at: int) -> list[str]:
    """The first words or signs of the line after a place, whole ones only."""
    found: list[str] = []
    for reach in REACH:
        last = min(len(text), at + reach)
        line = text[at:last].partition("\n")
        found = _CONTEXT.findall(line[0].lower())
        if line[1] or last == len(text):
            return found
        if found and text[last - 1].isalpha() and text[last].isalpha():
            found = found[:-1]
        if len(found) >= AFTER:
            return found
    return found


def patterns_around(text: str, start: int, end: int) -> list[str]:
    """The contexts of text[start:end] on its line: "< " with each of WIDTHS words or signs before it, "> " with AFTER
    after it, in lower case. A context without a word, or one that the line cuts short, is none, and so is one whose words lie
    beyond REACH."""
    before, after = words_before(text, start), words_after(text, end)
    found = ["< " + " ".join(before[-n:]) for n in WIDTHS if len(before) >= n and any(map(str.isalpha, before[-n:]))]
    if len(after) >= AFTER and any(map(str.isalpha, after[:AFTER])):
        found.append("> " + " ".join(after[:AFTER]))
    return found


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and all: how often the words of each pattern stand together on a line of any text, whatever is beside them. The
    patterns are looked up LOOKED_UP at a time."""
    dealt = patterns.withColumn("part", F.lit(0)) if (n := patterns.count()) <= LOOKED_UP else patterns.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(-(-n // LOOKED_UP))).cast("int"))
    found = None
    for part in range(-(-n // LOOKED_UP)):
        names = [r[0] for r in dealt.filter(F.col("part") == part).select("pattern").collect()]  # about LOOKED_UP short texts
        shared = docs.sparkSession.sparkContext.broadcast({tuple(x.split(" ")) for x in names})

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted, seen = shared.value, Counter()
            runs = {x[1:] for x in wanted}  # a run of words may be a pattern on both sides
            widths = sorted({len(x) for x in runs})
            for batch in batches:
                for text in batch.column(0):
                    for line in (text.as_py() or "").lower().split("\n"):
                        words = _CONTEXT.findall(line)
                        for width in widths:
                            seen.update(filter(runs.__contains__, zip(*(words[i:] for i in range(width)))))
            kept = [x for x in wanted if seen[x[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(x) for x in kept], pa.string()), pa.array([seen[x[1:]] for x in kept], pa.int64())], names=["pattern", "n"])

        own = docs.select(F.col("text").cast("string")).mapInArrow(counted, "pattern string, n long")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return patterns.select("pattern", F.lit(0).cast("long").alias("all"))
    return found.groupBy("pattern").agg(F.sum("n").alias("all"))


def identifier_like(token: str) -> bool:
    """Whether a token could be an identifier: two digits or more among at least six characters, or an @."""
    return (len(token) >= 6 and sum("0" <= c <= "9" for c in token) >= 2) or "@" in token


def is_key(token: str) -> bool:
    """Whether a token is a key by its shape alone: one of _KEY, with letters and at least two digits."""
    return bool(_KEY.match(token)) and sum("0" <= c <= "9" for c in token) >= 2 and any(map(str.isalpha, token))


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, instance, patterns, seed, base) of the base entities and of other tokens like identifiers. A token ends
    at = or : and so has them in its context."""
    found = [(start, end, text[start:end], patterns_around(text, start, end), True, True) for start, _, end in base]
    if not (_DIGIT.search(text) or "@" in text):
        return found
    taken = 0
    spans = sorted((s, e) for s, _, e in base)
    for m in _TOKEN.finditer(text):
        token = m.group().rstrip("=@+")
        if not identifier_like(token):
            continue
        end = m.start() + len(token)
        while taken < len(spans) and spans[taken][1] <= m.start():
            taken += 1
        if any(s < end and m.start() < e for s, e in spans[taken : taken + 4]):
            continue
        seed, patterns = is_key(token), patterns_around(text, m.start(), end)
        if seed or patterns:
            found.append((m.start(), end, token, patterns, seed, False))
    return found


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    token = pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()),
        ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()), ("base", pa.bool_()),
    ])
    names = ["row_id", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "tokens"]
    keys = [f.name for f in token]
    task, row = TaskContext.get().partitionId(), 0
    for batch in slices(batches, 1):
        ids, counts, bases, tokens = [], [[], [], [], []], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            ids.append(f"{task}-{row}")
            row += 1
            for kind in range(4):
                counts[kind].append(sum(k == kind for _, k, _ in base))
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            tokens.append([dict(zip(keys, t, strict=True)) for t in tokens_of(text, base)])
        arrays = [pa.array(ids, pa.string()), batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.list_(span)), pa.array(tokens, pa.list_(token))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """pattern, trust and round (from 1) of the patterns that end up trusted, written. edges: pattern, instance and seed,
    one row for each pattern and instance.

    In each round a pattern's trust is the number of its trusted instances over that of all its instances plus DOUBT. It is
    trusted for good from TRUST on, if SUPPORT of its INSTANCES or more are; then all its instances are trusted from the
    next round on, where they count for other patterns. The rounds end when none trusts a new pattern. Edges are written
    once; a round reads those of the instances that the one before reached, and adds to the patterns' sums. No pattern's
    instances come together in one row.
    """
    with working(edges.sparkSession) as tables:
        sums = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("long")).alias("known"))
        sums = written(sums.filter(F.col("n") >= INSTANCES), "pii-sums")
        open_edges = edges.filter("NOT seed").join(small(sums.select("pattern")), "pattern", "left_semi")
        open_edges = written(open_edges.select("pattern", "instance"), "pii-edges")
        trusted, reached, r = None, None, 0
        while True:
            r += 1
            now = sums.withColumn("trust", F.col("known") / (F.col("n") + DOUBT))
            now = now.filter((F.col("known") >= SUPPORT) & (F.col("trust") >= TRUST)).select("pattern", "trust", F.lit(r).alias("round"))
            if trusted is not None:
                now = now.join(small(trusted.select("pattern")), "pattern", "left_anti")
            now = written(now, f"pii-new-{r}")
            if now.isEmpty():
                out = written(now if trusted is None else trusted, "pii-trusted")
                tables.keep(out)
                return out
            trusted = now if trusted is None else written(trusted.unionByName(now), f"pii-trusted-{r}")
            front = open_edges.join(small(now.select("pattern")), "pattern", "left_semi").select("instance").distinct()
            front = written(front if reached is None else front.join(small(reached), "instance", "left_anti"), f"pii-front-{r}")
            reached = front if reached is None else written(reached.unionByName(front), f"pii-reached-{r}")
            gained = open_edges.join(small(front), "instance", "left_semi").groupBy(F.col("pattern").alias("gained_pattern")).agg(F.count(F.lit(1)).alias("gained"))
            sums = sums.join(gained, F.col("pattern") == F.col("gained_pattern"), "left")
            sums = written(sums.select("pattern", "n", (F.col("known") + F.coalesce("gained", F.lit(0))).alias("known")), f"pii-sums-{r}")


def learnt_patterns(docs: DataFrame, each: DataFrame) -> DataFrame:
    """trusted_patterns() of the tokens (instance, seed, patterns) of docs, among the patterns that mostly stand beside tokens like
    identifiers. Leaving patterns out never makes another one trusted, so those that the rounds over all of them don't trust
    need no look-up."""
    with working(docs.sparkSession) as tables:
        stands = each.select("instance", "seed", F.explode("patterns").alias("pattern"))
        edges = stands.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("stands"))
        edges = written(edges, "pii-all-edges")
        likely = trusted_patterns(edges.drop("stands")).select("pattern")
        beside = edges.join(small(likely), "pattern", "left_semi")
        beside = written(beside, "pii-likely-edges")
        counts = written(beside.groupBy("pattern").agg(F.sum("stands").alias("stands")), "pii-stands")
        everywhere = written(occurrences(docs, counts.select("pattern")), "pii-occurrences")
        shared = counts.join(everywhere, "pattern").filter(F.col("stands") >= SHARE * F.col("all"))
        kept = written(shared.select("pattern"), "pii-shared")
        out = trusted_patterns(beside.join(small(kept), "pattern", "left_semi").drop("stands"))
        tables.keep(out)
    return out


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of docs; n_id, the number of spans that are
    added: tokens that stand in a trusted pattern, and keys; and n_key, the number of keys among them that no trusted pattern
    leads to.

    A null text is empty and, like any text without entities, has the digest of the empty string and no spans. Repeated
    rows count once in the graph (its edges are distinct), though each for a pattern's occurrences, and get their own results. Ties don't arise: trust has a
    threshold and no rank. An empty table gives an empty result. Extra columns are ignored.
    """
    with working(docs.sparkSession) as tables:
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_found, FOUND)
        rows = written(rows, "pii-rows")
        each = rows.filter(F.size("tokens") > 0).select("row_id", F.explode("tokens").alias("t")).select("row_id", "t.*")
        trusted = learnt_patterns(docs, each)
        own = each.filter("NOT base").select("row_id", "start", "end", "seed", F.explode_outer("patterns").alias("pattern"))
        own = own.join(small(trusted.withColumn("trusted", F.lit(True)).select("pattern", "trusted")), "pattern", "left").filter("seed OR trusted")
        more = own.groupBy("row_id").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("more"), F.size(F.collect_set(F.when(F.col("trusted"), F.col("start")))).alias("led"))
        more = written(more.withColumnRenamed("row_id", "more_id"), "pii-more")
        out = rows.drop("tokens").join(small(more, 200_000), F.col("row_id") == F.col("more_id"), "left")
        names = F.array(*(F.lit(k) for k in (*KINDS, LEARNT)))
        label = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
        added = F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>"))
        out = out.select(
            "doc_id", "n_email", "n_ip", "n_card", "n_phone",
            F.sha2(F.array_join(F.transform("base", label), ","), 256).alias("base_sha256"),
            F.array_join(F.transform(F.array_sort(F.concat("base", added)), label), ",").alias("spans"),
            F.size(added).cast("long").alias("n_id"), (F.size(added) - F.coalesce("led", F.lit(0))).cast("long").alias("n_key"),
        )
        out = written(out, "pii-found")
        tables.keep(out)
    return out

"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word, sentence and identifier patterns of the document domain.
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?。])\s+"
BLOCK_SENTENCE_END = r"(?<=[.!?])\s+"
HANGUL = "[가-힣]"
NUMBER = r"(?i)\b(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)(?:%|개|명|건|만|천|[KMBTG]B?|gb|mb|kb)?\b"
KEYWORD = r"[가-힣]{2,}|[a-zA-Z]{3,}"
MATH_CHARS = (
    "∀∃∑∏∫√≤≥≠≈∞αβγδεζηθικλμνξπρσςτυφχψω"
    "ΓΔΘΛΞΠΣΦΨΩ∂∇⊕⊗⊖⊘⊙±×÷∈∉⊂⊃⊆⊇∪∩∧∨¬→←↔⇒⇐⇔"
    "∝∠∡∢∴∵∼≅≡≜≝≐≑∓∔∤∥∦∷⋅⋆⋇⋈⋉⋊"
)
MATH_FONT = r"(?i)(math|stix|cmsy|cmex|cmmi|cmr\d|symbol|asana)"
COUNTRIES = "KR|US|JP|EP|WO|CN|DE|FR|GB"


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Runs of non-space characters in order."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def counted(terms: Column) -> Column:
    """array<struct<term, n>> of an array's distinct values: it is sorted, and each run of one value counted, in its row."""

    def of_sorted(s: Column) -> Column:
        every = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array(F.filter(every, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))), lambda starts: of_runs(s, starts))[0]

    def of_runs(s: Column, starts: Column) -> Column:
        return F.transform(starts, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(s)) - at).alias("n")))

    return F.transform(F.array(F.sort_array(terms)), of_sorted)[0]


def share(n: Column, text: Column) -> Column:
    """n characters as a part of a text's."""
    return n / F.greatest(F.length(text), F.lit(1))


def detect_lang(text: Column) -> Column:
    """'ko' from 15 % Hangul among all characters, else 'en'."""
    return F.when(share(F.regexp_count(text, F.lit(HANGUL)), text) >= 0.15, "ko").otherwise("en")


def hangul_share(text: Column) -> Column:
    """Hangul among the characters that aren't white space."""
    return F.regexp_count(text, F.lit(HANGUL)) / F.greatest(F.regexp_count(text, F.lit(r"\S")), F.lit(1))


def overlap_score(query_words: Column, text: Column) -> Column:
    """Distinct words shared with the query, over the text's distinct words."""
    own = F.array_distinct(words(F.lower(text)))
    return F.size(F.array_intersect(own, query_words)) / F.greatest(F.size(own), F.lit(1))


# Spaces between Hangul letters, and numbering before a heading.
BETWEEN_HANGUL = r"(?<=[가-힣])\s+(?=[가-힣])"
NUMBERING = r"^\s*(?:\d+(?:\.\d+)*[\.\)]?\s*)+"


def match_text(text: Column) -> Column:
    """White space collapsed, and none between Hangul letters. Texts are rewritten only where there is something to it."""
    collapsed = F.trim(F.when(text.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(text, r"\s+", " ")).otherwise(text))
    spaced = lambda t: F.when(t.rlike("[가-힣] [가-힣]"), F.regexp_replace(t, BETWEEN_HANGUL, "")).otherwise(t)
    return F.transform(F.array(collapsed), spaced)[0]


def without_numbering(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NUMBERING, ""))


def math_density(text: Column) -> Column:
    return share(F.length(text) - F.length(F.translate(text, MATH_CHARS, "")), text)


def numbers(text: Column) -> Column:
    """Distinct numbers with thousands separators removed; whole numbers under ten don't count."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    value = lambda n: n.cast("double")
    return F.array_distinct(F.filter(found, lambda n: ~((value(n) < 10) & (value(n) == F.floor(value(n))))))


def is_ascii(text: Column) -> Column:
    """Whether every character is one byte in UTF-8."""
    return F.octet_length(text) == F.length(text)


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double precision; vectors have unit length."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    norm = lambda v: F.sqrt(cosine(v, v))
    return F.transform(F.array(a), lambda v: F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(1e-12))))[0]


def chunk_id(doc: Column, section: Column, start: Column, text: Column) -> Column:
    """First twelve hex digits of an MD5 over where a chunk stands and how it begins."""
    return F.substring(F.md5(F.concat_ws(":", doc.cast("string"), section, start.cast("string"), F.substring(text, 1, 50))), 1, 12)


def collection_name(name: Column) -> Column:
    """Letters, digits, _ and -; starts with a letter; at most 63 characters."""
    safe = F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "_")
    return F.substring(F.when(safe.rlike(r"^[a-zA-Z]"), safe).otherwise(F.concat(F.lit("col_"), safe)), 1, 63)


def index_file_name(name: Column) -> Column:
    """A file name that is safe, short and different for different collections."""
    safe = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_"), 1, 80)
    return F.concat(safe, F.lit("__"), F.substring(F.sha1(name), 1, 10))


def document_id(file_name: Column) -> Column:
    """The stem in lower case, spaces as underscores."""
    return F.lower(F.replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), F.lit(" "), F.lit("_")))


# Signed tokens, API keys, and the flags whose value is secret.
SIGNED_TOKEN, API_KEY = r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"sk-[A-Za-z0-9_-]{20,}"
SECRET_FLAGS = ("--token", "--openai-api-key")


def redacted(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Without the given secrets, signed tokens and API keys."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    return F.regexp_replace(F.regexp_replace(text, SIGNED_TOKEN, "[REDACTED_JWT]"), API_KEY, "[REDACTED_OPENAI_KEY]")


def redacted_arguments(arguments: Column) -> Column:
    """A command's arguments without the values after secret flags; such a value is no flag itself."""

    def step(state, x):
        hidden = state["hide"]
        flag = F.coalesce(~hidden & x.isin(*SECRET_FLAGS), F.lit(False))
        return F.struct(F.array_append(state["out"], F.when(hidden, "[REDACTED]").otherwise(x)).alias("out"), flag.alias("hide"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))
    return F.aggregate(arguments, start, step)["out"]


def pieces(text: Column, size: int = 24) -> Column:
    """A text cut every `size` characters."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def json_block(text: Column) -> Column:
    """The first object or list of a text that may be fenced; empty if there is none."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)


def compatible(text: Column) -> Column:
    """Unicode compatibility forms (NFKC), which Spark lacks: a pandas function, for the few texts of a query set."""

    @F.pandas_udf("string")
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return normalized(text)


def normalized_span(text: Column) -> Column:
    """Compatibility forms, soft hyphens and line-end hyphens removed, lower case, spaces collapsed."""
    text = F.regexp_replace(F.replace(compatible(text), F.lit("\u00ad"), F.lit("")), r"-\s*\n\s*", "")
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def holds_span(context: Column, span: Column) -> Column:
    """Whether a context holds an answer's span, both normalized."""
    return F.contains(normalized_span(context), normalized_span(span))


def metric_text(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.3f", value))


def keyword_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords stand in the text, as substrings."""
    return sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), start=F.lit(0))


def mime(head: Column) -> Column:
    """Type by the first bytes: PDF, zipped office document, text (valid UTF-8 without NUL), or neither."""
    start = lambda n: F.hex(F.substring(head, 1, n))
    text = F.is_valid_utf8(head.cast("string")) & ~F.contains(head.cast("string"), F.lit("\0"))
    return (
        F.when(start(5) == "255044462D", "application/pdf")
        .when(start(4) == "504B0304", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(text, "text/plain")
        .otherwise("application/octet-stream")
    )


def password_fault(password: Column) -> Column:
    """The first rule that a password breaks: length (ten), letter, digit, sign; null if it breaks none."""
    return (
        F.when(F.length(password) < 10, "length")
        .when(~password.rlike("[A-Za-z]"), "letter")
        .when(~password.rlike("[0-9]"), "digit")
        .when(~password.rlike(r"[^\p{L}\p{N}_\s]"), "sign")
    )

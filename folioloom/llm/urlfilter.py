"""URL rules indexed by their rarest literal token.

A rule is a pattern over host + path. Rules are a table; each is filed under one of its literal tokens, the one that the
fewest URLs hold. A URL's own tokens are joined with the index and so fetch candidate rules, and only those run their
regular expressions. Nothing in the plan grows with the number of rules.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, working, written

TOKEN = r"[a-z0-9]+"
#: Rules that are broadcast as a table of texts; more are joined by shuffle.
RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """action 'allow' or 'block'. kind 'site': host and its subdomains, path prefix; text is host + path. kind
    'pattern': text is matched anywhere in host + path, in lower case; * stands for any run of characters, and ^ for
    the start or end or a character that is neither a letter, digit, nor one of _ - . %"""

    text: str
    action: str
    kind: str = "site"


#: The list that op3 applies.
SITES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)
#: The default of what decides where no site rule fits: patterns of hosts made for spam. A URL that none of them fits is
#: allowed. Real lists of any length are given as a table.
PATTERNS = tuple(
    Rule(text, "block", "pattern")
    for text in (
        "cheap-pills.*/", "spam-farm.*/", "online-casino*/", "-casino.", "casino-", "-pills.", "free-slots", "payday-loan",
        "porn.", "-viagra", "viagra-", "adult-cam", "replica-watches", "essay-writing", "click-bait.", "link-farm.", "-warez.",
    )
)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """A short list of rules as a table: text, action, kind. (Long lists are tables to begin with.)"""
    each = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("text", "action", "kind"), astuple(r), strict=True))) for r in rules))
    return spark.range(1).select(F.inline(each))


def regex(text: Column, kind: Column) -> Column:
    """For rlike over host + path (pattern rules: in lower case)."""
    site = F.concat(F.lit(r"^(?:[^/]*\.)?"), F.regexp_replace(text, r"([^A-Za-z0-9/_])", r"\\$1"))
    other = F.regexp_replace(text, r"([^A-Za-z0-9/_*^])", r"\\$1")
    other = F.replace(F.replace(other, F.lit("^"), F.lit("(?:^|$|[^a-z0-9_.%-])")), F.lit("*"), F.lit(".*"))
    return F.when(kind == "site", site).otherwise(F.concat(F.lit("(?s)"), other))


def literal_tokens(text: Column, kind: Column) -> Column:
    """Tokens that every URL fitting the rule holds whole: those bounded on both sides by a literal or an anchor."""
    inner = F.regexp_extract_all(F.lower(text), F.lit(r"(?<=[^*a-z0-9])[a-z0-9]+(?=[^*a-z0-9])"), F.lit(0))
    first = F.regexp_extract_all(F.lower(text), F.lit(r"^[a-z0-9]+(?=[^*a-z0-9])"), F.lit(0))
    return F.array_distinct(F.when(kind == "site", F.concat(first, inner)).otherwise(inner))


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prepared(rules: DataFrame) -> DataFrame:
    """rule_no, text, action, site, regex and tokens of each distinct rule (text, action, kind) that has all three, written."""
    every = rules.select("text", "action", "kind").dropna().distinct()
    found = every.select(
        F.monotonically_increasing_id().alias("rule_no"), "text", "action", (F.col("kind") == "site").alias("site"),
        regex(F.col("text"), F.col("kind")).alias("regex"), literal_tokens(F.col("text"), F.col("kind")).alias("tokens"),
    )
    return written(found, "url-rules")


def filed(rules: DataFrame, held: DataFrame) -> DataFrame:
    """rules with token, the one of their tokens that the fewest URLs hold (held: token, n), ties to the longest, then the
    first; rules without one under the empty string, which every URL fetches."""
    each = rules.select("rule_no", F.explode("tokens").alias("token")).join(held, "token", "left")
    best = each.groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token"))["token"].alias("token"))
    return rules.drop("tokens").join(best, "rule_no", "left").withColumn("token", F.coalesce("token", F.lit("")))


def fitting(places: DataFrame, rules: DataFrame) -> DataFrame:
    """page_no with site and match, structs of text and action: the longest rule (then the last text) of each kind that
    fits, for the places (page_no, exact, place, tokens) that any rule fits. Written."""
    each = places.select("page_no", "exact", "place", F.explode("tokens").alias("token"))
    names = written(rules.select(F.explode("tokens").alias("token")).distinct(), "url-tokens")
    # partial counts; a row for each of the rules' tokens
    held = written(each.select("token").join(small(names), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "url-held")
    index = written(filed(rules, held), "url-index")
    if index.limit(RULES + 1).count() <= RULES:
        pairs = each.join(F.broadcast(index), "token")
    else:  # only page numbers and tokens that a rule is filed under meet the rules; the texts come back by page
        used = small(written(index.select("token").distinct(), "url-used"))
        slim = places.select("page_no", F.explode("tokens").alias("token")).join(used, "token", "left_semi")
        pairs = slim.join(index, "token").join(places.select("page_no", "exact", "place"), "page_no")
    fits = pairs.filter(F.when(F.col("site"), F.regexp(F.col("exact"), F.col("regex"))).otherwise(F.regexp(F.col("place"), F.col("regex"))))
    rank = F.struct(F.length("text").alias("length"), "text", "action")
    return written(
        fits.groupBy("page_no").agg(F.max(F.when(F.col("site"), rank)).alias("site"), F.max(F.when(~F.col("site"), rank)).alias("match")), "url-fits"
    )


def judged(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, pattern for each row of pages; rules: text, action, kind (see Rule), by
    default SITES and PATTERNS.

    The longest fitting site rule decides, else the longest fitting pattern, else the page is allowed; ties in length go to
    the last text. A null URL, or one without ://, has an empty host and path and is allowed. Rules with a null are none,
    and repeated ones count once. Repeated rows are judged each; an empty table gives an empty result. Extra columns
    are ignored.
    """
    spark = pages.sparkSession
    rules = rule_table(spark, (*SITES, *PATTERNS)) if rules is None else rules
    with working(spark) as tables:
        base = pages.select(F.monotonically_increasing_id().alias("page_no"), pages["page_id"], pages["url"], host(pages["url"]).alias("host"), path(pages["url"]).alias("path"))
        base = written(base, "url-places")  # written before it is read, so page_no stays a row's own
        place = F.lower(F.concat("host", "path"))
        tokens = F.array_distinct(F.concat(F.regexp_extract_all(place, F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))
        found = fitting(base.select("page_no", F.concat("host", "path").alias("exact"), place.alias("place"), tokens.alias("tokens")), prepared(rules))
        out = base.join(small(found, 200_000), "page_no", "left").select(
            "page_id", "url", "host", "path", F.col("site.text").alias("rule"),
            F.coalesce("site.action", "match.action", F.lit("allow")).alias("verdict"), F.col("match.text").alias("pattern"),
        )
        tables.keep(base, found)
    return out

"""What surrounds an experiment: which queries and papers apply, whether a query set is sound, what an index holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.operators import retrieval

#: Questions about a document's layout, which say nothing about its content.
META = (
    r"어떤\s+섹션", r"어느\s+섹션", r"어디에\s+있", r"초록(?:에는|은)?\s+어떤\s+내용", r"초록(?:에서는|에서)?\s+다루", r"방법론\s+섹션", r"결과\s+섹션", r"이\s+논문의\s+초록",
    r"이\s+논문의\s+방법론", r"이\s+논문의\s+결과", r"참고\s*문헌(?:은|는)?\s+어디", r"what\s+section", r"where\s+(?:is|are).*(?:reference|section)",
    r"what\s+does\s+the\s+abstract", r"what\s+is\s+in\s+the\s+abstract", r"methodology\s+section", r"results?\s+section",
)
#: Questions that fit any document.
GENERIC = (
    r"^이\s+논문에서\s+제안된\s+모델", r"^이\s+논문에서\s+사용된\s+데이터셋", r"^이\s+논문에서\s+인용된\s+주요", r"^이\s+논문에서\s+언급된\s+특정",
    r"^이\s+논문에서\s+사용된\s+주요", r"^이\s+논문에서\s+제안된\s+방법\s+중\s+하나", r"^이\s+논문에서\s+제시된\s+특정\s+결과\s+값", r"^이\s+논문에서\s+주장하는\s+특정\s+사실",
    r"^이\s+논문에서\s+인용된\s+특정\s+연구", r"^what\s+are\s+the\s+key\s+contributions\s+of\s+the\s+model",
    r"^what\s+is\s+one\s+specific\s+method\s+mentioned\s+in\s+the\s+paper",
)
#: Fixed value: names that stand for documents still to be chosen.
PLACEHOLDER = r"(?:paper|doc|lecture|patent)_[A-Z]_[A-Za-z0-9_]+"
SPAN_LEAST, SPAN_MOST = 5, 500
PREVIEW = 900
CONTENT_CLIP = 500


def applicable(queries: DataFrame, papers: DataFrame) -> DataFrame:
    """queries (with applicable_papers) for each paper that they name, blanks and repeats aside; placeholders are kept
    out."""
    each = queries.withColumn("paper", F.explode(F.array_distinct(F.transform("applicable_papers", lambda p: F.trim(p)))))
    return each.filter((F.col("paper") != "") & ~F.col("paper").rlike(PLACEHOLDER)).join(papers.select("paper"), "paper")


def placeholder_ids(queries: DataFrame) -> DataFrame:
    """query_id and placeholder for each name that a run must not begin with."""
    each = queries.select("query_id", F.explode("applicable_papers").alias("paper"))
    found = F.explode(F.regexp_extract_all("paper", F.lit(PLACEHOLDER), F.lit(0)))
    return each.select("query_id", found.alias("placeholder")).distinct()


def papers_without_queries(queries: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers for which a run could not begin."""
    return papers.select("paper").join(applicable(queries, papers).select("paper"), "paper", "left_anti")


def unknown_names(requested: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Requested configurations (or papers) that don't exist."""
    return requested.select(name).distinct().join(known.select(name), name, "left_anti")


def target_papers(papers: Column) -> Column:
    """Distinct names in order, without blanks, placeholders, and names of several papers at once."""
    trimmed = F.transform(papers, lambda p: F.trim(p))
    return F.array_distinct(F.filter(trimmed, lambda p: (p != "") & ~p.rlike(r"[+()]") & ~p.rlike(PLACEHOLDER)))


def needs_truth(papers: Column, by_paper: Column) -> Column:
    """Whether any of a query's papers lacks a ground truth."""
    return F.exists(papers, lambda p: F.trim(F.coalesce(F.try_element_at(by_paper, p), F.lit(""))) == "")


def query_fault(query: Column, kind: Column) -> Column:
    """The first fault of a generated query, or null: about layout, fit for any document, English where Korean is wanted, or
    the reverse."""
    korean = query.rlike("[가-힣]")
    english = kind == "crosslingual_en"
    return (
        F.when(F.lower(query).rlike("(?:" + ")|(?:".join(META) + ")"), "meta")
        .when(F.lower(query).rlike("(?:" + ")|(?:".join(GENERIC) + ")"), "generic").when(english & korean, "expected English").when(~english & ~korean, "expected Korean")
    )


def set_faults(queries: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """position, fault for query sets (keys, position, query, type, answer_span) against the expected types by position:
    missing or extra rows, another type, an answer span outside 5 to 500 characters, and faults of the query itself.
    Without keys there is one set."""
    keys = list(keys)
    wanted = expected.select("position", F.col("type").alias("wanted"))
    if keys:  # every set is held against the whole list, which is short
        listed = expected.agg(F.collect_list(F.struct("position", F.col("type").alias("wanted"))).alias("x"))
        each = F.array(*(F.struct(F.lit(r.position).alias("position"), F.lit(r.wanted).alias("wanted")) for r in listed.first().x))
        wanted = queries.select(*keys).distinct().select(*keys, F.inline(each))
    both = queries.join(wanted, [*keys, "position"], "full_outer")
    span = F.length(F.trim(F.coalesce("answer_span", F.lit(""))))
    fault = (
        F.when(F.col("query").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("type") != F.col("wanted"), "type")
        .when(~span.between(SPAN_LEAST, SPAN_MOST), "span").otherwise(query_fault(F.col("query"), F.col("type")))
    )
    return both.select(*keys, "position", fault.alias("fault")).filter("fault IS NOT NULL")


def accepted_sets(attempts: DataFrame, expected: DataFrame, most: int = 6) -> DataFrame:
    """set_no, attempt, accepted and feedback: the first of at most `most` attempts (set_no, attempt, position, query, type,
    answer_span) at a query set that has no fault; without one the last attempt. feedback is the first fault of the attempt
    before, which the next prompt was given."""
    rows = attempts.filter(F.col("attempt").between(1, most))
    faults = set_faults(rows, expected, ("set_no", "attempt")).groupBy("set_no", "attempt").agg(F.min(F.struct("position", "fault"))["fault"].alias("fault"))
    tried = rows.select("set_no", "attempt").distinct().join(faults, ["set_no", "attempt"], "left")
    tried = tried.withColumn("feedback", F.lag("fault").over(Window.partitionBy("set_no").orderBy("attempt")))
    good = F.col("fault").isNull()
    best = tried.groupBy("set_no").agg(F.min(F.when(good, F.struct("attempt", good.alias("accepted"), "feedback"))).alias("first"), F.max(F.struct("attempt", good.alias("accepted"), "feedback")).alias("last"))
    return best.select("set_no", F.coalesce("first", "last").alias("x")).select("set_no", "x.*")


def ungrounded(queries: DataFrame, contexts: DataFrame, by: str) -> DataFrame:
    """Queries (by, position, answer_span) whose answer's span their context (by, context) doesn't hold: kept, with a
    warning."""
    from folioloom.functions import text as T

    rows = queries.join(contexts, by)
    return rows.filter(~T.holds_span(F.col("context"), F.col("answer_span"))).select(by, "position")


def previews(hits: DataFrame) -> DataFrame:
    """hits (label, seq, text) with the first of each distinct preview of 900 characters, numbered again in order."""
    cut = hits.withColumn("preview", F.substring("text", 1, PREVIEW))
    first = cut.groupBy("label", "preview").agg(F.min("seq").alias("seq"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("seq")))


def sources(hits: DataFrame, full: bool = False) -> DataFrame:
    """What a client sees of hits (query, doc, text, and scores, section, document and page where there are any): content
    (500 characters unless full), the last score that was set, else 0, and what is missing by its default."""
    score = F.coalesce(*(F.col(c) for c in ("rerank_score", "rrf_score") if c in hits.columns), F.lit(0.0))
    content = F.coalesce(F.col("text") if full else F.substring("text", 1, CONTENT_CLIP), F.lit(""))
    known = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in hits.columns else F.lit(default)
    return hits.select(
        "query", "doc", content.alias("content"), score.alias("score"), known("section", "unknown").alias("section"),
        known("document", "").alias("document"), known("page", 0).alias("page"),
    )


def collection_index(chunks: DataFrame) -> dict[str, DataFrame]:
    """Postings, document frequencies and statistics of every collection (chunks: collection, chunk, text) at once: what
    a service refits one collection at a time after each change."""
    from folioloom.functions import text as T

    split = chunks.select("collection", "chunk", T.tokens(F.col("text")).alias("words"))
    posted = split.select("collection", "chunk", F.size("words").alias("dl"), F.explode("words").alias("term"))
    posted = posted.groupBy("collection", "chunk", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    stats = split.groupBy("collection").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("words")).alias("avg_dl"))
    return {"postings": posted, "dfs": posted.groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df")), "stats": stats}


def collections(chunks: DataFrame) -> DataFrame:
    """collection, n_chunks and n_docs. Chunks are counted by document first, so no row holds a collection's documents."""
    return documents_in(chunks).groupBy("collection").agg(F.sum("n_chunks").alias("n_chunks"), F.count(F.lit(1)).alias("n_docs"))


def documents_in(chunks: DataFrame) -> DataFrame:
    """collection, doc and n_chunks of every document."""
    return chunks.groupBy("collection", "doc").agg(F.count(F.lit(1)).alias("n_chunks"))


def majority_language(chunks: DataFrame, sample: int = 20) -> DataFrame:
    """collection and lang: Korean if at least half of its first chunks (a sample by order) are."""
    first = retrieval.top(chunks, ["collection"], sample, "nth", F.col("chunk"))
    return first.groupBy("collection").agg(F.when(F.avg((F.col("lang") == "ko").cast("int")) >= 0.5, "ko").otherwise("en").alias("lang"))


def request_fault(query: Column, top_k: Column, alpha: Column, beta: Column) -> Column:
    """The first field of a request that is out of range, or null."""
    return (
        F.when(~F.length(query).between(1, 2000), "query").when(~top_k.between(1, 20), "top_k").when(~alpha.between(0, 1), "alpha").when(~beta.between(0, 1), "beta")
    )


def sign_up(users: DataFrame, new: DataFrame) -> DataFrame:
    """users with those of new (email, ...) whose address, in any case, isn't taken; of equal ones the first by user_id."""
    low = F.lower(F.trim("email"))
    fresh = new.withColumn("email", low)
    fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy("email").orderBy("user_id"))).filter("n = 1").drop("n")
    return users.unionByName(fresh.join(users.select(low.alias("email")), "email", "left_anti").select(*users.columns))


def sign_in(users: DataFrame, tries: DataFrame) -> DataFrame:
    """try_id, user_id and fault of tries (try_id, email, password_hash): the user with that address, in any case, and that
    hash, or the same fault whichever of the two is wrong."""
    low = F.lower(F.trim("email"))
    known = users.select(low.alias("email"), F.col("password_hash").alias("own_hash"), "user_id")
    out = tries.withColumn("email", low).join(known, "email", "left")
    user = F.when(F.col("own_hash") == F.col("password_hash"), F.col("user_id"))
    return out.select("try_id", user.alias("user_id"), F.when(user.isNull(), "invalid_credentials").alias("fault"))

"""Conversations, papers, ownership, revoked tokens: tables that are read newest first and replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(rows: DataFrame, by: str, at: str, n: int = 50) -> DataFrame:
    """The n newest rows of each owner; ties by the remaining order of columns."""
    order = Window.partitionBy(by).orderBy(F.col(at).desc(), *(F.col(c) for c in rows.columns if c not in (by, at)))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys. An anti join and a union, so the old rows move once."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row for each key. The whole row is one maximum, so rows are reduced before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(at, *(c for c in rest if c != at))).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys of gone."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def valid_tokens(tokens: DataFrame, revoked: DataFrame, now) -> DataFrame:
    """tokens (jti, ...) that no entry of revoked (jti, expires_at) that still counts revokes."""
    return tokens.join(revoked.filter(F.col("expires_at") > now).select("jti"), "jti", "left_anti")


def owned(rows: DataFrame, user) -> DataFrame:
    return rows.filter(F.col("user_id") == user)


def namespaced(user, collection):
    """A tenant's own name for a collection."""
    return F.concat_ws("__", user.cast("string"), collection)


def messages_markdown(rows: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each conversation as Markdown: a heading for each message's role, a rule between messages."""
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    part = F.concat(F.lit("**"), who, F.lit("**\n\n"), F.col("text"), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct(order, part.alias("part"))))
    body = F.array_join(F.transform(parts, lambda x: x["part"]), "\n---\n\n")
    return rows.groupBy(by).agg(F.concat(F.lit("# Conversation\n\n---\n\n"), body).alias("markdown"))


def last_of_role(rows: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, turn and text of the last message of a role."""
    last = rows.filter(F.col("role") == role).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x"))
    return last.select("conv_id", "x.turn", "x.text")


def repaired(rows: DataFrame) -> DataFrame:
    """Rows with an owner, doc_type 'paper' where there is none, the newest for each owner, collection and document."""
    held = rows.filter(F.col("user_id").isNotNull()).withColumn("doc_type", F.coalesce("doc_type", F.lit("paper")))
    return latest(held, ["user_id", "collection", "doc"], "updated_at")


def request_stats(logs: DataFrame) -> DataFrame:
    """path, status, requests and mean duration from log lines (JSON)."""
    kind = "event string, method string, path string, status int, duration_ms double"
    rows = logs.select(F.from_json("line", kind).alias("x")).select("x.*").filter("event = 'request'")
    return rows.groupBy("path", "status").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def health(store_ok, database_ok):
    """'ok' only if both answer."""
    return F.when(store_ok & database_ok, "ok").otherwise("degraded")


def error_envelope(status, detail):
    """What a client receives for a failed request (JSON): validation errors (422) and a service's own ones say what is wrong,
    any other failure (500) nothing of itself."""
    kind = F.when(status == 422, "validation_error").when(status >= 500, "internal_server_error").otherwise("http_error")
    told = F.when(status >= 500, "Unexpected server error").otherwise(detail)
    return F.when(status >= 400, F.to_json(F.struct(kind.alias("error"), told.alias("detail"))))


def iso_text(at):
    """A time as ISO 8601 text, its microseconds only if there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))

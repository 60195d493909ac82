"""Scores of answers, their means over configurations, and what validates a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.functions import patterns as P
from folioloom.functions import text as T
from folioloom.operators.retrieval import small

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
NOT_FOUND_ALL, NOT_FOUND_DOC = 0.2, 0.5

#: The configurations of the ablation, flags in the order of FLAGS.
FLAGS = ("section_chunking", "hybrid_search", "reranker", "query_router", "hyde", "cad", "scd", "compression")
ABLATION = (
    ("Baseline 1: Naive RAG", 0), ("Baseline 2: + Section Chunking", 1), ("Baseline 3: + BGE-M3 Hybrid Search", 2),
    ("Baseline 4: + Reranker", 3), ("Baseline 5: + Query Router + HyDE", 5), ("Full System: + CAD + SCD + Compression", 8),
)
ALPHAS, BETAS = (0.0, 0.1, 0.3, 0.5, 0.7, 1.0), (0.1, 0.3, 0.5)
#: Decoder configurations (name, contrast, penalty), and those over domains (name, section, citations).
DECODERS = (
    ("Baseline (no decoder)", False, False), ("CAD only (alpha=0.5)", True, False), ("SCD only (beta=0.3)", False, True),
    ("CAD+SCD (alpha=0.5, beta=0.3)", True, True),
)
DOMAINS = (
    ("General RAG (Track 1 Full)", None, False), ("+ Section-aware Chunking", "method", False), ("+ Query Router Section Filter", "result", False),
    ("+ RAPTOR-style Retrieval", "abstract", False), ("+ Citation Tracker", None, True), ("Full Track 2 System", "result", True),
)


def label_score(verdict: Column, strict: bool = False) -> Column:
    """Score of a judge's verdict. The compatible rule looks for labels as substrings in a fixed order, by which
    UNSUPPORTED and IRRELEVANT count as 1; the strict one wants the whole label. Without a label the last number from 0
    to 1 counts, else 0.5."""
    text = F.upper(F.trim(verdict))
    out = None
    for label, score in P.LABELS.items():
        fits = text == label if strict else F.contains(text, F.lit(label))
        out = F.when(fits, score) if out is None else out.when(fits, score)
    numbers = F.regexp_extract_all(F.trim(verdict), F.lit(r"(?<!\d)(?:0(?:\.\d+)?|1(?:\.0+)?)(?!\d)"), F.lit(0))
    return out.when(F.size(numbers) > 0, F.try_element_at(numbers, F.lit(-1)).cast("double")).otherwise(0.5)


def sample_average(*metrics: Column) -> Column:
    """Mean of those that aren't null."""
    held = F.filter(F.array(*metrics), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held))


def metric_means(samples: DataFrame, by: list[str], has_truth: str = "has_truth") -> DataFrame:
    """Means of METRICS for each group, nulls skipped; recall only where all samples have a ground truth; overall is the
    mean of the metrics that there are."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = samples.groupBy(*by).agg(
        *(mean(c).alias(c) for c in METRICS[:3]), F.when(F.bool_and(has_truth), mean(METRICS[3])).alias(METRICS[3])
    )
    return out.select(*by, *(F.round(c, 6).alias(c) for c in METRICS), F.round(sample_average(*(F.col(c) for c in METRICS)), 6).alias("overall"))


def drift_rate(answers: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Share of answers under 30 % Hangul; blank ones count in the whole only."""
    drifted = (F.trim(F.regexp_replace(text, r"\s+", " ")) != "") & (T.hangul_share(F.col(text)) < 0.3)
    return answers.groupBy(*by).agg(F.round(F.avg(drifted.cast("int")), 6).alias("drift_rate"), F.count(F.lit(1)).alias("n_answers"))


def numeric_hallucination(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of samples (answer, truth), among those whose truth has numbers, whose answer has others."""
    extra = F.size(F.array_except(T.numbers(F.col("answer")), T.numbers(F.col("truth")))) > 0
    rows = pairs.withColumns({"judged": F.size(T.numbers(F.col("truth"))) > 0, "extra": extra})
    bad = F.sum((F.col("judged") & F.col("extra")).cast("int"))
    n = F.sum(F.col("judged").cast("int"))
    return rows.groupBy(*by).agg(n.alias("n_judged"), bad.alias("n_extra"), F.round(bad / F.greatest(n, F.lit(1)), 6).alias("rate"))


def config_means(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric over the papers, nulls skipped, by configuration in its order, and the change from the row
    before."""
    means = results.groupBy("config_no", "config").agg(*(F.round(F.avg(m), 6).alias(m) for m in metrics))
    order = Window.orderBy("config_no")
    return means.select("*", *(F.round(F.col(m) - F.lag(m).over(order), 6).alias(f"{m}_change") for m in metrics))


def not_found_rates(answers: DataFrame) -> DataFrame:
    """answers (query_id, docs array, not_found): rate overall (doc null; each query once) and by document, and whether
    it is within the gate."""
    whole = answers.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("not_found").cast("int")).alias("missing")).withColumn("doc", F.lit(None).cast("string"))
    each = answers.select("query_id", "not_found", F.explode("docs").alias("doc"))
    each = each.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("not_found").cast("int")).alias("missing"))
    rows = whole.select("doc", "n", "missing").unionByName(each)
    rate = F.col("missing") / F.greatest("n", F.lit(1))
    gate = F.when(F.col("doc").isNull(), NOT_FOUND_ALL).otherwise(NOT_FOUND_DOC)
    return rows.select("doc", "n", "missing", F.round(rate, 6).alias("rate"), (rate <= gate).alias("passed"))


def run_valid(samples: DataFrame, by: list[str]) -> DataFrame:
    """Whether each run has samples with answers and a metric that isn't zero."""
    any_metric = F.bool_or(F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in METRICS[:3])) > 0)
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), any_metric.alias("any_score"), F.bool_and(F.trim("answer") != "").alias("all_answered"))


def switched(results: DataFrame, metric: str, on: str, off: str) -> DataFrame:
    """Change of a metric between two configurations, by paper."""
    of = lambda name: F.max(F.when(F.col("config") == name, F.col(metric)))
    return results.groupBy("paper").agg(F.round(of(on) - of(off), 6).alias("change"))


def grid(configs: DataFrame, papers: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each configuration, paper, and query (applicable_papers array) that applies to the paper. Queries meet
    papers by an equal key; the few configurations are replicated last, in broadcast."""
    each = queries.withColumn("paper", F.explode(F.array_distinct(F.transform("applicable_papers", lambda p: F.trim(p)))))
    held = each.join(papers.select("paper"), "paper")
    return held.join(small(configs, 10_000))


def remaining(planned: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do: all that isn't completed."""
    return planned.join(results.filter("status = 'completed'").select(*keys).distinct(), keys, "left_anti")


def ablation_flags(spark) -> DataFrame:
    """config_no, config and its flags: each configuration switches the first few on."""
    rows = [(i, name, *(k < n for k in range(len(FLAGS)))) for i, (name, n) in enumerate(ABLATION)]
    return spark.createDataFrame(rows, f"config_no int, config string, {', '.join(f'use_{f} boolean' for f in FLAGS)}")


#: Columns that every grid's configurations have.
CONFIG = "mode string, config_no int, config string, use_cad boolean, cad_alpha double, use_scd boolean, scd_beta double, section string, track_citations boolean"


def grid_configs(spark) -> DataFrame:
    """CONFIG of the decoder, alpha, beta and domain grids. Contrast is off at alpha 0."""
    rows = [("decoder", i, name, cad, 0.5, scd, 0.3, None, False) for i, (name, cad, scd) in enumerate(DECODERS)]
    rows += [("alpha", i, f"CAD alpha={a}", a > 0, a, False, 0.3, None, False) for i, a in enumerate(ALPHAS)]
    rows += [("beta", i, f"SCD beta={b}", False, 0.5, True, b, None, False) for i, b in enumerate(BETAS)]
    rows += [("domain", i, name, True, 0.5, True, 0.3, section, cited) for i, (name, section, cited) in enumerate(DOMAINS)]
    return spark.createDataFrame(rows, CONFIG)


def decoder_metrics(samples: DataFrame, by: list[str]) -> DataFrame:
    """For each group of samples (answer, truth, and METRICS with has_truth): their means, the rate of numbers that the truth
    lacks, and the drift rate."""
    means = metric_means(samples, by)
    numbers = numeric_hallucination(samples.filter("has_truth"), by).select(*by, F.col("rate").alias("numeric_hallucination"))
    drift = drift_rate(samples, by, "answer").select(*by, "drift_rate")
    return means.join(drift, by).join(numbers, by, "left").withColumn("numeric_hallucination", F.coalesce("numeric_hallucination", F.lit(0.0)))


#: A result's row: what was run, how it ended, and its means.
RESULT = "mode string, paper string, config_no int, config string, status string, error string, n_samples long, average map<string,double>, fetched long, indexed long, saved_at timestamp"


def run_results(samples: DataFrame, planned: DataFrame, metrics: list[str]) -> DataFrame:
    """RESULT without saved_at for each planned run (mode, paper, config_no, config): completed with the means of its samples
    (mode, paper, config, metrics, and error for those that failed), or failed if none of them succeeded. Failed samples are
    left out of the means."""
    keys = ["mode", "paper", "config"]
    good = F.col("error").isNull()
    entries = F.map_from_entries(F.array(*(F.struct(F.lit(m), F.round(F.avg(F.when(good, F.col(m))), 6)) for m in metrics)))
    found = samples.groupBy(*keys).agg(F.sum(good.cast("long")).alias("n_samples"), entries.alias("means"), F.min("error").alias("own_error"))
    rows = planned.join(found, keys, "left").withColumn("ok", F.coalesce("n_samples", F.lit(0)) > 0)
    return rows.select(
        "mode", "paper", "config_no", "config", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"),
        F.when(~F.col("ok"), F.coalesce("own_error", F.lit("no samples"))).alias("error"), F.coalesce("n_samples", F.lit(0).cast("long")).alias("n_samples"),
        F.when(F.col("ok"), F.map_filter("means", lambda _, v: v.isNotNull())).alias("average"),
    )


def save_results(results: DataFrame, path: str) -> None:
    """Appends results; a run that is there already is read in its newest form."""
    kept = results.withColumn("saved_at", F.current_timestamp())
    for column in ("fetched", "indexed"):
        if column not in kept.columns:
            kept = kept.withColumn(column, F.lit(0).cast("long"))
    kept.select(*(c.split()[0] for c in RESULT.split(", "))).write.mode("append").parquet(path)


def load_results(spark, path: str) -> DataFrame:
    """The newest result of each run kept under path. A completed run is never given up for a later one that failed."""
    rows = spark.read.schema(RESULT).parquet(path)
    best = F.max_by(F.struct(*rows.columns), F.struct((F.col("status") == "completed").cast("int"), "saved_at"))
    return rows.groupBy("mode", "paper", "config").agg(best.alias("best")).select("best.*")


def report(results: DataFrame, mode: str, columns: list[tuple[str, str]], title: str) -> DataFrame:
    """line_no and line of a Markdown report on a mode's results: a heading, the papers it is about, and a table with a row
    for each configuration, the mean over papers of each metric (heading, name)."""
    rows = results.filter((F.col("mode") == mode) & (F.col("status") == "completed"))
    papers = rows.agg(F.array_join(F.sort_array(F.collect_set("paper")), ", ").alias("papers"))
    means = rows.groupBy("config_no", "config").agg(*(F.round(F.avg(F.try_element_at("average", F.lit(m))), 6).alias(m) for _, m in columns))
    body = table_rows(means, "config", [m for _, m in columns]).select((F.col("config_no") + 5).alias("line_no"), "line")
    head = f"| System | {' | '.join(h for h, _ in columns)} |"
    fixed = [(0, f"## {title}"), (1, ""), (3, head), (4, "|" + "---|" * (len(columns) + 1))]
    named = papers.select(F.lit(2).alias("line_no"), F.concat(F.lit("Conditions: papers="), F.coalesce(F.nullif("papers", F.lit("")), F.lit("N/A"))).alias("line"))
    return results.sparkSession.createDataFrame(fixed, "line_no int, line string").unionByName(named).unionByName(body)


def truth_for(paper: Column, by_paper: Column, plain: Column) -> Column:
    """A paper's own ground truth where there is a map of them (empty if it lacks the paper), else the plain one."""
    return F.when(F.size(by_paper) > 0, F.coalesce(F.try_element_at(by_paper, paper), F.lit(""))).otherwise(F.coalesce(plain, F.lit("")))


def first_answer(attempts: DataFrame) -> DataFrame:
    """query_id, attempt and answer of the first attempt whose answer isn't blank."""
    held = attempts.filter(F.trim("answer") != "")
    best = held.groupBy("query_id").agg(F.min(F.struct("attempt", "answer")).alias("x"))
    return best.select("query_id", "x.attempt", "x.answer")


def bad_query(query: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits, in any case."""
    return F.lower(query).rlike("(?i)(?:" + ")|(?:".join(patterns) + ")")


def table_rows(rows: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """Lines of a Markdown table, three digits a number, N/A for none."""
    cells = [F.col(name), *(T.metric_text(F.col(m)) for m in metrics)]
    return rows.select("config_no", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def backoff(base: float, attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next try: doubled each time, not under what the server asks for."""
    return F.greatest(F.lit(base) * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after, F.lit(0.0)))


def for_each(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """rows, each with every one of the configurations, which are few: a list in each row."""
    kind = configs.schema
    listed = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kind)) for r in configs.collect()))
    return rows.select("*", F.inline(listed))

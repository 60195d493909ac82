"""Arithmetic on next-token scores: contrastive decoding, language penalties, label ranking. Vectors are arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, BETA, TINY = 0.5, 0.3, 1e-10
#: Characters that are no sign of another language, with Hangul syllables and both kinds of letters.
COMMON = r" \n\t\r.,!?()\[\]{}:;\"'\-·…%_/\\0-9"
HANGUL = "\\uAC00-\\uD7A3\\u1100-\\u11FF\\u3130-\\u318F"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def rounded(scores: Column, digits: int = 6) -> Column:
    """Scores rounded half away from zero; what rounds to zero keeps its sign, as in IEEE arithmetic (round() drops it)."""
    return F.transform(scores, lambda x: F.signum(x) * F.round(F.abs(x), digits))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = _sum(powers)
    return F.transform(powers, lambda x: x / total)


def contrast(with_context: Column, without: Column, alpha: Column | float = ALPHA) -> Column:
    """Scores with the context minus alpha times those without."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return F.zip_with(with_context, without, lambda c, e: c.cast("double") - a * e.cast("double"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two distributions."""
    kl = lambda x, y: x * F.ln(x / (0.5 * (x + y) + TINY) + TINY)
    return 0.5 * (_sum(F.zip_with(p, q, kl)) + _sum(F.zip_with(q, p, kl)))


def adaptive_alpha(with_context: Column, without: Column, alpha: float = ALPHA) -> Column:
    """More where the context changes the distribution more; between 0.1 and alpha."""
    jsd = divergence(softmax(with_context), softmax(without))
    return F.least(F.greatest(jsd * alpha * 2, F.lit(0.1)), F.lit(alpha))


def foreign(token: Column) -> Column:
    """Whether a token holds a character outside Hangul and the common ones; an empty token doesn't."""
    return (F.length(token) > 0) & token.rlike(f"[^{HANGUL}{COMMON}]")


def penalized(scores: Column, tokens: Column, beta: float = BETA) -> Column:
    """Scores with beta taken from foreign tokens."""
    return F.zip_with(scores, tokens, lambda s, t: s.cast("double") - F.when(foreign(t), beta).otherwise(0.0))


def processed(with_context: Column, without: Column, tokens: Column, alpha: float | None = ALPHA, beta: float | None = BETA) -> Column:
    """Contrast first, then the penalty; either may be left out."""
    out = F.transform(with_context, lambda x: x.cast("double")) if alpha is None else contrast(with_context, without, alpha)
    return out if beta is None else penalized(out, tokens, beta)


def log_softmax_at(scores: Column, token: Column) -> Column:
    """Log probability of the token at that place (from 0)."""
    top = F.array_max(scores).cast("double")
    return F.element_at(scores, token + 1).cast("double") - top - F.ln(_sum(F.transform(scores, lambda x: F.exp(x.cast("double") - top))))


def ranked_labels(steps: DataFrame) -> DataFrame:
    """steps (prompt, label, label_no, token, scores), a row for each token of each candidate label: the label's summed
    log probability, and whether it is the prompt's best (the first on a tie)."""
    sums = steps.groupBy("prompt", "label", "label_no").agg(F.round(F.sum(log_softmax_at(F.col("scores"), F.col("token"))), 6).alias("log_probability"))
    best = sums.groupBy("prompt").agg(F.max_by("label", F.struct("log_probability", -F.col("label_no"))).alias("best"))
    return sums.join(best, "prompt").withColumn("chosen", F.col("label") == F.col("best")).drop("best", "label_no")


def sampling(contrasted: Column) -> Column:
    """How to draw tokens: the best one when scores are contrasted, else at temperature 0.1 from the top 0.9."""
    none = F.lit(None).cast("double")
    return F.struct(
        (~contrasted).alias("do_sample"), F.when(~contrasted, 0.1).otherwise(none).alias("temperature"), F.when(~contrasted, 0.9).otherwise(none).alias("top_p"),
    )

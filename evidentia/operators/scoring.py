"""From fired signals to reports: capped sums, logistic score, verdict, confidence, and the evidence behind them.

hits is a long table (subject, signal_id, fire_seq, evidence array<string>). The catalogue is a fixed table of some
hundred rows and is always broadcast; the only shuffle is by subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import categories, signals, strength

#: Log-odds before any signal.
PRIOR = -1.0


def excerpt(text: Column, n: int = 140) -> Column:
    """White space collapsed and trimmed; more than n characters become n - 1 and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) > n, F.concat(F.left(flat, F.lit(n - 1)), F.lit("…"))).otherwise(flat)


def first_hits(hits: DataFrame, subject: str = "subject_id") -> DataFrame:
    """One row per subject and catalogued signal: the first firing, with at most four distinct evidence excerpts."""
    spark = hits.sparkSession
    known = hits.join(F.broadcast(signals(spark).select("signal_id")), "signal_id", "left_semi")
    one = known.groupBy(subject, "signal_id").agg(F.min_by("evidence", "fire_seq").alias("evidence"))
    lines = F.filter(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: excerpt(x)), lambda x: x != "")
    return one.select(subject, "signal_id", F.slice(F.array_distinct(lines), 1, 4).alias("evidence")).join(F.broadcast(signals(spark)), "signal_id")


def score_column(logit: Column, converging: Column, fingerprint: Column, thin: Column) -> Column:
    """The reading from 3 to 97 of a log-odds sum, with its guards."""
    raw = F.round(100 / (1 + F.exp(-logit)))
    guarded = F.when((converging == 0) & ~fingerprint & (raw > 55), 55.0).otherwise(raw)
    damped = F.when(F.coalesce(thin, F.lit(False)) & ~fingerprint, F.round(50 + (guarded - 50) * 0.55)).otherwise(guarded)
    capped = F.when(~fingerprint & (damped > 92), 92.0).otherwise(damped)
    return F.least(F.lit(97.0), F.greatest(F.lit(3.0), capped)).cast("int")


def verdict_column(score: Column, converging: Column, fingerprint: Column) -> Column:
    return (
        F.when(fingerprint, "builder_identified").when((score >= 85) & (converging >= 4), "very_likely_ai").when(score >= 72, "likely_ai").when(score >= 58, "leaning_ai")
        .when(score >= 42, "inconclusive").when(score >= 25, "leaning_human").otherwise("likely_human")
    )


def confidence_column(converging: Column, human: Column, fingerprint: Column, thin: Column) -> Column:
    return (
        F.when(fingerprint, "high").when(F.coalesce(thin, F.lit(False)), "insufficient").when((converging >= 4) | (human >= 4), "moderate")
        .when((converging >= 2) | (human >= 2), "low").otherwise("insufficient")
    )


def category_totals(hits: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(subject, category, direction, signals, total, capped) of the first hits."""
    spark = hits.sparkSession
    sums = first_hits(hits, subject).groupBy(subject, "category", "direction").agg(F.count("*").alias("signals"), F.sum("weight").alias("total"))
    return sums.join(F.broadcast(categories(spark).select("category", "cap")), "category").select(subject, "category", "direction", "signals", "total", F.when(F.col("cap").isNull(), F.col("total")).otherwise(F.least("total", "cap")).alias("capped"))


def reports(hits: DataFrame, subjects: DataFrame, subject: str = "subject_id") -> DataFrame:
    """A report per row of subjects (subject, thin): score, verdict, confidence, counts, and signals heaviest first.

    Subjects without hits get the reading of no signals. Hits of unknown signals or subjects are ignored.
    """
    spark = hits.sparkSession
    found = first_hits(hits, subject)
    # one shuffle by subject: sums by category and direction are conditional sums of the same groups
    cats = categories(spark).collect()  # nine rows
    signed = []
    for c in cats:
        for direction, sign in (("ai", 1), ("human", -1)):
            total = F.coalesce(F.sum(F.when((F.col("category") == c["category"]) & (F.col("direction") == direction), F.col("weight"))), F.lit(0).cast("decimal(14,2)"))
            signed.append(sign * (F.least(total, F.lit(c["cap"])) if c["cap"] is not None else total).cast("decimal(14,2)"))
    logit = signed[0]
    for x in signed[1:]:
        logit = logit + x
    ai = F.col("direction") == "ai"
    item = F.struct((-F.col("weight")).alias("order"), F.col("signal_id").alias("id"), "category", "direction", strength(F.col("weight")).alias("strength"), "weight", "evidence")
    sums = found.groupBy(subject).agg(
        logit.cast("double").alias("_logit"), F.count_if(ai).alias("_ai"), F.count_if(ai & (F.col("category") != "aesthetic")).alias("_conv"), F.count_if(~ai).alias("_human"),
        F.count_if(F.col("category") == "fingerprint").alias("_fp"), F.sort_array(F.collect_list(item)).alias("_signals"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = subjects.join(sums, subject, "left").withColumn("_logit", F.coalesce("_logit", F.lit(0.0)) + PRIOR)
    fingerprint, conv = zero("_fp") > 0, zero("_conv")
    rows = rows.withColumn("score", score_column(F.col("_logit"), conv, fingerprint, F.col("thin")))
    return rows.select(
        *subjects.columns, "score", verdict_column(F.col("score"), conv, fingerprint).alias("verdict"), confidence_column(conv, zero("_human"), fingerprint, F.col("thin")).alias("confidence"),
        zero("_ai").alias("ai"), conv.alias("converging"), zero("_human").alias("human"), zero("_fp").alias("fingerprint"),
        F.transform(F.coalesce("_signals", F.array().cast(sums.schema["_signals"].dataType)), lambda s: s.dropFields("order")).alias("signals"),
    )

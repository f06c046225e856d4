"""Reports as JSON, and the signed tokens of their certificates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tokens import report_token
from .scoring import excerpt

# Signals that a certificate names, characters of its target.
CERTIFIED, TARGET = 14, 180


def report_json(mode: str, target: Column, analysed_at: Column, notes: Column | None = None, subtitle: Column | None = None) -> Column:
    """A row of scoring.reports() as the JSON of its report: score, verdict, confidence, signals heaviest first, counts and notes."""
    text = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    said = F.coalesce(notes, F.array().cast("array<string>")) if notes is not None else F.array().cast("array<string>")
    counts = F.struct(F.col("ai"), F.col("converging"), F.col("human"), (F.col("fingerprint") > 0).cast("int").alias("fingerprint"))
    return F.to_json(
        F.struct(
            F.lit(True).alias("ok"), F.lit(mode).alias("mode"), target.alias("target"), text(subtitle).alias("subtitle"), F.col("score"), F.col("verdict"), F.col("confidence"),
            F.col("signals"), counts.alias("counts"), said.alias("notes"), analysed_at.alias("analyzedAt"),
        ),
        {"ignoreNullFields": "false"},
    )


def certificate(mode: str, target: Column, analysed_at: Column, secret: Column, subtitle: Column | None = None) -> Column:
    """(payload, sig, id) of a report's certificate: only what is printed, with the ids of its heaviest signals, signed."""
    fields = {
        "v": F.lit(1), "m": F.lit(mode), "t": excerpt(target, TARGET), "s": F.col("score"), "c": F.col("verdict"), "f": F.col("confidence"), "d": analysed_at,
        "g": F.transform(F.slice("signals", 1, CERTIFIED), lambda s: s["id"]), "n": subtitle if subtitle is not None else F.lit(""),
    }
    return report_token(secret, fields, target=target, at=analysed_at)

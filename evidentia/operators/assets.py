"""A page's own scripts and the sources behind them, read as code and folded into the page's signals.

Each readable script of a page, and the text of its source maps, is a subject of its own below the page. Pages of a site
share scripts, so every different text is analysed once, by its hash; its signals then return to all pages that load it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code as C

# What is worth reading as code.
LEAST_BYTES, LONGEST_LINE, LEAST_LINES = 400, 300, 8
SCRIPT = r"(?i)\.js(?:[?#]|$)"
#: Signals of sub-subjects come after those of the page itself, which has fewer than this.
AFTER_PAGE, A_SUBJECT = 1000, 100


def is_minified(body: Column) -> Column:
    """Whether a text has been through a build step: long lines on average, or few lines."""
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return (F.octet_length(body) > LONGEST_LINE * lines) | (lines < LEAST_LINES)


def sub_subjects(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, sub, src): the readable scripts of each page in the order of its assets, then what its source maps hold, as one text.

    pages has assets (map of address to body) and may have source_maps (array of sources and content). Null or short bodies,
    styles and minified scripts are left out.
    """
    empty = F.array().cast("array<struct<key:string,value:string>>")
    loaded = F.coalesce(F.map_entries("assets"), empty)
    readable = F.filter(loaded, lambda e: F.coalesce((F.octet_length(e["value"]) >= LEAST_BYTES) & e["key"].rlike(SCRIPT) & ~is_minified(e["value"]), F.lit(False)))
    texts = F.transform(readable, lambda e: e["value"])
    if "source_maps" in pages.columns:
        joined = F.array_join(F.transform(F.coalesce("source_maps", F.array()), lambda m: F.concat(F.lit("\n"), F.coalesce(m["content"], F.lit("")))), "")
        texts = F.concat(texts, F.when(C.trimmed(joined) != "", F.array(joined)).otherwise(F.array().cast("array<string>")))
    return pages.select(F.col(id_col).alias("page_id"), F.posexplode(texts).alias("sub", "src"))


def hits(subs: DataFrame) -> DataFrame:
    """(page_id, signal_id, fire_seq, evidence) of sub-subjects: for each page and signal the first that fires, scripts before sources.

    A short script is no reason to call its page thin; the page's own measure stands.
    """
    keyed = subs.withColumn("key", F.sha2("src", 256))
    texts = keyed.groupBy("key").agg(F.first("src").alias("src"))
    found = C.fired(C.features(texts, "key", "src")).withColumnRenamed("subject_id", "key")
    seq = F.lit(AFTER_PAGE) + F.col("sub") * A_SUBJECT + F.col("fire_seq")
    rows = keyed.select("page_id", "sub", "key").join(found, "key").select("page_id", "signal_id", seq.alias("fire_seq"), "evidence")
    first = rows.groupBy("page_id", "signal_id").agg(F.min(F.struct("fire_seq", "evidence")).alias("h"))
    return first.select("page_id", "signal_id", "h.fire_seq", "h.evidence")


def merged(page_hits: DataFrame, sub_hits: DataFrame) -> DataFrame:
    """Signals of pages and of what they load: (page_id, signal_id, fire_seq, evidence), each signal once, the page's own first."""
    both = page_hits.select("page_id", "signal_id", "fire_seq", "evidence").unionByName(sub_hits)
    return both.groupBy("page_id", "signal_id").agg(F.min(F.struct("fire_seq", "evidence")).alias("h")).select("page_id", "signal_id", "h.fire_seq", "h.evidence")

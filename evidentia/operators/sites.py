"""From pages to sites: corroborated signals, structural similarity, spread of lengths, and sitemap dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import signals
from .scoring import excerpt


def required_pages(n):
    """Pages of a site that must show a signal for it to count for the site."""
    return F.greatest(F.lit(2), F.ceil(n * 0.25).cast("int"))


def corroborated(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, signal_id, on_pages) of signals that enough pages of a site show.

    hits: (site, page_id, signal_id); pages: (site, page_id). A fingerprint needs one page, and so does anything on a site
    of one page.
    """
    sizes = pages.groupBy("site").agg(F.count_distinct("page_id").alias("pages"))
    counts = hits.groupBy("site", "signal_id").agg(F.count_distinct("page_id").alias("on_pages"))
    known = counts.join(F.broadcast(signals(hits.sparkSession).select("signal_id", "category")), "signal_id").join(sizes, "site")
    return known.filter((F.col("category") == "fingerprint") | (F.col("pages") == 1) | (F.col("on_pages") >= required_pages(F.col("pages")))).select("site", "signal_id", "on_pages")


def merged(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, signal_id, evidence) of corroborated signals: on how many pages each was found, and three lines of its first page.

    hits: (site, page_id, signal_id, evidence); pages: (site, page_id).
    """
    sizes = pages.groupBy("site").agg(F.count_distinct("page_id").alias("pages"))
    first = hits.groupBy("site", "signal_id").agg(F.min_by("evidence", "page_id").alias("_lines"))
    known = corroborated(hits, pages).join(first, ["site", "signal_id"]).join(sizes, "site").join(F.broadcast(signals(hits.sparkSession).select("signal_id", "category")), "signal_id")
    count = F.concat(F.when(F.col("category") == "fingerprint", "found on ").otherwise("on "), F.col("on_pages").cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(" pages read"))
    lines = F.filter(F.array_distinct(F.transform("_lines", lambda x: excerpt(x))), lambda x: x != "")
    return known.select("site", "signal_id", F.concat(F.when(F.col("pages") == 1, F.array().cast("array<string>")).otherwise(F.array(count)), F.slice(lines, 1, 3)).alias("evidence"))


def shape_tokens(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(site, page_id, token, cnt): how often each tag and class occurs in a page's body."""
    body = F.regexp_extract(html_col, r"(?is)<body[^>]*>(.*)</body>", 1)
    body = F.when(body == "", F.col(html_col)).otherwise(body)
    for tag in ("script", "style", "noscript"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    rows = pages.select("site", "page_id", body.alias("_body"))
    tags = F.transform(F.regexp_extract_all("_body", F.lit(r"(?i)<([a-z][a-z0-9]*)\b"), F.lit(1)), lambda t: F.concat(F.lit("t:"), F.lower(t)))
    attributes = F.regexp_extract_all("_body", F.lit(r"(?i)\bclass=[\"']([^\"']+)[\"']"), F.lit(1))
    classes = F.filter(F.split(F.lower(F.array_join(attributes, " ")), r"\s+"), lambda c: c != "")
    both = F.concat(tags, F.transform(classes, lambda c: F.concat(F.lit("c:"), c)))
    return rows.select("site", "page_id", F.explode(both).alias("token")).groupBy("site", "page_id", "token").agg(F.count("*").alias("cnt"))


def similarity_pairs(tokens: DataFrame) -> DataFrame:
    """(site, a, b, cosine) of the pairs of a site's pages that share a token. Meant for sites of few pages; the mean over large ones is mean_similarity()."""
    norms = tokens.groupBy("site", "page_id").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("norm"))
    x = tokens.join(norms, ["site", "page_id"]).withColumn("w", F.col("cnt") / F.col("norm"))
    a, b = x.select("site", "token", F.col("page_id").alias("a"), F.col("w").alias("u")), x.select("site", "token", F.col("page_id").alias("b"), F.col("w").alias("v"))
    return a.join(b, ["site", "token"]).filter("a < b").groupBy("site", "a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("cosine"))


def mean_similarity(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, pages, similarity): the mean cosine of all pairs of pages, without forming the pairs.

    With unit vectors u of the k pages that have tokens, the sum over pairs is half of |sum u|^2 - k.
    """
    norms = tokens.groupBy("site", "page_id").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("norm"))
    total = tokens.join(norms, ["site", "page_id"]).groupBy("site", "token").agg(F.sum(F.col("cnt") / F.col("norm")).alias("s")).groupBy("site").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    with_tokens = norms.groupBy("site").agg(F.count("*").alias("k"))
    sizes = pages.groupBy("site").agg(F.count_distinct("page_id").alias("pages"))
    pairs = F.col("pages") * (F.col("pages") - 1) / 2
    joined = sizes.join(total, "site", "left").join(with_tokens, "site", "left")
    return joined.filter("pages > 1").select("site", "pages", F.round((F.coalesce("square", F.lit(0.0)) - F.coalesce("k", F.lit(0))) / 2 / pairs, 9).alias("similarity"))


def length_spread(words: DataFrame) -> DataFrame:
    """(site, pages, mean_words, spread, thin_pages, most_words, deepest) from (site, page_id, words)."""
    mean = F.avg("words")
    return words.groupBy("site").agg(
        F.count("*").alias("pages"), F.round(mean, 6).alias("mean_words"), F.round(F.when(mean > 0, F.stddev_pop("words") / mean).otherwise(0.0), 6).alias("spread"),
        F.count_if(F.col("words") < 45).alias("thin_pages"), F.max("words").alias("most_words"), F.max_by("page_id", F.struct("words", -F.col("page_id"))).alias("deepest"),
    )


def sitemap_features(entries: DataFrame) -> DataFrame:
    """(site, urls, dated, dates, spread_days) from (site, loc, lastmod)."""
    return entries.groupBy("site").agg(F.count("*").alias("urls"), F.count("lastmod").alias("dated"), F.count_distinct("lastmod").alias("dates"), F.coalesce(F.date_diff(F.max("lastmod"), F.min("lastmod")), F.lit(0)).alias("spread_days"))


def sitewide_hits(similarity: DataFrame, spread: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """(site, signal_id) of the signals that only a whole site can show."""
    x = spread.join(similarity.select("site", "similarity"), "site", "left")
    c = F.col
    enough = c("pages") >= 3
    rules = {
        "xs.template_uniformity": enough & (c("similarity") >= 0.93),
        "xs.style_drift": enough & (c("similarity") <= 0.62),
        "xs.uniform_page_size": enough & (c("mean_words") > 40) & (c("spread") < 0.18),
        "xs.varied_pages": enough & (c("mean_words") > 40) & (c("spread") > 0.75),
        "xs.placeholder_pages": enough & (c("thin_pages") >= 2) & (c("thin_pages") < c("pages")),
        "xs.deep_content": enough & (c("most_words") >= 900) & (c("most_words") > 1.8 * c("mean_words")),
    }
    found = x.select("site", F.explode(F.filter(F.array(*[F.when(r, F.lit(s)) for s, r in rules.items()]), lambda s: s.isNotNull())).alias("signal_id"))
    if sitemap is None:
        return found
    one_pass = (c("dated") == 0) | ((c("dates") == 1) & (c("dated") >= 5)) | ((c("dates") > 1) & (c("spread_days") <= 1))
    rules = {"xs.sitemap_one_pass": one_pass, "xs.sitemap_history": (c("spread_days") >= 60) & (c("dates") >= 5)}
    more = sitemap.filter("urls >= 5").select("site", F.explode(F.filter(F.array(*[F.when(r, F.lit(s)) for s, r in rules.items()]), lambda s: s.isNotNull())).alias("signal_id"))
    return found.unionByName(more)


def notes(pages: DataFrame) -> DataFrame:
    """(site, pages, notes): codes of what a reader should know of how a site was read; pages: (site, page_id)."""
    said = {"one_page_only": F.col("pages") == 1, "read_across_pages": F.col("pages") > 1, "only_what_is_linked": F.lit(True)}
    sizes = pages.groupBy("site").agg(F.count_distinct("page_id").alias("pages"))
    return sizes.withColumn("notes", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in said.items()]), lambda x: x.isNotNull()))

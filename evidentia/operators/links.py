"""The link graph of pages: extraction, canonical addresses, robots rules and breadth-first depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unescape
from .tables import BROADCAST_ROWS, Folder

# Extensions that are never pages, and addresses that are actions.
SKIP_EXTENSIONS = r"(?i)\.(?:jpg|jpeg|png|gif|webp|avif|svg|ico|bmp|tiff|mp4|webm|mov|avi|mp3|wav|ogg|flac|pdf|zip|gz|tar|rar|7z|dmg|exe|woff2?|ttf|otf|eot|css|js|json|xml|rss|atom|txt|csv|xlsx?|docx?|pptx?)$"
ACTIONS = r"(?i)/(?:logout|signout|sign-out|delete|remove|unsubscribe|cart/add|admin)(?:/|$|\?)"
NO_LINK = r"(?i)^(?:javascript|mailto|tel|data|sms|ftp):"


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    """The path of an address, ``/`` if it has none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]+)", 1)


def canonical(url: Column) -> Column:
    """Host, path without default documents and closing slash, and query; scheme, port and fragment don't count."""
    p = F.regexp_replace(path(url), r"(?i)/(?:index|default)\.(?:html?|php|aspx?)$", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    q = query(url)
    return F.when(host(url) == "", F.lower(url)).otherwise(F.concat(host(url), F.when(p == "", "/").otherwise(p), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))


def absolute(href: Column, base: Column) -> Column:
    """The address that a link as it stands in a page leads to: resolved() after its character references are decoded."""
    return resolved(unescape(href), base)


def resolved(href: Column, base: Column) -> Column:
    """The address that a decoded link leads to, without its fragment; null for links that lead to no document.

    ``.`` and ``..`` are resolved in relative paths.
    """
    h = F.trim(href)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(path(base), "/[^/]*$", "/")
    parts = F.filter(F.split(F.concat(folder, h), "/"), lambda x: ~x.isin("", "."))
    flat = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)))
    found = (
        F.when((h == "") | h.startswith("#") | h.rlike(NO_LINK), F.lit(None).cast("string")).when(h.rlike("(?i)^https?://"), h).when(root == "", F.lit(None).cast("string"))
        .when(h.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), h)).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(root, F.lit("/"), F.array_join(flat, "/")))
    )
    bare = F.regexp_replace(found, "(?s)#.*$", "")
    return F.when(bare != "", bare)


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, link): the distinct documents of the same origin that a page links to."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"']+)[\"']"), F.lit(1))
    rows = pages.select(id_col, F.col(url_col).alias("_base"), F.explode(F.transform(F.array_distinct(hrefs), unescape)).alias("_href")).withColumn("link", resolved(F.col("_href"), F.col("_base")))
    fine = F.col("link").isNotNull() & (origin(F.col("link")) == origin(F.col("_base"))) & ~path(F.col("link")).rlike(SKIP_EXTENSIONS) & ~F.col("link").rlike(ACTIONS)
    return rows.filter(fine).select(id_col, "link").distinct()


def links_from(html: Column, base: Column) -> Column:
    """The documents of the same origin that a page links to, in the order of the page, each once."""
    hrefs = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"']+)[\"']"), F.lit(1)))
    found = F.filter(F.transform(F.transform(hrefs, unescape), lambda h: resolved(h, base)), lambda u: u.isNotNull())
    return F.array_distinct(F.filter(found, lambda u: (origin(u) == origin(base)) & ~path(u).rlike(SKIP_EXTENSIONS) & ~u.rlike(ACTIONS)))


def robots_rules(robots: DataFrame, site_col: str = "site", body_col: str = "body", agent: str = "*") -> DataFrame:
    """(site, prefix): paths that robots files disallow for all agents, or for ``agent``; a prefix ends at its first ``*``."""
    lines = robots.select(site_col, F.posexplode(F.split(F.col(body_col), r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    field, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    from pyspark.sql import Window

    named = lines.withColumn("_for", F.when(field == "user-agent", F.lower(value).isin("*", agent.lower())))
    applies = F.last("_for", ignorenulls=True).over(Window.partitionBy(site_col).orderBy("at"))
    prefix = F.regexp_extract(value, r"^[^*]*", 0)
    return named.withColumn("_on", applies).filter(F.col("_on") & (field == "disallow") & (prefix != "")).select(site_col, prefix.alias("prefix")).distinct()


def allowed(links: DataFrame, rules: DataFrame, site_col: str = "site", link_col: str = "link") -> DataFrame:
    """Links that no rule of their site disallows. The prefixes of a site are few, so they meet its links as one array."""
    lists = rules.groupBy(site_col).agg(F.collect_set("prefix").alias("_no"))
    target = F.concat(path(F.col(link_col)), F.when(query(F.col(link_col)) == "", "").otherwise(F.concat(F.lit("?"), query(F.col(link_col)))))
    rows = links.join(lists, site_col, "left").withColumn("_target", target)
    return rows.filter(~F.exists(F.coalesce("_no", F.array().cast("array<string>")), lambda p: F.col("_target").startswith(p))).drop("_no", "_target")


def sitemap_entries(sitemaps: DataFrame, site_col: str = "site", body_col: str = "body") -> DataFrame:
    """(site, loc, lastmod) of the ``url`` elements of sitemaps; lastmod is a date, null if there is none."""
    urls = F.regexp_extract_all(F.col(body_col), F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))
    rows = sitemaps.select(site_col, F.explode(urls).alias("_u"))
    loc = F.trim(F.regexp_extract("_u", r"(?is)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>", 1))
    day = F.regexp_extract("_u", r"(?is)<lastmod>\s*(\d{4}-\d{2}-\d{2})", 1)
    return rows.select(site_col, loc.alias("loc"), F.try_to_timestamp(F.when(day != "", day)).cast("date").alias("lastmod")).filter("loc <> ''")


def crawl_depth(pages: DataFrame, links: DataFrame, entries: DataFrame, folder: Folder) -> DataFrame:
    """(site, key, depth) of the pages that are reached from each site's entry page by links, nearest first.

    pages: (site, key); links: (site, source, target); entries: (site, key). A round joins the last round's pages with the
    links and drops what an earlier round has reached. Each round's pages are a table of their own, so a round writes only
    what is new; it ends when no page is. The number of rounds is the greatest depth.
    """
    known = pages.select("site", "key").distinct()
    steps = links.select("site", "source", F.col("target").alias("key")).filter("source is not null and source <> key").join(known, ["site", "key"], "left_semi").distinct()
    steps = folder.write(steps, "steps")
    seen = frontier = folder.write(entries.select("site", "key").distinct().join(known, ["site", "key"], "left_semi").withColumn("depth", F.lit(0)), "depth")
    depth = 0
    while n := frontier.count():
        depth += 1
        near = frontier.select("site", F.col("key").alias("source"))
        step = steps.join(F.broadcast(near) if n <= BROADCAST_ROWS else near, ["site", "source"]).select("site", "key").distinct()
        frontier = folder.write(step.join(seen.select("site", "key"), ["site", "key"], "left_anti").withColumn("depth", F.lit(depth)), "depth")
        seen = seen.unionByName(frontier)
    return seen

"""Site crawls over a table of documents: robots files, sitemaps and links, breadth first, under a budget for each site.

All sites are walked at once, a level at a time. A level joins the addresses that its sites reach next with the documents,
drops what a site has seen before, and takes documents in the order of the site's queue until its budget is spent. What a
site can hold is bounded by its budget and by the size of the documents that it takes, never by the number of its pages, so
a hot site costs no more than others; documents are found by joins on (site, address).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import links as L
from .tables import BROADCAST_ROWS, Folder

# Budgets of a crawl, sizes in bytes.
MAX_PAGES, MAX_SITEMAPS = 50, 3
MAX_PAGE_BYTES, MAX_SITEMAP_BYTES, MAX_ROBOTS_BYTES = 524_288, 524_288, 65_536
#: What a robots file may call this crawler.
AGENT = "evidentia"


def bare(url: Column) -> Column:
    """An address without its fragment."""
    return F.regexp_replace(url, "(?s)#.*$", "")


def documents(rows: DataFrame, url_col: str = "url", body_col: str = "body", status_col: str = "status", type_col: str = "content_type") -> DataFrame:
    """(site, url, status, content_type, body): one document for each address, of several the one with the smallest body; site is its origin.

    Rows without an origin can't be fetched and are left out. A null status is 200, a null type or body is empty.
    """
    c = F.col
    told = rows.select(bare(c(url_col)).alias("url"), F.coalesce(c(status_col), F.lit(200)).cast("int").alias("status"), F.coalesce(c(type_col), F.lit("")).alias("content_type"), F.coalesce(c(body_col), F.lit("")).alias("body"))
    told = told.withColumn("site", L.origin(c("url"))).filter("site <> ''")
    return told.groupBy("site", "url").agg(F.min(F.struct("status", "content_type", "body")).alias("d")).select("site", "url", "d.*")


def is_page(status: Column, content_type: Column, body: Column) -> Column:
    """Whether a fetched document is a page worth reading: no error, not empty, and HTML by its type or its text."""
    return (status < 400) & (body != "") & (F.lower(content_type).contains("html") | body.rlike("(?i)<html|<!doctype"))


def _text(size: int) -> Column:
    """The first bytes of a document, as a fetch with that limit reads them."""
    body = F.col("body")
    return F.when(F.octet_length(body) > size, F.decode(F.substring(F.encode(body, "utf-8"), 1, size), "utf-8")).otherwise(body)


def robots(docs: DataFrame, agent: str = AGENT) -> DataFrame:
    """(site, disallowed, sitemaps) of each site that has a robots file: path prefixes for all agents and for ``agent``, and sitemap addresses in order.

    A group of rules begins at a line that names an agent. A prefix ends at its first ``*`` (leading ones are left out).
    Sitemap lines count in every group.
    """
    own = docs.filter((F.col("url") == F.concat("site", F.lit("/robots.txt"))) & (F.col("status") == 200) & (F.col("body") != ""))
    text = F.regexp_replace(F.concat(F.lit("\n"), _text(MAX_ROBOTS_BYTES)), r"(?m)#.*$", "")
    groups = F.slice(F.split(text, r"(?i)\n\s*user-agent\s*:[ \t]*(?=\S)"), 2, 1_000_000)
    name = lambda g: F.lower(F.trim(F.regexp_extract(g, r"^[^\n]*", 0)))
    mine = F.filter(groups, lambda g: (F.regexp_replace(name(g), r"\s+$", "") == "*") | name(g).contains(agent.lower()))
    paths = F.flatten(F.transform(mine, lambda g: F.regexp_extract_all(g, F.lit(r"(?im)^[ \t]*disallow[ \t]*:[ \t]*\**([^*\s][^*\r\n]*)"), F.lit(1))))
    paths = F.filter(F.array_distinct(F.transform(paths, lambda p: F.regexp_replace(p, r"\s+$", ""))), lambda p: (p != "") & (p != "0"))
    return own.select("site", paths.alias("disallowed"), F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1)).alias("sitemaps"))


def barred(url: Column, disallowed: Column) -> Column:
    """Whether a prefix of the robots file matches the path and query of an address."""
    asked = F.concat(L.path(url), F.when(L.query(url) == "", "").otherwise(F.concat(F.lit("?"), L.query(url))))
    # the address is an element of the array itself, so that it is worked out once and not for every prefix
    tried = F.transform(disallowed, lambda p: F.struct(p.alias("p")))
    pairs = F.zip_with(tried, F.array_repeat(asked, F.size(disallowed)), lambda p, a: a.startswith(p["p"]))
    return F.coalesce(F.exists(pairs, lambda x: x), F.lit(False))


def walk(starts: DataFrame, nodes: DataFrame, budget: int, folder: Folder, key=lambda url: url, same_site: bool = False, met: DataFrame | None = None) -> DataFrame:
    """(site, place, depth, url, fate): what each site's queue came to before its budget was spent, in order.

    starts: (site, pos, url, disallowed), the queue that a site begins with and its path prefixes; nodes: (site, url, fine, children), the documents and the
    addresses that they lead to, in order. An address whose key the site has met before is passed over. fate is ``taken`` (a
    document that is fine; it uses up one of ``budget``, and its children join the queue), ``missing`` (no document or not
    fine) or ``barred`` (by a prefix). place counts taken documents from 0, null for others. same_site passes over addresses
    of other origins; met: (site, key) of what a site has met before.
    """
    spark = starts.sparkSession
    rules = folder.write(starts.select("site", "disallowed").dropDuplicates(["site"]), "rules")
    queue = starts.select("site", F.array(F.lit(0), F.col("pos")).alias("at"), "url")
    done, seen = None, met
    depth = 0
    spent = rules.select("site", F.lit(0).alias("used"))
    while True:
        if same_site:
            queue = queue.filter(L.origin(F.col("url")) == F.col("site"))
        fresh = queue.withColumn("key", key(F.col("url"))).groupBy("site", "key").agg(F.min(F.struct("at", "url")).alias("q")).select("site", "key", "q.*")
        if seen is not None:
            fresh = fresh.join(seen, ["site", "key"], "left_anti")
        fresh = folder.write(fresh, "fresh")
        asked = fresh.count()
        if not asked:
            break
        near = F.broadcast(fresh) if asked <= BROADCAST_ROWS else fresh
        there = nodes.join(near.select("site", "url"), ["site", "url"], "left_semi").select("site", "url", "fine")
        told = fresh.join(there, ["site", "url"], "left").join(spent, "site").join(rules, "site", "left")
        fate = F.when(barred(F.col("url"), F.coalesce("disallowed", F.array().cast("array<string>"))), "barred").when(F.coalesce("fine", F.lit(False)), "taken").otherwise("missing")
        before = Window.partitionBy("site").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one level of one site
        told = told.withColumn("fate", fate).withColumn("_n", F.col("used") + F.coalesce(F.count_if(F.col("fate") == "taken").over(before), F.lit(0)))
        level = told.filter(F.col("_n") < budget).select("site", F.when(F.col("fate") == "taken", F.col("_n")).cast("int").alias("place"), F.lit(depth).alias("depth"), "at", "url", "key", "fate")
        level = folder.write(level, "level")
        done = level if done is None else done.unionByName(level)
        seen = level.select("site", "key") if seen is None else seen.unionByName(level.select("site", "key"))
        spent = rules.join(done.filter("fate = 'taken'").groupBy("site").agg(F.count("*").alias("n")), "site", "left").select("site", F.coalesce("n", F.lit(0)).cast("int").alias("used"))
        onward = level.filter("fate = 'taken'").select("site", "url", "place").join(spent.filter(F.col("used") < budget), "site").select("site", "url", "place")
        onward = F.broadcast(onward) if asked <= BROADCAST_ROWS else onward
        queue = nodes.join(onward, ["site", "url"]).select("site", "place", F.posexplode("children").alias("pos", "url")).select("site", F.array("place", "pos").alias("at"), "url")
        depth += 1
    if done is None:
        return spark.createDataFrame([], f"site {starts.schema['site'].dataType.simpleString()}, place int, depth int, url string, fate string")
    return done.select("site", "place", "depth", "url", "fate")


def _locs(body: Column, pattern: str) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))


def sitemaps(docs: DataFrame, known: DataFrame, folder: Folder, budget: int = MAX_SITEMAPS) -> DataFrame:
    """(site, place, entries): the sitemap documents that are read for each site, in order, with (loc, lastmod) of their pages.

    known: (site, sitemaps), the sites to read and the addresses that their robots files name; without any it is /sitemap.xml.
    An index leads to further documents; documents that are missing, of another origin or met before don't count. Each site
    reads at most ``budget`` documents, indexes included, so cycles end.
    """
    from ..functions.text import unescape

    text = _text(MAX_SITEMAP_BYTES)
    is_index = text.rlike("(?i)<sitemapindex")
    children = F.transform(_locs(text, r"(?is)<sitemap\b[^>]*>.*?<loc>\s*([^<\s]+)\s*</loc>"), unescape)
    nodes = docs.select("site", "url", ((F.col("status") == 200) & (F.col("body") != "")).alias("fine"), F.when(is_index, children).otherwise(F.array().cast("array<string>")).alias("children"), "body")
    first = F.when(F.size("sitemaps") > 0, F.col("sitemaps")).otherwise(F.array(F.concat("site", F.lit("/sitemap.xml"))))
    starts = known.select("site", F.array().cast("array<string>").alias("disallowed"), F.posexplode(first).alias("pos", "url"))
    read = walk(starts, nodes.drop("body"), budget, folder, same_site=True).filter("fate = 'taken'").select("site", "place", "url")
    found = docs.join(read, ["site", "url"]).filter(~is_index)
    entries = F.filter(_locs(text, r"(?is)<url\b[^>]*>(.*?)</url>"), lambda e: e.rlike(r"(?i)<loc>\s*[^<\s]+\s*</loc>"))
    told = F.transform(entries, lambda e: F.struct(unescape(F.regexp_extract(e, r"(?i)<loc>\s*([^<\s]+)\s*</loc>", 1)).alias("loc"), F.regexp_extract(e, r"(?i)<lastmod>\s*(\d{4}-\d{2}-\d{2})", 1).alias("lastmod")))
    return found.select("site", "place", told.alias("entries"))


def sitemap_dates(read: DataFrame) -> DataFrame:
    """(site, loc, lastmod) of what sitemaps() has read; lastmod is null without one or if it is no date."""
    day = F.try_to_timestamp(F.when(F.col("e.lastmod") != "", F.col("e.lastmod"))).cast("date")
    return read.select("site", F.explode("entries").alias("e")).select("site", "e.loc", day.alias("lastmod"))


def crawl(docs: DataFrame, entries: DataFrame, folder: Folder, budget: int = MAX_PAGES, agent: str = AGENT) -> tuple[DataFrame, DataFrame]:
    """(site, place, depth, url, fate) of the addresses that each site's crawl met, and the sitemap documents that it read.

    docs: documents(); entries: (site, url), the page that a site's crawl begins with. An entry that is no page gives no
    crawl. Links of the entry come first, then what sitemaps list, then links of inner pages as they are read. One page may
    be spelled in several ways (links.canonical); robots rules don't hold for the entry.
    """
    fine = is_page(F.col("status"), F.col("content_type"), _text(MAX_PAGE_BYTES))
    pages = folder.write(docs.filter(fine).select("site", "url", F.lit(True).alias("fine"), L.links_from(_text(MAX_PAGE_BYTES), F.col("url")).alias("children")), "pages")
    first = folder.write(entries.select("site", F.coalesce(bare(F.col("url")), F.lit("")).alias("url")).groupBy("site").agg(F.min("url").alias("url")).join(pages.select("site", "url"), ["site", "url"], "left_semi"), "entries")
    told = first.select("site").join(robots(docs, agent), "site", "left")
    nothing = F.array().cast("array<string>")
    rules = folder.write(told.select("site", F.coalesce("disallowed", nothing).alias("disallowed"), F.coalesce("sitemaps", nothing).alias("sitemaps")), "robots")
    maps = folder.write(sitemaps(docs, rules.select("site", "sitemaps"), folder), "sitemaps")
    order = F.array_sort(F.collect_list(F.struct("place", F.transform("entries", lambda e: bare(e["loc"])).alias("locs"))))  # three documents at most
    listed = maps.groupBy("site").agg(order.alias("m")).select("site", F.flatten(F.transform("m", lambda x: x["locs"])).alias("locs"))
    listed = listed.select("site", F.posexplode(F.array_distinct("locs")).alias("pos", "url"))
    listed = listed.filter((L.origin(F.col("url")) == F.col("site")) & ~L.path(F.col("url")).rlike(L.SKIP_EXTENSIONS))
    linked = pages.join(first, ["site", "url"]).select("site", F.posexplode("children").alias("pos", "url"))
    queue = linked.unionByName(listed.withColumn("pos", F.col("pos") + 1_000_000_000))
    starts = queue.join(rules.select("site", "disallowed"), "site")
    inner = walk(starts, pages, budget - 1, folder, key=L.canonical, met=first.select("site", L.canonical(F.col("url")).alias("key"))) if budget > 1 else None
    entry = first.select("site", F.lit(0).alias("place"), F.lit(0).alias("depth"), "url", F.lit("taken").alias("fate"))
    if inner is None:
        return entry, maps
    return entry.unionByName(inner.select("site", (F.col("place") + 1).alias("place"), (F.col("depth") + 1).alias("depth"), "url", "fate")), maps


def notes(met: DataFrame, maps: DataFrame) -> DataFrame:
    """(site, pages, skipped, listed, notes): how many pages a crawl took, how many robots rules kept it from, how many a sitemap lists, and what the report says of it."""
    counts = met.groupBy("site").agg(F.count_if(F.col("fate") == "taken").alias("pages"), F.count_if(F.col("fate") == "barred").alias("skipped"))
    listed = maps.groupBy("site").agg(F.sum(F.size("entries")).alias("listed"))
    rows = counts.join(listed, "site", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    n = lambda c: F.col(c).cast("string")
    s = lambda c, one, many: F.when(F.col(c) == 1, one).otherwise(many)
    said = [
        F.when(F.col("listed") > 0, F.concat(F.lit("The site publishes a sitemap listing "), n("listed"), s("listed", " page", " pages"), F.lit(", which was used to find pages the navigation does not link to."))),
        F.when(F.col("skipped") > 0, F.concat(n("skipped"), s("skipped", " page", " pages"), F.lit(" skipped because robots.txt asks crawlers not to read "), s("skipped", "it", "them"), F.lit("."))),
        F.when(F.col("pages") == 1, F.lit("Only one page could be read, so the site-wide checks had nothing to compare. This is the same reading the single-page mode would give.")),
    ]
    return rows.withColumn("notes", F.filter(F.array(*said), lambda x: x.isNotNull()))

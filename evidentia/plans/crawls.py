"""Queries over crawls of sites that are made of the pages table: index pages, robots files and nested sitemaps lead to the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl as C
from ..operators import links as L
from ..operators.tables import Folder, result

# Test values: what of each site's documents is broken, and what its robots file says.
BROKEN = [(13, 5, 404, "text/html"), (17, 3, 200, "application/pdf"), (19, 4, 503, "text/html")]
RULES = "User-agent: *\nDisallow: /en/1 # no\nDisallow: /de/*x\n\nuser-agent: other\nDisallow: /\n"
OWN_RULES = "User-agent: Evidentia-bot/1.0\nDisallow: /fr/1\n"


def _escaped(url):
    return F.replace(url, F.lit("&"), F.lit("&amp;"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", C.bare(F.col("url")).alias("url"), "html")
    return rows.withColumn("site", L.origin(F.col("url"))).filter("site <> ''")


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, content_type, body): every page, and for each site index pages that lead to them digit by digit of their ids, a robots file and sitemaps.

    An index page has ten children, a sitemap ten pages; nothing that belongs to a whole site is gathered in one row.
    """
    p = _rows(spark, sf_dir)
    digits = p.agg(F.length(F.max("page_id").cast("string"))).first()[0] or 1
    status, kind = F.lit(200), F.lit("text/html; charset=utf-8")
    for k, r, code, given in BROKEN:
        status, kind = F.when(F.col("page_id") % k == r, code).otherwise(status), F.when(F.col("page_id") % k == r, given).otherwise(kind)
    own = p.select("url", status.alias("status"), kind.alias("content_type"), F.when(kind == "application/pdf", "%PDF").otherwise(F.col("html")).alias("body"))
    whole = lambda k: F.floor(F.col("page_id") / 10**k)
    name = lambda k: F.concat(F.col("site"), F.lit(f"/index/{k}/"), whole(k).cast("string")) if k < digits else F.concat(F.col("site"), F.lit("/"))
    steps = [F.struct(name(k).alias("up"), whole(k - 1).alias("n"), (name(k - 1) if k > 1 else F.col("url")).alias("child")) for k in range(1, digits + 1)]
    steps = p.select("site", F.explode(F.array(*steps)).alias("s")).groupBy("site", "s.up").agg(F.array_sort(F.collect_set(F.struct("s.n", "s.child"))).alias("c"))
    anchors = F.array_join(F.transform("c", lambda x: F.concat(F.lit('<a href="'), _escaped(x["child"]), F.lit('">x</a>'))), "")
    home = F.concat(F.lit('<a href="/index.html">home</a><A class="top" HREF=\''), "site", F.lit("/#top'>top</A><a href=\"mailto:a@b\">m</a><a href=\"/logo.png\">l</a>"))
    made = lambda url, kind, body, code=200: [url.alias("url"), (F.lit(code) if isinstance(code, int) else code).alias("status"), F.lit(kind).alias("content_type"), body.alias("body")]
    index = steps.select(*made(F.col("up"), "text/html", F.concat(F.lit("<html><body>"), home, anchors, F.lit("</body></html>"))))
    ends = p.groupBy("site").agg(F.floor(F.min("page_id") / 10).alias("lo"), F.floor(F.max("page_id") / 10).alias("hi"))
    at = lambda x: F.concat(F.col("site"), F.lit("/maps/"), F.col(x).cast("string"), F.lit(".xml"))
    line = lambda x: F.concat(F.lit("Sitemap: "), x, F.lit("\n"))
    site = F.col("site")
    named = F.concat(line(at("lo")), line(F.concat(site, F.lit("/maps/none.xml"))), F.lit("sitemap: https://elsewhere.example/x.xml # theirs\n"), line(at("hi")), line(at("lo")), F.lit(OWN_RULES))
    robots = ends.select(*made(F.concat(site, F.lit("/robots.txt")), "text/plain", F.concat(F.lit(RULES), F.when(F.length(site) % 2 == 0, named).otherwise("")), F.when(F.length(site) % 5 == 4, 404).otherwise(200)))
    loc = lambda x: F.concat(F.lit("<sitemap>\n <loc> "), x, F.lit(" </loc></sitemap>"))
    listing = lambda *x: F.concat(F.lit('<?xml version="1.0"?><sitemapindex>'), *x, F.lit("</sitemapindex>"))
    root = ends.select(*made(F.concat(site, F.lit("/sitemap.xml")), "application/xml", listing(*[loc(F.concat(site, F.lit(x))) for x in ("/sitemap.xml", "/maps/none.xml", "/maps/nested.xml")])))
    nested = ends.select(*made(F.concat(site, F.lit("/maps/nested.xml")), "application/xml", listing(loc(F.concat(site, F.lit("/sitemap.xml"))), loc(at("lo")), loc(at("hi")))))
    day = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<lastmod>"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).cast("string"), F.lit("T00:00:00Z</lastmod>"))).otherwise("")
    item = F.concat(F.lit("<url><loc>"), _escaped(F.col("url")), F.lit("</loc>"), day, F.lit("</url>"))
    maps = p.groupBy("site", F.floor(F.col("page_id") / 10).alias("lo")).agg(F.array_sort(F.collect_set(F.struct("page_id", item.alias("item")))).alias("c"))
    others = F.concat(F.lit("<url><loc>https://elsewhere.example/y</loc></url><url><loc>"), site, F.lit("/z.png</loc></url><url>none</url></urlset>"))
    maps = maps.select(*made(at("lo"), "application/xml", F.concat(F.lit("<urlset>"), F.array_join(F.transform("c", lambda x: x["item"]), ""), others)))
    return own.unionByName(index).unionByName(robots).unionByName(root).unionByName(nested).unionByName(maps)


def _crawled(spark: SparkSession, sf_dir: str, folder: Folder) -> tuple[DataFrame, DataFrame]:
    docs = folder.write(C.documents(site_documents(spark, sf_dir)), "documents")
    entries = _rows(spark, sf_dir).select("site", F.concat("site", F.lit("/")).alias("url")).distinct()
    return C.crawl(docs, entries, folder)


def site_crawl(spark, sf_dir):
    """What each site's crawl met: at most 50 pages, in the order of its queue."""
    return result(spark, "crawl", lambda folder: _crawled(spark, sf_dir, folder)[0])


def site_crawl_notes(spark, sf_dir):
    """How far each site's crawl came, and what its report says of it."""
    return result(spark, "crawl", lambda folder: C.notes(*_crawled(spark, sf_dir, folder))).withColumn("notes", F.array_join("notes", " "))


def site_robots(spark, sf_dir):
    """Rules and sitemap addresses of each site's robots file."""
    found = C.robots(C.documents(site_documents(spark, sf_dir)))
    return found.select("site", F.array_join("disallowed", " ").alias("disallowed"), F.array_join("sitemaps", " ").alias("sitemaps"))


def site_sitemaps(spark, sf_dir):
    """Pages and dates of the sitemaps that are read for each site: nested ones, cycles and missing ones included, three documents at most."""

    def read(folder):
        docs = folder.write(C.documents(site_documents(spark, sf_dir)), "documents")
        known = docs.select("site").distinct().join(C.robots(docs), "site", "left").select("site", F.coalesce("sitemaps", F.array().cast("array<string>")).alias("sitemaps"))
        return C.sitemap_dates(C.sitemaps(docs, known, folder))

    return result(spark, "sitemaps", read)


def link_depth_bfs(spark, sf_dir):
    """Steps from each site's root to what its pages and index pages lead to, without a budget."""

    def walked(folder):
        docs = folder.write(C.documents(site_documents(spark, sf_dir)), "documents")
        pages = docs.filter(C.is_page(F.col("status"), F.col("content_type"), F.col("body")))
        linked = pages.select("site", F.col("url").alias("source"), F.explode(L.links_from(F.col("body"), F.col("url"))).alias("target"))
        entries = pages.filter(F.col("url") == F.concat("site", F.lit("/"))).select("site", F.col("url").alias("key"))
        return L.crawl_depth(pages.select("site", F.col("url").alias("key")), linked, entries, folder)

    return result(spark, "depth", walked)


QUERIES = {f.__name__: f for f in (site_crawl, site_crawl_notes, site_robots, site_sitemaps, link_depth_bfs)}

_ORIGIN = "lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"
_BARE = "regexp_replace({0}, '(?s)#.*$', '')"
_PATH = "CASE WHEN regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_ASKED = "({0} || CASE WHEN strpos(url, '?') > 0 THEN '?' || regexp_extract(url, '\\?([^#]+)', 1) ELSE '' END)".format(_PATH.format("url"))
_KEY = (
    "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) || coalesce(nullif(regexp_replace(regexp_replace(" + _PATH + ", '(?i)/(?:index|default)\\.(?:html?|php|aspx?)$', '/'), '/+$', ''), ''), '/')"
    " || CASE WHEN regexp_extract({0}, '\\?([^#]+)', 1) = '' THEN '' ELSE '?' || regexp_extract({0}, '\\?([^#]+)', 1) END"
)
_BROKEN = "CASE " + " ".join(f"WHEN page_id % {k} = {r} THEN {{{i}}}" for i, (k, r, _, _) in reversed(list(enumerate(BROKEN))))
_SITES = f"""p AS (SELECT page_id, {_BARE.format('url')} AS url, {_ORIGIN.format('url')} AS site, html FROM pages WHERE {_ORIGIN.format('url')} <> ''),
ends AS (SELECT site, min(page_id) // 10 AS lo, max(page_id) // 10 AS hi, length(site) % 5 <> 4 AS told, length(site) % 2 = 0 AS own FROM p GROUP BY site)"""
_DOCS = f"""{_SITES}, top AS (SELECT length(max(page_id)::VARCHAR) AS digits FROM p),
steps AS (SELECT DISTINCT site, k, page_id // (10 ** k)::BIGINT AS up, page_id // (10 ** (k - 1))::BIGINT AS n,
    CASE WHEN k = 1 THEN url ELSE site || '/index/' || (k - 1) || '/' || (page_id // (10 ** (k - 1))::BIGINT) END AS child FROM p, top, range(1, digits + 1) r(k)),
nodes AS (SELECT site, CASE WHEN k = digits THEN site || '/' ELSE site || '/index/' || k || '/' || up END AS url, list(child ORDER BY n, child) AS c FROM steps, top GROUP BY ALL),
d AS (
    SELECT site, url, {_BROKEN.format(*[b[2] for b in BROKEN])} ELSE 200 END AS status, {_BROKEN.format(*[f"'{b[3]}'" for b in BROKEN])} ELSE 'text/html; charset=utf-8' END AS kind,
        coalesce({_BROKEN.format("html", "'%PDF'", "html")} ELSE html END, '') AS body FROM p
    UNION ALL SELECT site, url, 200, 'text/html', '<html><body><a href="/index.html">home</a><A class="top" HREF=''' || site || '/#top''>top</A><a href="mailto:a@b">m</a><a href="/logo.png">l</a>'
        || array_to_string(list_transform(c, lambda x: '<a href="' || replace(x, '&', '&amp;') || '">x</a>'), '') || '</body></html>' FROM nodes
), docs AS (SELECT site, url, min({{'a': status, 'b': kind, 'c': body}}) AS m FROM d GROUP BY ALL),
good AS (SELECT site, url, m.c AS body FROM docs WHERE m.a < 400 AND m.c <> '' AND (contains(lower(m.b), 'html') OR regexp_matches(m.c, '(?i)<html|<!doctype'))),
hrefs AS (SELECT site, url, unnest(regexp_extract_all(body, '(?i)<a\\b[^>]*\\bhref=["'']([^"'']+)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(body, '(?i)<a\\b[^>]*\\bhref=["'']([^"'']+)["'']', 1), 1) AS pos FROM good),
named AS (SELECT site, url, pos, replace(href, '&amp;', '&') AS href FROM hrefs WHERE NOT starts_with(href, '#') AND NOT regexp_matches(href, '{L.NO_LINK}')),
whole AS (SELECT site, url, pos, {_BARE.format(f"CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN split_part(url, '://', 1) || ':' || href ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href END")} AS target FROM named),
links AS (SELECT site, url, target, min(pos) AS pos FROM whole WHERE {_ORIGIN.format('target')} = site AND NOT regexp_matches({_PATH.format('target')}, '{L.SKIP_EXTENSIONS}') AND NOT regexp_matches(target, '{L.ACTIONS}') GROUP BY ALL)"""
_MAPS = f"""listed AS (
    SELECT site, page_id, url, 0 AS kind, page_id // 10 AS map FROM p UNION ALL SELECT site, NULL, 'https://elsewhere.example/y', 1, map FROM (SELECT DISTINCT site, page_id // 10 AS map FROM p)
    UNION ALL SELECT site, NULL, site || '/z.png', 2, map FROM (SELECT DISTINCT site, page_id // 10 AS map FROM p)
), chosen AS (SELECT site, lo AS map, 0 AS place FROM ends UNION ALL SELECT site, hi, 1 FROM ends WHERE told AND own AND hi <> lo),
entries AS (SELECT DISTINCT site, place, kind, page_id, url AS loc, CASE WHEN page_id % 3 <> 0 THEN (DATE '2024-01-01' + (page_id % 90)::INT)::DATE END AS lastmod FROM chosen JOIN listed USING (site, map))"""
_CRAWL = f"""{_DOCS}, {_MAPS},
more AS (SELECT site, site || '/' AS url, loc AS target, 1000000000 + row_number() OVER (PARTITION BY site ORDER BY place, kind, page_id) AS pos FROM entries WHERE {_ORIGIN.format('loc')} = site AND NOT regexp_matches({_PATH.format('loc')}, '{L.SKIP_EXTENSIONS}')),
onward AS MATERIALIZED (SELECT site, url AS source, target, pos, {_KEY.format('target')} AS key FROM (SELECT site, url, target, pos FROM links UNION ALL SELECT site, url, target, pos FROM more)),
judged AS MATERIALIZED (SELECT url, site, CASE WHEN told AND (starts_with({_ASKED}, '/en/1') OR starts_with({_ASKED}, '/de/') OR (own AND starts_with({_ASKED}, '/fr/1'))) THEN 'barred' WHEN url IN (SELECT url FROM good) THEN 'taken' ELSE 'missing' END AS fate
    FROM (SELECT DISTINCT site, target AS url FROM onward) JOIN ends USING (site)),
walked(site, key, url, depth, way, fate) USING KEY (site, key) AS (
    SELECT site, {_KEY.format("(site || '/')")}, site || '/', 0, [0::BIGINT], 'taken' FROM good WHERE url = site || '/'
    UNION
    SELECT site, key, target, depth, way, fate FROM (
        SELECT o.site, o.key, o.target, w.depth + 1 AS depth, list_append(w.way, o.pos) AS way, j.fate, row_number() OVER (PARTITION BY o.site, o.key ORDER BY list_append(w.way, o.pos)) AS rn
        FROM walked w JOIN onward o ON o.site = w.site AND o.source = w.url JOIN judged j ON j.site = o.site AND j.url = o.target
            LEFT JOIN recurring.walked r ON r.site = o.site AND r.key = o.key WHERE w.fate = 'taken' AND r.key IS NULL
    ) WHERE rn = 1
), numbered AS (SELECT *, coalesce(count(*) FILTER (fate = 'taken') OVER (PARTITION BY site ORDER BY depth, way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM walked),
met AS (SELECT site, CASE WHEN fate = 'taken' THEN n END::INT AS place, depth::INT AS depth, url, fate FROM numbered WHERE n < {C.MAX_PAGES})"""

SQL = {
    "site_crawl": f"WITH RECURSIVE {_CRAWL} SELECT * FROM met",
    "site_crawl_notes": f"""WITH RECURSIVE {_CRAWL}, c AS (SELECT site, count(*) FILTER (fate = 'taken') AS pages, count(*) FILTER (fate = 'barred') AS skipped FROM met GROUP BY 1),
l AS (SELECT site, count(*)::BIGINT AS listed FROM entries GROUP BY 1), j AS (SELECT site, pages, skipped, coalesce(listed, 0)::BIGINT AS listed FROM c LEFT JOIN l USING (site))
SELECT *, concat_ws(' ', CASE WHEN listed > 0 THEN 'The site publishes a sitemap listing ' || listed || ' page' || CASE WHEN listed = 1 THEN '' ELSE 's' END || ', which was used to find pages the navigation does not link to.' END,
    CASE WHEN skipped > 0 THEN skipped || ' page' || CASE WHEN skipped = 1 THEN '' ELSE 's' END || ' skipped because robots.txt asks crawlers not to read ' || CASE WHEN skipped = 1 THEN 'it.' ELSE 'them.' END END,
    CASE WHEN pages = 1 THEN 'Only one page could be read, so the site-wide checks had nothing to compare. This is the same reading the single-page mode would give.' END) AS notes FROM j""",
    "site_robots": f"""WITH {_SITES} SELECT site, '/en/1 /de/' || CASE WHEN own THEN ' /fr/1' ELSE '' END AS disallowed,
    CASE WHEN own THEN concat_ws(' ', site || '/maps/' || lo || '.xml', site || '/maps/none.xml', 'https://elsewhere.example/x.xml', site || '/maps/' || hi || '.xml', site || '/maps/' || lo || '.xml') ELSE '' END AS sitemaps FROM ends WHERE told""",
    "site_sitemaps": f"WITH {_SITES}, {_MAPS} SELECT site, loc, lastmod FROM entries",
    "link_depth_bfs": f"""WITH RECURSIVE {_DOCS}, reach(site, url, depth) AS (
    SELECT site, url, 0 FROM good WHERE url = site || '/' UNION SELECT l.site, l.target, r.depth + 1 FROM reach r JOIN links l ON l.url = r.url JOIN good g ON g.url = l.target WHERE r.depth < (SELECT digits + 1 FROM top) AND l.target <> r.url
) SELECT site, url AS key, min(depth)::INT AS depth FROM reach GROUP BY ALL""",
}

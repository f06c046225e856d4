"""Crawls, robots files, sitemaps and character references on small sites."""

import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from evidentia.functions.text import unescape, visible_text
from evidentia.operators import crawl as C
from evidentia.operators.tables import Folder

SITE = "https://shop.test"


def page(name, extra=""):
    links = "".join(f'<a href="{x}">x</a>' for x in ("/", "/about", "/pricing", "/contact", "/secret", "/about", "https://elsewhere.test/away", "#top", "mailto:a@b", "/logo.png", "/logout"))
    return f"<!DOCTYPE html><html><body>{links}<h1>{name}</h1>{extra}</body></html>"


def crawled(spark, sites, budget=50):
    """{site: [(place, depth, path, fate)]} and the notes by site; a site is a dict of path -> body, or (status, type, body)."""
    rows = [(site + path, *(body if isinstance(body, tuple) else (200, "text/html", body))) for site, docs in sites.items() for path, body in docs.items()]
    docs = C.documents(spark.createDataFrame(rows, "url string, status int, content_type string, body string"))
    entries = spark.createDataFrame([(s, s + "/") for s in sites], "site string, url string")
    folder = Folder(spark, "test")
    met, maps = C.crawl(docs, entries, folder, budget=budget, agent="evidentia")
    found = {s: [] for s in sites}
    for r in met.collect():
        found[r["site"]].append((r["place"], r["depth"], r["url"][len(r["site"]) :], r["fate"]))
    notes = {r["site"]: r for r in C.notes(met, maps).collect()}
    folder.drop()
    return found, notes


def taken(rows):
    return [r[2] for r in sorted(x for x in rows if x[3] == "taken")]


def test_a_crawl_reads_what_it_may_and_says_what_it_left_out(spark):
    shop = {"/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /secret\n"), **{p: page(p) for p in ("/", "/about", "/pricing", "/contact", "/secret")}}
    alone = {"/": "<html>no links</html>"}
    gone = {"/": (404, "text/html", page("x")), "/about": page("about")}
    found, notes = crawled(spark, {SITE: shop, "http://alone.test:8080": alone, "https://gone.test": gone})
    assert taken(found[SITE]) == ["/", "/about", "/pricing", "/contact"]
    assert [r[2] for r in found[SITE] if r[3] == "barred"] == ["/secret"]
    assert notes[SITE]["notes"] == ["1 page skipped because robots.txt asks crawlers not to read it."]
    assert taken(found["http://alone.test:8080"]) == ["/"] and "Only one page" in notes["http://alone.test:8080"]["notes"][0]
    assert found["https://gone.test"] == []


def test_budget_order_spellings_and_documents_that_are_no_pages(spark):
    site = {
        "/": '<html><a href="b.html?x=1&amp;y=2">b</a><a href="./a/">a</a><a href="a">again</a><a href="/index.html">home</a><a href="HTTPS://SHOP.test/a/index.php">a</a><a href="/no.html">n</a><a href="/pdf">p</a><a href="/empty">e</a>',
        "/b.html?x=1&y=2": '<html><a href="../../deep/1">1</a><a href="/a">a</a>',
        "/a": '<html><a href="../deep/2">2</a>', "/deep/1": "<!doctype html><a href='/deep/3'>", "/deep/2": "<html>", "/deep/3": "<html>",
        "/no.html": (500, "text/html", "<html>"), "/pdf": (200, "application/pdf", "%PDF"), "/empty": "",
    }
    found, _ = crawled(spark, {SITE: site})
    rows = found[SITE]
    assert taken(rows) == ["/", "/b.html?x=1&y=2", "/a", "/deep/1", "/deep/2", "/deep/3"]
    assert sorted(r[2] for r in rows if r[3] == "missing") == ["/empty", "/no.html", "/pdf"]
    assert {r[2]: r[1] for r in rows}["/deep/3"] == 3
    for budget in (1, 3, 4):
        found, _ = crawled(spark, {SITE: site}, budget=budget)
        assert taken(found[SITE]) == ["/", "/b.html?x=1&y=2", "/a", "/deep/1"][:budget]


def entry(path, day=None):
    return f"<url><loc>{SITE}{path}</loc>" + (f"<lastmod>{day}T10:00:00Z</lastmod>" if day else "") + "</url>"


def test_sitemaps_fill_in_what_links_do_not_reach(spark):
    inner = "<urlset>" + "".join(entry(p, "2026-01-04") for p in ("/", "/about", "/unlinked", "/x1", "/x2", "/x3")) + "</urlset>"
    listed = {"/robots.txt": f"User-agent: *\nSitemap: {SITE}/sitemap.xml\n", "/sitemap.xml": inner, "/": '<html><a href="/about">a</a>', "/about": '<html><a href="/last">l</a>', "/unlinked": "<html>", "/last": "<html>"}
    found, notes = crawled(spark, {SITE: listed})
    assert taken(found[SITE]) == ["/", "/about", "/unlinked", "/last"]  # links, then the sitemap, then links of inner pages
    assert notes[SITE]["listed"] == 6 and notes[SITE]["notes"][0].startswith("The site publishes a sitemap listing 6 pages,")


def test_nested_cyclic_and_missing_sitemaps(spark):
    at = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n if '//' in n else SITE + n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    urls = lambda *paths: "<urlset>" + "".join(map(entry, paths)) + "</urlset>"
    docs = {"/sitemap.xml": at("/sitemap.xml", "/none.xml", "https://elsewhere.test/s.xml", "/inner.xml", "/inner.xml"), "/inner.xml": at("/sitemap.xml", "/one.xml", "/two.xml"), "/one.xml": urls("/1?a=1&amp;b=2", "/2#f"), "/two.xml": urls("/3")}
    rows = [(SITE + p, 200, "application/xml", b) for p, b in docs.items()]
    table = C.documents(spark.createDataFrame(rows, "url string, status int, content_type string, body string"))
    for named, budget, expected in (([], 3, ["/1?a=1&b=2", "/2#f"]), ([], 9, ["/1?a=1&b=2", "/2#f", "/3"]), ([], 2, []), (["/none.xml", "/two.xml", "/two.xml", "/one.xml"], 3, ["/3", "/1?a=1&b=2", "/2#f"])):
        folder = Folder(spark, "test")
        read = C.sitemaps(table, spark.createDataFrame([(SITE, [SITE + n for n in named])], "site string, sitemaps array<string>"), folder, budget)
        assert [e["loc"][len(SITE) :] for r in sorted(read.collect(), key=lambda r: r["place"]) for e in r["entries"]] == expected
        folder.drop()


def test_robots_groups(spark):
    bodies = {
        "https://a.test": "# all\nUSER-AGENT : *\r\nDisallow: /x # why\nDisallow:\nDisallow: /p*q\nDisallow: *r\n\nUser-agent: Other\nDisallow: /no\nSitemap: https://a.test/1.xml\nUser-agent: Evidentia/2\n  disallow : /own\nSITEMAP:https://a.test/2.xml",
        "https://b.test": "Disallow: /early\nUser-agent:\nDisallow: /still\nUser-agent: *\nDisallow: /x\nDisallow: /x",
    }
    rows = [(s + "/robots.txt", 200, "text/plain", b) for s, b in bodies.items()] + [("https://c.test/robots.txt", 404, "text/plain", "User-agent: *\nDisallow: /"), ("https://d.test/robots.txt", None, None, None)]
    got = {r["site"]: r for r in C.robots(C.documents(spark.createDataFrame(rows, "url string, status int, content_type string, body string"))).collect()}
    assert set(got) == set(bodies)
    assert got["https://a.test"]["disallowed"] == ["/x", "/p", "r", "/own"] and got["https://a.test"]["sitemaps"] == ["https://a.test/1.xml", "https://a.test/2.xml"]
    assert got["https://b.test"]["disallowed"] == ["/x"]


def test_empty_tables(spark):
    docs = C.documents(spark.createDataFrame([(None, 200, "text/html", "x"), ("no origin", 200, "text/html", "x")], "url string, status int, content_type string, body string"))
    assert docs.count() == 0
    folder = Folder(spark, "test")
    met, maps = C.crawl(docs, spark.createDataFrame([], "site string, url string"), folder)
    assert met.count() == 0 and maps.count() == 0 and C.notes(met, maps).count() == 0


def test_character_references(spark):
    names = [f"a&{n}b &" for n in html5 if n.endswith(";")]
    codes = [9, 10, 32, 65, 126, 160, 233, 8364, 0x1F600, 0x10FFFD]
    numbers = [t for c in codes for t in (f"&#{c};", f"&#x{c:X};", f"&#X{c:08x};", f"&#000{c};")]
    texts = names + numbers + ["&nope; &amp;amp; & ; &; &amp", "plain", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescape(F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [html.unescape(t) if t != texts[-3] else "&nope; &amp; & ; &; &amp" for t in texts]
    # numbers that are no character of a document stay as they are
    odd = ["&#0;", "&#xD800;", "&#x81;", "&#xFFFF;", "&#x110000;", "&#99999999999999999999;", "&#11;"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(unescape(F.col("t"))).collect()] == odd
    assert spark.range(1).select(visible_text(F.lit("<p>caf&eacute;&nbsp;&emsp;&#233; &lt;b&gt;</p>"))).first()[0] == "café é <b>"
    assert spark.range(1).select(unescape(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("size", [12_000])
def test_many_references_take_linear_time(spark, size):
    text = "&eacute;&#233; x " * size
    assert spark.createDataFrame([(text,)], "t string").select(F.length(unescape(F.col("t")))).first()[0] == 5 * size

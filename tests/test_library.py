"""The library's operators on hand-made subjects."""

import hashlib
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from evidentia.functions import catalog, text
from evidentia.operators import assets, bundles, code, history, links, pages, scoring, sites, visits
from evidentia.operators.tables import Folder
from evidentia.sources import gitlog
from evidentia.streaming import daytable, limiter


def test_catalogue_is_consistent():
    ids = [s for s, *_ in catalog.SIGNALS]
    assert len(ids) == len(set(ids)) == 104 and len(catalog.CATEGORIES) == 9
    assert sum(d == "ai" for _, _, d, _ in catalog.SIGNALS) == 80
    counts = {c: sum(x == c for _, x, _, _ in catalog.SIGNALS) for c, _, _ in catalog.CATEGORIES}
    assert counts == {"fingerprint": 7, "history": 11, "sitewide": 8, "structure": 12, "code": 23, "content": 7, "security": 5, "aesthetic": 16, "provenance": 15}


def score(spark, signals, thin=False):
    hits = spark.createDataFrame([("s", x, i, ["e"]) for i, x in enumerate(signals)], "subject_id string, signal_id string, fire_seq int, evidence array<string>")
    return scoring.reports(hits, spark.createDataFrame([("s", thin)], "subject_id string, thin boolean")).first()


def test_scores(spark):
    assert score(spark, [])["score"] == 27 and score(spark, [], True)["score"] == 37
    r = score(spark, ["fp.lovable"])
    assert (r["score"], r["verdict"], r["confidence"]) == (97, "builder_identified", "high")
    assert score(spark, ["fp.replit"])["score"] == 96
    r = score(spark, [s for s, c, *_ in catalog.SIGNALS if c == "aesthetic"])
    assert (r["score"], r["converging"], r["verdict"]) == (50, 0, "inconclusive")
    r = score(spark, [s for s, c, d, _ in catalog.SIGNALS if d == "ai" and c in ("code", "structure", "content")])
    assert (r["score"], r["verdict"], r["confidence"]) == (92, "very_likely_ai", "moderate")
    assert score(spark, ["no.such", "hu.cms"])["human"] == 1


def test_first_firing_wins_and_evidence_is_clean(spark):
    hits = spark.createDataFrame([("s", "hu.cms", 2, ["late"]), ("s", "hu.cms", 1, ["  a \n b ", "a b", "", "x" * 200, "c", "d", "e"])], "subject_id string, signal_id string, fire_seq int, evidence array<string>")
    r = scoring.first_hits(hits).first()
    assert r["evidence"] == ["a b", "x" * 139 + "…", "c", "d"]
    order = score(spark, ["hu.cms", "fp.bolt", "ae.indigo", "fp.lovable"])["signals"]
    assert [s["id"] for s in order] == ["fp.bolt", "fp.lovable", "hu.cms", "ae.indigo"] and order[0]["strength"] == "decisive"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, "getUserName_byId-0", text.identifier_words) == 5
    assert one(spark, "don't split-words '' 'x", text.word_count) == 4
    assert one(spark, "<p>a&amp;b</p><script>x</script><b>c</b>", text.visible_text) == "a&b c"
    assert one(spark, "because of safari", text.looks_like_why) and one(spark, "since v1.2.3", text.looks_like_why) and not one(spark, "add two", text.looks_like_why)
    assert one(spark, "a → b", text.has_emoji) and one(spark, "🚀x🚀✅", text.find_emoji) == ["🚀", "✅"]
    assert one(spark, "le la les des vous nous pour avec est plus " * 10, text.declared_language) == "fr" and one(spark, "the and", text.declared_language) == ""
    assert one(spark, "def f(x):\n  pass\nimport os\nself.x", text.detect_code_language) == "python" and one(spark, "", text.detect_code_language) == "unknown"
    assert one(spark, "token=abcdefgh", text.redact) == "token=abcd…"


def fired_by(spark, src):
    f = code.features(spark.createDataFrame([("f", src)], "subject_id string, src string"))
    return {r["signal_id"] for r in code.fired(f).collect()}


def test_source_signals(spark):
    generated = "\n".join([
        "/**", " * This module handles everything and provides a robust implementation of all things.", " */", "// ==== Helpers ====", "// ---- Data ----", "// Sure, here's a function for it 🚀",
        "const apiUrl = 'https://api.example.com/v1';", "const password = 'changeme123';",
        "// Set the total", "const total = 1;", "// Create the user", "const user = total;", "// Return the result", "return result;",
        *[x for i in range(4) for x in ("/**", f" * Gets value {i}.", " */", f"function getThingNumber{i}(a) {{", "  return a;", "}")],
        "try {", "} catch (e) {}", "try {", "} catch (e) {}", "try {", "} catch (e) {}", "// TODO: implement this", "class AUtils {}", "class BManager {}", "class CHelper {}", "axios.get(); fetch(u); new Date(); moment(); dayjs;",
    ])
    got = fired_by(spark, generated)
    assert {"cd.section_header_comments", "cd.assistant_chatter", "cd.emoji_comments", "cd.placeholder_endpoint", "se.placeholder_secret", "cd.what_comments", "st.docblock_on_everything", "cd.swallowed_errors", "cd.todo_placeholders", "cd.helper_pileup", "st.multiple_solutions", "st.file_header_block"} <= got
    human = "\n".join(["# see #123, safari breaks otherwise", "# no idea why, sorry", "# x = old(1);", "# if y: pass", "cfgMap = 1", "ctxA = 2", "idxB = 3", *["\tfoo()", " bar()"] * 20])
    assert {"hu.why_comments", "hu.ticket_refs", "hu.informal", "hu.commented_code", "hu.inconsistent_format", "hu.abbrevs"} <= fired_by(spark, human)
    assert not fired_by(spark, "") and "cd.empty_tests" in fired_by(spark, "it('x', () => {\n a();\n});\nexpect(true).toBe(true)")
    assert "st.dead_code" in fired_by(spark, "import a1 from 'a'\nimport {b2, c3 as d4} from 'b'\nfunction unused() {}")


def test_block_comments(spark):
    rows = code.lines(code.sources(spark.createDataFrame([("f", "a /* x\n/* open\n\n in\n end */ b\ncode\n/* one */\ny # tail note\nz */\nq")], "subject_id string, src string"))).orderBy("ln").collect()
    assert [r["comment"] for r in rows] == [None, "/* open", None, "in", "end */ b", None, "/* one */", "# tail note", None, None]


def page_signals(spark, html, url="http://x.org/", headers=None):
    df = spark.createDataFrame([(1, url, html, headers or {})], "page_id long, url string, html string, headers map<string,string>")
    return {r["signal_id"] for r in pages.hits(pages.prepare(df), 2026).collect()}


def test_page_signals(spark):
    generated = (
        "<html lang='en'><head><title>Vite + React</title></head><body><!-- Hero --><!-- Features --><!-- Pricing --><script src='https://cdn.gpteng.co/x.js'></script>"
        + '<a href="#">x</a>' * 9 + '<div class="rounded-2xl shadow-lg p-6"></div>' * 3 + "<span class='bg-indigo-500 text-violet-600 from-purple-50'>x</span><style>a{color:#6366f1;backdrop-filter: blur(2px)}</style>"
        + "<p>Lorem ipsum. John Doe, Satisfied Customer. Supercharge and effortlessly ship faster. 500+ users, 10x faster</p><b>🚀</b><b>✅</b><b>⚡</b></body></html>"
    )
    got = page_signals(spark, generated)
    assert {"fp.lovable", "st.section_comments", "st.untouched_scaffold", "ct.dead_links", "ct.placeholder_copy", "ct.generic_names", "ct.marketing_cliche", "ct.stat_inflation", "ct.emoji_icons", "ae.indigo", "ae.shadcn_defaults"} <= got
    human = "<html><body><table><tr></tr></table><script src='/js/jquery.min.js'></script><a href='/privacy'>p</a><script src='https://plausible.io/x'></script><p>Founded in 1987, 12 Main street, mon-fri, $10.00, recieve</p>© 2003<link href='/wp-content/x.css'></body></html>"
    secure = {"content-security-policy": "default-src 'self'", "strict-transport-security": "max-age=31536000"}
    got = page_signals(spark, human, headers=secure)
    assert {"hu.legacy_stack", "hu.operational_stack", "hu.typos", "hu.dated_copyright", "hu.cms", "hu.hardened_headers"} <= got and not any(s.startswith("fp.") for s in got)
    assert page_signals(spark, None) == set() and "fp.replit" in page_signals(spark, "", "https://a.b.repl.co/x")
    facts = pages.facts(pages.prepare(spark.createDataFrame([(1, "http://x", human, {"server": "nginx/1", **secure})], "page_id long, url string, html string, headers map<string,string>"))).first()
    assert (facts["cms"], facts["hosting"], facts["security_headers"]) == ("WordPress", "nginx/1", 2)


def test_history_log_formats(spark):
    log = "commit 1234567aa\nAuthor: Ann <a@x>\nDate:   Mon Jan 1 10:00:00 2024 +0000\n\n    First subject\n    second line\n\n3\t1\ta.txt\n-\t-\tb.png\n 2 files changed, 3 insertions(+), 1 deletion(-)\ncommit 89abcde00\nAuthor: bob <b@x>\nDate:   Tue Jan 2 10:00:00 2024 +0000\n\n    Merge x"
    got = gitlog.commits(spark.createDataFrame([(1, log), (2, "abcdef1 one line\n5\t5\tx\n1234567 two"), (3, None)], "repo_id int, log string")).orderBy("repo_id", "paste_pos").collect()
    assert [(r["repo_id"], r["hash"], r["author"], r["subject"]) for r in got] == [(1, "1234567aa", "Ann", "First subject"), (1, "89abcde00", "bob", "Merge x"), (2, "abcdef1", "", "one line"), (2, "1234567", "", "two")]
    assert (got[0]["added"], got[0]["removed"], got[0]["files"], got[0]["ts"]) == (6, 2, 2, 1704103200) and got[2]["added"] == 0


def test_history_signals(spark):
    rows = [("r", f"{i:07x}", 1_700_000_000 + i * 100, "A", s, a, 0, 1, 9 - i) for i, (s, a) in enumerate([("initial commit", 900), ("fix typo", 1), ("fix build", 2), ("fix import path", 1), ("update", 3), ("update.", 1), ("wip", 1)])]
    folder = Folder(spark, "history")
    placed = history.position(spark.createDataFrame(rows, "repo_id string, hash string, ts long, author string, subject string, added long, removed long, files int, paste_pos long"), folder)
    got = {r["signal_id"] for r in history.fired(history.features(placed, history.bursts(placed, folder))).collect()}
    assert got == {"gh.big_bang", "gh.velocity", "gh.micro_fix_trail", "gh.single_session", "gh.generic_messages"}
    assert history.trend(placed, 3).orderBy("bucket").select("commits").collect() == [(2,), (2,), (3,)]


def test_links(spark):
    base = "http://x.org/a/b.html?q#f"
    df = spark.createDataFrame([(h,) for h in ["../c", "/d", "//y.org/e", "#top", "mailto:a", "http://z.org/#x", "g?h=1&amp;i=2"]], "h string").select(links.absolute(F.col("h"), F.lit(base)).alias("u"))
    assert [r["u"] for r in df.collect()] == ["http://x.org/c", "http://x.org/d", "http://y.org/e", None, None, "http://z.org/", "http://x.org/a/g?h=1&i=2"]
    assert one(spark, "HTTPS://X.org:8080/a/Index.html?q=1#f", links.canonical) == "x.org/a?q=1" and one(spark, "http://x.org", links.canonical) == "x.org/"
    robots = spark.createDataFrame([("s", "User-agent: bad\nDisallow: /\nUser-agent: *\nDisallow: /p*\nDisallow:\n")], "site string, body string")
    rules = links.robots_rules(robots)
    found = links.allowed(spark.createDataFrame([("s", "http://s/p/1"), ("s", "http://s/q"), ("t", "http://t/p")], "site string, link string"), rules)
    assert sorted(r["link"] for r in found.collect()) == ["http://s/q", "http://t/p"]
    maps = spark.createDataFrame([("s", "<urlset><url><loc> http://s/1 </loc><lastmod>2024-01-02T1</lastmod></url><url><loc>http://s/2</loc></url></urlset>")], "site string, body string")
    assert [tuple(r) for r in links.sitemap_entries(maps).orderBy("loc").collect()] == [("s", "http://s/1", date(2024, 1, 2)), ("s", "http://s/2", None)]
    keyed = spark.createDataFrame([("s", k) for k in "abcd"], "site string, key string")
    steps = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "b", "zz"), ("s", "c", "a")], "site string, source string, target string")
    assert {(r["key"], r["depth"]) for r in links.crawl_depth(keyed, steps, keyed.filter("key = 'a'"), Folder(spark, "depth")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_similarity_without_pairs_equals_pairs(spark):
    rows = [("s", i, f"<body>{'<p class=\"a b\">' * (i % 4)}{'<div>' * (i % 3)}</body>") for i in range(9)] + [("t", 50, "<p>")]
    p = spark.createDataFrame(rows, "site string, page_id int, html string")
    tokens = sites.shape_tokens(p)
    pairs = {r["site"]: r["c"] for r in sites.similarity_pairs(tokens).groupBy("site").agg(F.sum("cosine").alias("c")).collect()}
    mean = {r["site"]: r["similarity"] for r in sites.mean_similarity(tokens, p).collect()}
    assert set(mean) == {"s"} and mean["s"] == pytest.approx(pairs["s"] / 36, abs=1e-8)
    assert [one(spark, str(n), lambda c: sites.required_pages(c.cast("int"))) for n in (1, 8, 9, 50)] == [2, 2, 3, 13]


def test_visit_functions(spark):
    assert one(spark, "/index.php?x", visits.normalise_path) == "/" and one(spark, "a#b", visits.normalise_path) == "/a"
    own = F.lit("www.me.org")
    assert one(spark, "https://ME.org/x", lambda c: visits.referer_host(c, own)) is None and one(spark, "https://You.org:1/x", lambda c: visits.referer_host(c, own)) == "you.org"
    v = spark.createDataFrame([("/", "1", None, "desktop", datetime(2024, 1, 2, 3)), ("/", "1", "h", "bot", datetime(2024, 1, 2, 4)), ("/x", "2", "h", "mobile", datetime(2023, 1, 1))], "path string, visitor string, referer_host string, device string, created_at timestamp")
    day = F.lit(date(2024, 1, 3))
    r = visits.summary(v, 3, day).first()
    assert (r["views"], r["visitors"], r["bots"], r["busiest"]) == (1, 1, 1, date(2024, 1, 2))
    assert [r["views"] for r in visits.fill_days(visits.daily(v, 3, day), 3, day).orderBy("day").collect()] == [0, 1, 0]
    assert visits.summary(v.limit(0), 3, day).first()["busiest"] is None and visits.prune(v, day, 0).count() == 2


def test_rate_limiter(spark, tmp_path):
    at = [0, 1, 2, 3, 9, 10, 11, 12]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "identity long, event_id long, at long")
    got = {r["event_id"]: r["allowed"] for r in limiter.decisions(df, 3, 10).collect()}
    assert [got[i] for i in range(8)] == [True, True, True, False, False, True, True, True]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.stream_decisions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3, 10)
    stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == got


def test_daily_stream(spark, tmp_path):
    rows = [("/", "desktop", datetime(2024, 1, d, 5)) for d in (1, 1, 2)] + [("/", "bot", datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "path string, device string, created_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    s = limiter.stream_daily(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["day"], r["views"]) for r in spark.table("daily").collect()) == [(date(2024, 1, 1), 2), (date(2024, 1, 2), 1)]


def test_registry():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 60


def test_source_of_many_lines_takes_linear_time(spark):
    """A file of 100,000 lines, with comments, declarations and a block comment that is never closed."""
    unit = "/**\n * Adds a thing\n */\nfunction addThing(a) {\n  // add the thing to the list\n  const list = a; // because 2019-01-01\n\n  return list;\n}\nimport x from 'y'\n"
    src = unit * 10_000 + "/* open\n" + "still a comment\n" * 100
    files = spark.createDataFrame([(1, src), (2, "x = 1"), (3, None)], "subject_id int, src string")
    began = time.time()
    rows = {r["subject_id"]: r for r in code.line_features(code.with_lines(code.sources(files))).collect()}
    assert time.time() - began < 60
    assert (rows[1]["n_lines"], rows[1]["comments"], rows[1]["declared"], rows[1]["documented"], rows[1]["why"]) == (100_102, 50_101, 10_000, 10_000, 10_000)
    assert rows[2]["n_lines"] == 1 and rows[3]["comments"] == 0


def test_page_of_many_cards_takes_linear_time(spark):
    many = "".join(f'<div class="card rounded shadow-lg number-{i} p-6">x</div><p>This is paragraph number {i} of the page, and it goes on for a while.</p><i class="py-{10 + i % 80}">' for i in range(5000))
    three = "".join(f'<div class="card rounded shadow-lg and more p-6"> 0{i} </div>' for i in (1, 2, 3))
    df = spark.createDataFrame([(1, "https://a.test/", many), (2, "https://a.test/b", three), (3, "https://a.test/c", three + three)], "page_id int, url string, html string")
    began = time.time()
    got = {(r["page_id"], r["signal_id"]) for r in pages.hits(pages.prepare(df), 2026).collect()}
    assert time.time() - began < 60
    assert (2, "ae.three_cards") in got and (3, "ae.three_cards") not in got and (1, "ae.three_cards") not in got


def test_code_that_a_page_loads_joins_its_report(spark):
    chatty = "// sure, here's a helper that does it all\n" + "".join(f"const value{i} = {i};\n" for i in range(40)) + "throw new Error('The value is not valid here.');\nthrow new Error('Please note that it cannot be done.');\n"
    padded = "\n".join(f"line {i} of a script that says nothing" for i in range(30))
    rows = [
        (1, {"https://a.test/app.js": chatty, "https://a.test/b.js?x": padded}, None), (2, {"https://a.test/style.css": chatty, "https://a.test/min.js": chatty.replace("\n", " "), "https://a.test/short.js": "// sure, here's a helper\n"}, None),
        (3, {}, [("app.js.map", ["src/a.ts"], "// sure, here's a helper\nconst a = 1;")]), (4, None, [("a", [], "  "), ("b", [], None)]), (5, {"https://a.test/no.js": None}, None), (1, {"https://a.test/app.js": padded, "https://a.test/c.js": chatty}, None),
    ]
    table = spark.createDataFrame(rows, "page_id int, assets map<string,string>, source_maps array<struct<url:string,sources:array<string>,content:string>>")
    subs = assets.sub_subjects(table)
    assert sorted((r["page_id"], r["sub"], r["src"][:12]) for r in subs.collect()) == [(1, 0, "// sure, her"), (1, 0, "line 0 of a "), (1, 1, "// sure, her"), (1, 1, "line 0 of a "), (3, 0, "\n// sure, he")]
    found = assets.hits(subs)
    got = {(r["page_id"], r["signal_id"]): r for r in found.collect()}
    assert {k for k in got if k[1] == "cd.assistant_chatter"} == {(1, "cd.assistant_chatter"), (3, "cd.assistant_chatter")} and (1, "cd.formal_errors") in got
    assert got[1, "cd.assistant_chatter"]["evidence"] == ["line 1: // sure, here's a helper that does it all"]
    own = spark.createDataFrame([(1, "cd.assistant_chatter", 4, ["the page's own"]), (6, "ae.indigo", 1, [])], "page_id int, signal_id string, fire_seq int, evidence array<string>")
    both = {(r["page_id"], r["signal_id"]): r["evidence"] for r in assets.merged(own, found).collect()}
    assert both[1, "cd.assistant_chatter"] == ["the page's own"] and both[6, "ae.indigo"] == [] and (3, "cd.assistant_chatter") in both
    thin = spark.createDataFrame([(i, False) for i in (1, 6)], "page_id int, thin boolean")
    score = lambda hits: {r["page_id"]: r["score"] for r in scoring.reports(hits, thin, "page_id").collect()}
    assert score(assets.merged(own, found))[1] > score(own)[1]
    assert assets.hits(assets.sub_subjects(table.limit(0))).count() == 0


def test_budgets_by_client_and_mode(spark, tmp_path):
    budgets = {"url": (3, 10), "crawl": (1, 20), "code": (2, 5)}
    rows = [("a", "url", 1, 0), ("a", "crawl", 2, 1), ("a", "crawl", 3, 2), ("a", "url", 4, 3), ("a", "url", 5, 9), ("a", "url", 6, 10), ("a", "code", 7, 10), ("b", "crawl", 8, 2), (None, "code", 9, 3), (None, "other", 10, 3), ("a", "url", 11, 11), ("a", "crawl", 12, 30)]
    df = spark.createDataFrame(rows, "identity string, mode string, event_id long, at long")
    got = {r["event_id"]: r["allowed"] for r in limiter.budget_decisions(df, budgets).collect()}
    # the second crawl is refused by its own budget but has spent from that of addresses, so 4 and 5 are refused; 6 comes when the first has run out
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True, 8: True, 9: True, 10: True, 11: True, 12: True}
    assert limiter.budget_decisions(df.limit(0), budgets).count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.stream_budget_decisions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), budgets)
    query = stream.writeStream.format("memory").queryName("budgets").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["event_id"]: r["allowed"] for r in spark.table("budgets").collect()} == got


def test_a_replayed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    table = daytable.DayTable(spark, f"file://{tmp_path}/visits", daytable.VISITS)
    assert table.read().count() == 0  # there before anything is written
    batch = lambda *rows: spark.createDataFrame([(p, v, None, "desktop", None if d is None else datetime(2024, 1, d, 12), "extra") for p, v, d in rows], daytable.VISITS + ", day string")
    table.append(batch(("/a", "x", 1), ("/b", "y", 2), ("/none", "z", None)), 0)
    table.append(batch(("/c", "x", 2)), 1)
    table.append(batch(("/a", "x", 1), ("/b", "y", 2), ("/none", "z", None)), 0)  # again
    daytable.DayTable(spark, f"file://{tmp_path}/visits", daytable.VISITS, writer="other").append(batch(("/d", "w", 2)), 0)
    assert sorted((r["path"], r["day"]) for r in table.read().collect()) == [("/a", date(2024, 1, 1)), ("/b", date(2024, 1, 2)), ("/c", date(2024, 1, 2)), ("/d", date(2024, 1, 2))]
    some = table.read(F.lit(date(2024, 1, 2)), F.lit(date(2024, 1, 9)))
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString() and some.count() == 3
    days = visits.daily(some, 30, F.lit(date(2024, 1, 20)))
    assert [tuple(r) for r in days.collect()] == [(date(2024, 1, 2), 3, 3)]
    source = batch(("/s", "q", 5)).select("path", "visitor", "referer_host", "device", "created_at")
    source.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for k in (1, 2):  # a second query with a new checkpoint replays the same batch
        table.sink(stream(), str(tmp_path / f"checkpoint{k}")).awaitTermination(120)
    assert table.read(F.lit(date(2024, 1, 5))).count() == 1


def test_usage_rows_and_limits_in_bytes(spark):
    rows = [("web", None, "anything", "https://Host.test/" + "é" * 2000, None), ("api", 7, "url", None, None), ("web", None, "code", "pasted", None), ("web", 1, "url", "http://" + "h" * 300 + "/", None)]
    got = visits.record_usage(spark.createDataFrame(rows, "source string, api_key_id long, mode string, target string, at timestamp")).collect()
    assert len(got) == 4 and len(got[0]["target"].encode()) == 2048 and got[0]["target_host"] == "Host.test" and got[1]["target"] is None and got[1]["target_host"] is None
    assert got[2]["target_host"] is None and len(got[3]["target_host"]) == 255
    path = lambda p: one(spark, p, visits.normalise_path)
    assert [path(p) for p in ("/blog/INDEX.php?x", "?a", "", "/é" + "é" * 200, "#a?b")] == ["/blog/", "/a", "/", "/" + "é" * 127, "/a"]
    made = visits.new_keys(spark.createDataFrame([("n", "s")], "name string, s string"), F.lit("s"), F.lit(0).cast("timestamp")).first()
    assert made["key_hash"] == hashlib.sha256(b"s").hexdigest() and made["revoked_at"] is None


def test_bodies_in_named_character_sets(spark):
    samples = [("shift_jis", "日本語のページ"), ("gbk", "中文网页"), ("koi8-r", "Привет"), ("windows-1251", "Съешь"), ("utf-16", "añb"), ("iso-8859-1", "café\x85"), ("windows-1252", "“x”é"), ("big5", "繁體"), ("utf-8", "é")]
    rows = [(i, bytearray(t.encode(label)), f"text/html; charset={label}") for i, (label, t) in enumerate(samples)]
    odd = [
        (100, b"a\xffb", "text/html; charset=gbk", "ab"), (101, b"caf\xe9", "text/html; charset=no-such", "caf?"), (102, b"\x00\xd8a", "x; charset=utf-16le", ""), (103, b"abc", "x; charset=hex", "abc"), (104, b"a\xe9", "charset=us-ascii", "a"),
        (105, b"\x81a", "charset=cp1252", "a"), (106, b'<meta charset="KOI8-R">\xf0', None, '<meta charset="KOI8-R">П'), (107, None, "charset=gbk", None), (108, b"", None, ""),
    ]
    df = spark.createDataFrame(rows + [(i, None if b is None else bytearray(b), k) for i, b, k, _ in odd], "i int, body binary, kind string")
    got = {r["i"]: r["t"] for r in df.select("i", bundles.to_utf8(F.col("body"), F.col("kind")).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(samples)} | {i: t for i, _, _, t in odd}


def test_hosts_beyond_ascii(spark):
    hosts = ["bücher.example", "例え.テスト", "почта.рф", "faß.de", "plain.example", "Ünï.example"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(bundles.ascii_host(F.col("h"))).collect()] == [h.encode("idna").decode() for h in hosts]
    typed = {" http://bücher.example:8080/x?y ": "http://xn--bcher-kva.example:8080/x?y", "bücher.example/é": None, "a..ü": None, "user@почта.рф": "https://user@xn--80a1acny.xn--p1ai", "": None}
    assert {t: one(spark, t, bundles.normalise_url) for t in typed} == typed


def test_harvest_stops_at_both_kinds_together(spark, monkeypatch):
    monkeypatch.setattr(bundles, "MAX_STRINGS", 3)
    source = "'flex items-center gap-4 p-6' 'Ship faster with our platform today' \"Trusted by every team we know\" 'grid gap-4 p-6 m-4' 'short'"
    row = spark.range(1).select(bundles.harvest(F.lit(source)).alias("h")).select("h", bundles.class_attributes(F.col("h")).alias("c"), bundles.sentences(F.col("h")).alias("s")).first()
    assert len(row["h"]) == 3 and row["c"] == 'class="flex items-center gap-4 p-6"' and row["s"].count("\n") == 1

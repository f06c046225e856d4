"""Queries over what a fetch brings: assets, source maps, bundles, headers, addresses and character sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_label
from ..operators import bundles as B
from ..operators import pages as P
from .web import YEAR, sited

TAGS = (
    '<script src="/assets/index-a1b2c3d4.js"></script><script src="https://cdn.other.example/lib.js"></script><link rel="stylesheet" href="main.css"><script src="../lib/./app.js?v=2"></script><script src="/static/gtag.js"></script>'
    '<link href="/theme/a.css?x" rel="preload"><script src="data:text/javascript,1"></script><script src="/static/chunk.mjs"></script>'
)
#: (every k-th page, remainder, script of the page)
SCRIPTS = [
    (5, 0, 'var a="flex items-center gap-4 bg-indigo-500 rounded-2xl";var b=\'Ship faster with our seamless platform today\';get("GET /api/users list");var c="camelCaseName only";'),
    (5, 1, "var t=`Recieve the calender of our whole team`;var u=\"md:flex hover:bg-violet-600 text-purple-50 from-indigo-500\";var v='index.js';"),
    (5, 2, 'x("a b");y("https://example.org/a b c d e f g h");z("one two three four five six seven");'),
]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _map_json(p: DataFrame) -> DataFrame:
    """Pages with the JSON of a source map: two files of their own and one of a library."""
    page = F.col("page_id").cast("string")
    files = F.array(F.concat(F.lit("src/App"), page, F.lit(".tsx")), F.lit("../node_modules/react/index.js"), F.lit("src/\"odd\" é.ts"), F.lit(""))
    texts = F.array(F.concat(F.lit("// page "), page, F.lit("\nexport const \"a\" = 1;")), F.lit("library"), F.lit(None).cast("string"), F.lit("nothing"))
    return p.withColumn("json", F.to_json(F.struct(F.lit(3).alias("version"), files.alias("sources"), texts.alias("sourcesContent")), {"ignoreNullFields": "false"}))


def page_assets(spark, sf_dir):
    """Which of its assets are worth fetching, for every page."""
    return B.page_assets(_pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit(TAGS))))


def page_assets_fetched(spark, sf_dir):
    """The assets that can be fetched for every page: where one is missing, empty or an error, the next best takes its place."""
    p = _pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit(TAGS)))
    wanted = B.page_assets(p, most=1000).select("page_id", F.col("asset").alias("url")).join(p.select("page_id", "html"), "page_id")
    k = (F.length("url") + F.instr("url", "main.css")) % 7
    bodies = wanted.groupBy("url").agg(F.min("html").alias("html")).select("url", F.when(k == 1, 404).when(k == 2, 503).otherwise(200).alias("status"), F.when(k == 3, "").otherwise(F.concat("url", F.lit("\n"), "html")).alias("body")).filter(k != 4)
    found = B.fetched_assets(p, bodies)
    return found.select("page_id", F.posexplode(F.map_entries("assets")).alias("place", "a")).select("page_id", "place", F.col("a.key").alias("asset"), F.md5(F.col("a.value")).alias("body"))


def source_maps(spark, sf_dir):
    """Source maps of each page's scripts: inline for some pages, another file, a file of another host or none for others."""
    p = _map_json(_pages(spark, sf_dir))
    root = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1)
    k = F.col("page_id") % 4
    note = F.when(k == 0, F.concat(F.lit("data:application/json;base64,"), F.replace(F.base64(F.col("json").cast("binary")), F.lit("\r\n"), F.lit("")))).when(k == 1, "app.js.map").when(k == 2, "https://other.example/app.js.map")
    script = F.concat(F.lit("run();\n//# "), F.when(k == 3, "nothing").otherwise(F.concat(F.lit("sourceMappingURL="), note)))
    p = p.withColumn("assets", F.create_map(F.concat(root, F.lit("/js/app.js")), script, F.concat(root, F.lit("/a.css")), F.lit("/*# sourceMappingURL=a.css.map */")))
    p = p.withColumn("bodies", F.create_map(F.concat(root, F.lit("/js/app.js.map")), F.col("json")))
    maps = B.source_maps(p).select("page_id", F.explode("source_maps").alias("m"))
    return maps.select("page_id", F.col("m.url").alias("url"), F.array_join("m.sources", "|").alias("sources"), F.md5("m.content").alias("content"))


def bundle_strings(spark, sf_dir):
    """What the scripts of pages tell of their classes and sentences."""
    body = F.lit("")
    for k, r, x in SCRIPTS:
        body = F.when(F.col("page_id") % k == r, F.lit(x)).otherwise(body)
    p = _pages(spark, sf_dir).select("page_id", B.harvest(body).alias("s"))
    return p.select("page_id", B.class_attributes(F.col("s")).alias("classes"), B.sentences(F.col("s")).alias("sentences"))


def bundle_hits(spark, sf_dir):
    """Signals of pages that are built in the browser: an empty document, with all there is to read in its script."""
    body = F.lit("")
    for k, r, x in SCRIPTS:
        body = F.when(F.col("page_id") % k == r, F.lit(x)).otherwise(body)
    p = sited(spark, sf_dir).withColumn("html", F.lit('<html lang="en"><body><div id="root"></div></body></html>')).withColumn("assets", F.create_map(F.lit("/assets/index-a1b2c3d4.js"), body))
    return P.hits(P.prepare(p), YEAR).select("page_id", "signal_id")


def response_headers(spark, sf_dir):
    """Headers of raw responses: only the last block counts, and repeated names are joined."""
    raw = F.concat(F.lit("HTTP/1.1 100 Continue\r\nServer: early\r\n\r\nHTTP/1.1 200 OK\r\nServer:  nginx \r\nSet-Cookie: a=1\r\nno header\r\n: nameless\r\nEmpty:\r\nX-Page: "), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "\r\nset-cookie: b=2; path=/").otherwise(""))
    h = _pages(spark, sf_dir).select("page_id", B.parse_headers(raw).alias("h"))
    return h.select("page_id", F.size("h").alias("headers"), F.col("h")["server"].alias("server"), F.col("h")["set-cookie"].alias("cookies"), F.col("h")["x-page"].alias("page"))


_TYPED = ["url", "'  ' || url || ' '", "'example.org/x?y'", "'ftp://example.org/x'", "'http://localhost:8080/'", "'http://10.1.2.3/x'", "'http://8.8.4.4/x'", "'http://example.org:22/'", "'http://[::1]/'", "'http://[2606:4700::1111]/'", "''", "'not a url'", "'http://intranet.local/'", "'http://192.168.0.' || page_id || '/'", "replace(url, '://', '://bücher.')", "replace(url, '://', '://www.例え.')", "replace(url, '://', '://Faß-пример.')", "'почта.рф'", "'http://a..ü/'"]


def url_checks(spark, sf_dir):
    """Typed addresses: what they mean, and why they may not be fetched."""
    typed = F.expr("CASE " + " ".join(f"WHEN page_id % {len(_TYPED)} = {i} THEN {x}" for i, x in enumerate(_TYPED)) + " END")
    p = _pages(spark, sf_dir).select("page_id", B.normalise_url(typed).alias("address"))
    return p.select("page_id", "address", B.refusal(F.col("address")).alias("refused"))


#: (label, text, its bytes in that character set)
SAMPLES = [(label, text, text.encode(label, "ignore")) for label, text in (
    ("shift_jis", "日本語のページ、カタカナ"), ("gbk", "中文网页，测试"), ("koi8-r", "Привет, мир"), ("windows-1251", "Съешь ещё этих булок"), ("euc-kr", "한국어 문서"), ("big5", "繁體中文"), ("iso-8859-2", "Příliš žluťoučký kůň"), ("iso-8859-7", "Ελληνικά"),
)]


def body_charsets(spark, sf_dir):
    """Pages in many character sets as text: labels in headers or in the page, broken bytes, unknown labels."""
    p = _pages(spark, sf_dir)
    n = len(SAMPLES) + 6
    k = F.col("page_id") % n
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"[^\x00-\x7F]|(?i)charset", "")
    body, kind = html.cast("binary"), F.lit("text/html")
    for i, (label, _, data) in enumerate(SAMPLES):
        note = F.lit(f'<meta charset="{label.upper()}">' if i % 2 else "")
        body = F.when(k == i, F.concat(note.cast("binary"), bare.cast("binary"), F.lit(data), F.lit(b"\xff" if label in ("gbk", "big5") else b""))).otherwise(body)
        kind = F.when(k == i, "text/html" if i % 2 else f"text/html; charset={label}").otherwise(kind)
    at = len(SAMPLES)
    special = [("text/html; charset=ISO-8859-1", F.encode(F.concat(bare, F.lit("café")), "ISO-8859-1")), ('text/html; charset="utf-16"', F.encode(html, "UTF-16")), ("text/html; charset=no-such-set", F.concat(bare.cast("binary"), F.unhex(F.lit("C328")))),
               ("text/html; charset=us-ascii", F.concat(bare.cast("binary"), F.unhex(F.lit("C3A9")))), ("text/html; charset=windows-1252", F.concat(bare.cast("binary"), F.unhex(F.lit("93788194E9"))))]
    for i, (given, data) in enumerate(special):
        body, kind = F.when(k == at + i, data).otherwise(body), F.when(k == at + i, given).otherwise(kind)
    rows = p.select("page_id", body.alias("body"), kind.alias("kind")).withColumn("label", F.coalesce(B.charset(F.col("kind"), F.col("body")), F.lit("")))
    return rows.select("page_id", B.decode_body(F.col("body"), F.col("label")).alias("text")).select("page_id", F.md5("text").alias("text"), F.length("text").alias("characters"))


def byte_cuts(spark, sf_dir):
    """The first 40 bytes of documents, cut between characters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", B.safe_cut(F.concat(F.lit("é日🚀"), "text"), 40).alias("cut"), F.octet_length(B.safe_cut(F.repeat(F.lit("é日🚀"), 5), 19)).alias("bytes"))


def code_labels(spark, sf_dir):
    """Names of code languages as they are shown."""
    names = ["php", "python", "typescript", "jsx", "javascript", "html", "css", "go", "java", "sql", "unknown", "rust"]
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    return d.groupBy(language_label(name).alias("label")).agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (page_assets, page_assets_fetched, source_maps, bundle_strings, bundle_hits, response_headers, url_checks, body_charsets, byte_cuts, code_labels)}


def _q(p: str) -> str:
    return p.replace("'", "''")


_PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"
_SCRIPT = "CASE " + " ".join(f"WHEN page_id % {k} = {r} THEN '{_q(x)}'" for k, r, x in SCRIPTS) + " ELSE '' END"
_USEFUL = f"len(list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda w: regexp_matches(w, '{_q(B.UTILITY)}')))"
_CLASSES = f"(contains(trim(x), ' ') AND NOT regexp_matches(trim(x), '[<>{{}};=()]|https?://') AND len(regexp_split_to_array(trim(x), '\\s+')) BETWEEN 2 AND 40 AND {_USEFUL} >= 2 AND {_USEFUL} >= 0.7 * len(regexp_split_to_array(trim(x), '\\s+')))"
_PROSE = f"(strlen(trim(x)) >= 15 AND NOT regexp_matches(trim(x), '{_q(B.NO_PROSE)}') AND len(regexp_split_to_array(trim(x), '\\s+')) >= 3 AND regexp_matches(trim(x), '^[\\p{{L}}\\p{{N}}\\p{{Pi}}“\"''(]') AND len(regexp_extract_all(trim(x), '\\p{{L}}')) > 0.6 * strlen(trim(x)))"
_STRINGS = f"""b AS (SELECT page_id, {_SCRIPT} AS body FROM pages), s AS (
    SELECT page_id, list_filter(list_transform(regexp_extract_all(body, '"[^"''`\\r\\n]{{0,300}}"|''[^"''`\\r\\n]{{0,300}}''|`[^"''`\\r\\n]{{0,300}}`'), lambda x: x[2:-2]), lambda x: strlen(x) >= 6) AS s FROM b
), t AS (SELECT page_id, array_to_string(list_transform(list_filter(s, lambda x: {_CLASSES}), lambda x: 'class="' || x || '"'), chr(10)) AS classes, array_to_string(list_filter(s, lambda x: NOT {_CLASSES} AND {_PROSE}), chr(10)) AS sentences FROM s)"""
_BUNDLE_SIGNALS = {
    "ae.indigo": "len(list_distinct(regexp_extract_all(classes, '(?i)\\b(?:bg|text|from|via|to|border|ring)-(?:indigo|violet|purple|fuchsia)-\\d{2,3}\\b'))) >= 3",
    "hu.typos": "regexp_matches(lower(sentences), 'recieve|calender')",
    "st.spa_shell": "false",
}
_RANKED = rf"""WITH h AS (SELECT page_id, url, html || '{_q(TAGS)}' AS html FROM pages),
r0 AS (SELECT page_id, url, list_concat(list_concat(regexp_extract_all(html, '{_q(B.SCRIPT)}', 1), regexp_extract_all(html, '{_q(B.STYLESHEET)}', 1)), regexp_extract_all(html, '{_q(B.CSS)}', 1)) AS refs FROM h),
r1 AS (SELECT page_id, url, unnest(refs) AS ref, unnest(range(len(refs))) AS i FROM r0),
r2 AS (SELECT *, CASE WHEN regexp_matches(ref, '^(data:|#)') OR regexp_matches(ref, '(?i)^(javascript|mailto):') THEN NULL WHEN regexp_matches(ref, '(?i)^https?://') THEN ref WHEN starts_with(ref, '//') THEN split_part(url, '://', 1) || ':' || ref WHEN starts_with(ref, '/') THEN {_ROOT} || ref
    ELSE {_ROOT} || array_to_string(list_reduce(list_prepend([''], list_transform(list_filter(string_split(regexp_replace({_PATH.format('url')}, '[^/]*$', '') || ref, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])),
        lambda acc, x: CASE WHEN x[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[:len(acc) - 1] ELSE acc END ELSE list_append(acc, x[1]) END), '/') END AS asset FROM r1),
r3 AS (SELECT page_id, asset, min(i) AS i, lower({_PATH.format('asset')}) AS p FROM r2 WHERE {_HOST.format('asset')} = {_HOST.format('url')} GROUP BY ALL),
r4 AS (SELECT *, CASE WHEN regexp_matches(p, '{B.TRACKER}') THEN -10 WHEN ends_with(p, '.css') THEN 100 WHEN regexp_matches(p, '{"|".join(B.ENTRY)}') THEN 90 WHEN regexp_matches(p, '/(assets|static|_next|_nuxt|build|dist)/') THEN 60 WHEN ends_with(p, '.js') THEN 40 ELSE 10 END::INT AS rank FROM r3),
"""
SQL = {
    "page_assets": f"{_RANKED}r5 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, i) - 1 AS place FROM r4) SELECT page_id, asset, rank, place::INT AS place FROM r5 WHERE place < 4",
    "page_assets_fetched": f"""{_RANKED}b AS (SELECT asset, min(html) AS html FROM r4 JOIN h USING (page_id) GROUP BY 1),
fine AS (SELECT asset, asset || chr(10) || html AS body FROM b WHERE (length(asset) + instr(asset, 'main.css')) % 7 IN (0, 5, 6)),
r5 AS (SELECT page_id, asset, body, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, i) - 1 AS place FROM r4 JOIN fine USING (asset)) SELECT page_id, place::INT AS place, asset, md5(body) AS body FROM r5 WHERE place < 4""",
    "source_maps": rf"""WITH j AS (SELECT page_id, {_ROOT} AS root, '{{"version":3,"sources":["src/App' || page_id || '.tsx","../node_modules/react/index.js","src/\"odd\" é.ts",""],"sourcesContent":["// page ' || page_id || '\nexport const \"a\" = 1;","library",null,"nothing"]}}' AS made FROM pages),
m AS (SELECT page_id, root || CASE page_id % 4 WHEN 0 THEN '/js/app.js (inline)' ELSE '/js/app.js.map' END AS url, from_base64(to_base64(encode(made)))::BLOB AS body, made FROM j WHERE page_id % 4 < 2),
f AS (SELECT page_id, url, list_transform(range(json_array_length(decode(body), '$.sources')::BIGINT), lambda i: {{'s': json_extract_string(decode(body), '$.sources[' || i || ']'), 'c': json_extract_string(decode(body), '$.sourcesContent[' || i || ']')}}) AS f FROM m),
k AS (SELECT page_id, url, list_filter(f, lambda x: x.s <> '' AND NOT regexp_matches(x.s, '(^|/)(node_modules|vendor|bower_components)/')) AS f FROM f)
SELECT page_id, url, array_to_string(list_transform(f, lambda x: x.s), '|') AS sources, md5(array_to_string(list_transform(list_filter(f, lambda x: x.c IS NOT NULL), lambda x: chr(10) || x.c), '')) AS content FROM k""",
    "bundle_strings": f"WITH {_STRINGS} SELECT page_id, classes, sentences FROM t",
    "bundle_hits": f"WITH {_STRINGS}, u AS (SELECT t.*, true AS one FROM t) " + " UNION ALL ".join(f"SELECT page_id, '{n}' AS signal_id FROM u WHERE {c}" for n, c in _BUNDLE_SIGNALS.items()),
    "response_headers": """WITH r AS (SELECT page_id, 'HTTP/1.1 200 OK\nServer:  nginx \nSet-Cookie: a=1\nno header\n: nameless\nEmpty:\nX-Page: ' || page_id || CASE WHEN page_id % 2 = 0 THEN '\nset-cookie: b=2; path=/' ELSE '' END AS raw FROM pages),
l AS (SELECT page_id, unnest(string_split(raw, chr(10))) AS line, unnest(range(len(string_split(raw, chr(10))))) AS i FROM r),
f AS (SELECT page_id, i, lower(trim(split_part(line, ':', 1))) AS k, trim(substr(line, instr(line, ':') + 1)) AS v FROM l WHERE instr(line, ':') > 1), g AS (SELECT page_id, k, string_agg(v, ', ' ORDER BY i) AS v FROM f WHERE v <> '' GROUP BY ALL)
SELECT page_id, count(*)::INT AS headers, max(v) FILTER (k = 'server') AS server, max(v) FILTER (k = 'set-cookie') AS cookies, max(v) FILTER (k = 'x-page') AS page FROM g GROUP BY 1""",
    "url_checks": rf"""WITH g AS (SELECT page_id, trim(CASE {' '.join(f'WHEN page_id % {len(_TYPED)} = {i} THEN {x}' for i, x in enumerate(_TYPED))} END) AS given FROM pages),
t AS (SELECT page_id, replace(replace(replace(replace(given, 'bücher', 'xn--bcher-kva'), '例え', 'xn--r8jz45g'), 'Faß-пример', 'xn--fass--3weu6azakd'), 'почта.рф', 'xn--80a1acny.xn--p1ai') AS typed FROM g),
a AS (SELECT page_id, CASE WHEN typed <> '' AND strlen(typed) <= 2000 AND NOT regexp_matches(typed, '[^\x21-\x7e]') THEN CASE WHEN contains(typed, '://') THEN typed ELSE 'https://' || typed END END AS address FROM t),
h AS (SELECT *, lower(split_part(address, '://', 1)) AS scheme, regexp_replace(lower(regexp_extract(address, '://(\[[^\]]*\]|[^/?#:]+)', 1)), '[\[\]]', '', 'g') AS host, regexp_extract(address, '://(?:\[[^\]]*\]|[^/?#:]+):(\d+)', 1) AS port FROM a)
SELECT page_id, address, CASE WHEN address IS NULL THEN 'no_url' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN port <> '' AND port NOT IN ('80', '443', '8080', '8443') THEN 'port' WHEN host = 'localhost' OR ends_with(host, '.local') OR ends_with(host, '.internal') OR ends_with(host, '.home') OR ends_with(host, '.lan') THEN 'local'
    WHEN host = '::1' OR starts_with(host, '10.') OR starts_with(host, '192.168.') OR starts_with(host, '127.') THEN 'private' END AS refused FROM h""",
    "body_charsets": f"""WITH a AS (SELECT page_id, page_id % {len(SAMPLES) + 6} AS k, coalesce(html, '') AS html, regexp_replace(regexp_replace(coalesce(html, ''), '[^\\x00-\\x7F]', '', 'g'), '(?i)charset', '', 'g') AS bare FROM pages),
t AS (SELECT page_id, CASE k {' '.join(f"""WHEN {i} THEN '{f'<meta charset="{label.upper()}">' if i % 2 else ''}' || bare || '{text}'""" for i, (label, text, _) in enumerate(SAMPLES))}
    WHEN {len(SAMPLES)} THEN bare || 'café' WHEN {len(SAMPLES) + 2} THEN bare || '?(' WHEN {len(SAMPLES) + 3} THEN bare WHEN {len(SAMPLES) + 4} THEN bare || '“x”é' ELSE html END AS text FROM a)
SELECT page_id, md5(text) AS text, length(text)::INT AS characters FROM t""",
    "byte_cuts": "WITH c AS (SELECT doc_id, 'é日🚀' || text AS t, list_max(list_filter(range(0, 41), lambda k: strlen(left('é日🚀' || text, k)) <= 40)) AS k FROM documents) SELECT doc_id, left(t, k) AS cut, 18 AS bytes FROM c",
    "code_labels": "WITH n AS (SELECT ['PHP', 'Python', 'TypeScript', 'React / JSX', 'JavaScript', 'HTML', 'CSS', 'Go', 'Java', 'SQL', 'Unrecognised language', 'Rust'][doc_id % 12 + 1] AS label FROM documents) SELECT label, count(*) AS documents FROM n GROUP BY 1",
}

"""What a fetched page brings along: headers, character sets, addresses, assets, bundles and source maps, as native expressions."""

from __future__ import annotations

import codecs
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .links import host, path

# Limits of a fetch, and patterns that assets, addresses and strings are recognised by.
MAX_ASSETS, MAX_MAPS, MAX_ASSET_BYTES, MAX_MAP_BYTES, MAX_PATHS, MAX_STRINGS, MAX_HEADERS = 4, 2, 768 * 1024, 2 * 1024 * 1024, 400, 4000, 60
SCRIPT, STYLESHEET, CSS = r"(?i)<script\b[^>]*\bsrc=[\"']([^\"']+)[\"']", r"(?i)<link\b[^>]*\brel=[\"']stylesheet[\"'][^>]*\bhref=[\"']([^\"']+)[\"']", r"(?i)<link\b[^>]*\bhref=[\"']([^\"']+\.css[^\"']*)[\"']"
TRACKER = r"gtag|gtm|analytics|consent|cookie|tarteaucitron|axeptio|didomi|hotjar|clarity|recaptcha|polyfill|jquery|widget|chat|intercom|crisp|tawk"
ENTRY = [r"/(?:assets/)?(?:index|main|app|entry|client|bundle)[.-][a-z0-9_-]{4,}\.js$", r"/_next/static/chunks/(?:main|app|pages/_app)[^/]*\.js$", r"/_nuxt/(?:entry|index)\.[a-z0-9]+\.js$"]
BUILT = r"/(?:assets|static|_next|_nuxt|build|dist)/"
MAP_NOTE = r"(?://|/\*)[#@]\s*sourceMappingURL=([^\s*'\"]+)"
LIBRARY_PATH = r"(?:^|/)(?:node_modules|vendor|bower_components)/"
STRING = r"([\"'`])([^\"'`\r\n]{0,300})\1"
UTILITY = (
    r"(?i)^(?:(?:sm|md|lg|xl|2xl|hover|focus|focus-visible|active|disabled|group-hover|peer|dark|first|last|odd|even|motion-safe|motion-reduce|print|rtl|ltr|aria-\w+|data-\[[^\]]+\])[:-])*"
    r"(?:bg|text|font|leading|tracking|p|px|py|pt|pb|pl|pr|ps|pe|m|mx|my|mt|mb|ml|mr|w|h|min|max|flex|grid|col|row|gap|space|items|justify|self|place|order|rounded|border|divide|ring|outline|shadow|opacity|blur|backdrop|filter|"
    r"transition|duration|delay|ease|animate|transform|scale|rotate|translate|skew|absolute|relative|fixed|sticky|static|inset|top|bottom|left|right|z|overflow|object|aspect|container|block|inline|inline-flex|inline-block|hidden|"
    r"visible|invisible|cursor|select|pointer|resize|whitespace|break|truncate|list|table|sr|not-sr|from|via|to|fill|stroke|antialiased|uppercase|lowercase|capitalize|italic|underline|line|decoration|underline-offset|shrink|grow|"
    r"basis|wrap|nowrap|origin|will-change|snap|touch|scroll)(?:-[a-z0-9./%\[\]#()_-]+)*$"
)
NO_PROSE = r"[<>{}\\]|https?://|^[a-z]+([A-Z][a-z]+)+$|^[\w.-]+\.(?:js|css|json|png|svg|tsx?|jsx?)$"
PORTS = (80, 443, 8080, 8443)
LOCAL_HOST = r"^localhost$|\.local$|\.internal$|\.home$|\.lan$"
PRIVATE_V4 = r"^(?:10\.|127\.|0\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.|100\.64\.|(?:24\d|25[0-5])\.)"
PRIVATE_V6 = r"^(?:::1?$|f[cd]|fe[89ab]|2001:0?db8:|2001:1[0-9a-f]:|5f|3ff3)"

MAPS = "array<struct<url:string,sources:array<string>,content:string>>"
_MAP_JSON = "sources array<string>, sourcesContent array<string>"


def safe_cut(s: Column, n: int) -> Column:
    """At most n bytes of UTF-8, cut between characters."""
    data = s.cast("binary")
    part = F.substring(data, 1, n)
    # a last character whose bytes aren't all there
    broken = F.length(F.regexp_extract(F.hex(F.substring(part, -3, 3)), "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$", 0)) / 2
    return F.when(F.octet_length(s) <= n, s).otherwise(F.substring(part, F.lit(1), (F.lit(n) - broken).cast("int")).cast("string"))


def parse_headers(raw: Column) -> Column:
    """A map of lower-case names to values from the last block of a response's header lines; repeated names are joined by commas."""
    block = F.element_at(F.split(F.trim(F.regexp_replace(raw, "\r\n", "\n")), "\n\n"), -1)
    pairs = F.transform(F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 1), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    names = F.slice(F.array_distinct(F.transform(pairs, lambda p: p["k"])), 1, MAX_HEADERS)
    # the pairs are an argument of zip_with: captured by a lambda they would be read again for every name
    values = F.zip_with(names, F.array_repeat(pairs, F.size(names)), lambda k, all_pairs: F.array_join(F.transform(F.filter(all_pairs, lambda p: p["k"] == k), lambda p: p["v"]), ", "))
    return F.map_from_arrays(names, values)


#: Codecs of Python that are no character sets of documents.
NO_CHARSETS = {"idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape", "unicode_escape", "raw_unicode_escape", "mbcs", "oem", "utf-8-sig"}


def charset(content_type: Column, body: Column) -> Column:
    """The character set that the content type, or else a meta tag near the start, names; empty for none."""
    told = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([\w-]+)", 1))
    start = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    return F.when(told != "", told).otherwise(F.lower(F.regexp_extract(start, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1)))


def _decoder():
    """A function of bodies and labels: bodies in named character sets as text, each set's decoder looked up once a batch.

    Bytes that a set doesn't have are dropped; null for unknown sets. It is made here so that it travels with its code.
    """
    no_charsets = NO_CHARSETS

    def decoded(body: pd.Series, label: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(body), dtype=object)
        for name, rows in body.dropna().groupby(label):
            try:
                codec = codecs.lookup(name)
            except (LookupError, ValueError):
                continue
            if codec.name in no_charsets or not codec._is_text_encoding:
                continue
            out[rows.index] = [codec.decode(bytes(b), "ignore")[0].replace("\x00", "") for b in rows]
        return out

    return F.pandas_udf(decoded, StringType())


def to_utf8(body: Column, content_type: Column) -> Column:
    """A binary body as text, by the character set that it names (charset)."""
    return decode_body(body, F.coalesce(charset(content_type, body), F.lit("")))


def decode_body(body: Column, named: Column) -> Column:
    """A binary body as text, by the name of its character set; empty for none. Both are used often: give columns, not long expressions.

    latin-1, windows-1252 and ASCII are decoded by native columns, other named sets batch by batch (_decoder); bytes that are
    none of the set's are dropped. Without a name, or if the set is unknown, what isn't valid UTF-8 becomes ``?``.
    """
    extra = [(i, bytes([i]).decode("cp1252", "ignore")) for i in range(0x80, 0xA0)]
    latin = F.decode(body, "ISO-8859-1")
    text = body.cast("string")
    # characters without a counterpart are dropped by translate
    western = F.translate(latin, "".join(chr(i) for i, c in extra if c) + "".join(chr(i) for i, c in extra if not c), "".join(c for _, c in extra if c))
    plain = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("?")))
    native = {"": plain, "utf-8": plain, "utf8": plain}
    out = F.when(named.isin(*native), plain).when(named.isin("iso-8859-1", "latin1"), latin).when(named.isin("windows-1252", "cp1252"), western).when(named == "us-ascii", F.regexp_replace(latin, r"[\x{80}-\x{FF}]", ""))
    other = ~named.isin(*native, "iso-8859-1", "latin1", "windows-1252", "cp1252", "us-ascii")
    return out.otherwise(F.coalesce(_decoder()(F.when(other, body), named), plain))


def ascii_host(host: Column) -> Column:
    """A host name as DNS has it: labels with letters beyond ASCII in their ``xn--`` form; unchanged where there is none."""
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host), host)).otherwise(host)


def normalise_url(url: Column) -> Column:
    """A typed address with https:// where it has no scheme and its host in ASCII; null if it is empty, too long or no address."""
    u = F.trim(url)
    full = F.when(u.rlike("(?i)^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    named = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    full = F.when(named.rlike(r"[^\x00-\x7F]"), F.replace(full, named, ascii_host(named))).otherwise(full)
    fine = full.rlike(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^\s/?#@]*@)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*|\[[0-9a-f:.]+\])\.?(?::\d{1,5})?(?:[/?#][\x21-\x7e]*)?$")
    return F.when((u != "") & (F.octet_length(u) <= 2000) & fine, full)


def public_ip(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address in text is neither private nor reserved; false for anything else."""
    v4 = lambda x: x.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$") & ~x.rlike(PRIVATE_V4)
    low = F.lower(ip)
    mapped = F.regexp_extract(low, r"^::ffff:(.*)$", 1)
    v6 = F.when(mapped != "", v4(mapped)).otherwise(low.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$") & ~low.rlike(PRIVATE_V6))
    return F.coalesce(F.when(F.contains(low, F.lit(":")), v6).otherwise(v4(low)), F.lit(False))


def refusal(url: Column) -> Column:
    """Why an address may not be fetched (no_url, scheme, port, local, private); null if it may. Names are not looked up."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    bare, port = F.regexp_replace(name, r"[\[\]]", ""), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:]+):(\d{1,6})", 1)
    literal = bare.rlike(r"^\d+(?:\.\d+){3}$") | F.contains(bare, F.lit(":"))
    return (
        F.when(F.coalesce((scheme == "") | (name == ""), F.lit(True)), "no_url").when(~scheme.isin("http", "https"), "scheme").when((port != "") & ~F.coalesce(F.try_to_number(port, F.lit("999999")).cast("int"), F.lit(0)).isin(*PORTS), "port")
        .when(bare.rlike(LOCAL_HOST), "local").when(literal & ~public_ip(bare), "private")
    )


def resolve(ref: Column, base: Column) -> Column:
    """The http address of a reference; null for data, fragments, scripts and mail. Empty segments and dots are resolved in relative ones."""
    r = F.trim(F.replace(ref, F.lit("&amp;"), F.lit("&")))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    parts = F.filter(F.split(F.concat(F.regexp_replace(path(base), "/[^/]*$", "/"), r), "/"), lambda x: ~x.isin("", "."))
    flat = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)))
    return (
        F.when((r == "") | r.rlike("^(?:data:|#)|(?i)^(?:javascript|mailto):"), F.lit(None).cast("string")).when(r.rlike("(?i)^https?://"), r).when(root == "", F.lit(None).cast("string"))
        .when(r.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), r)).when(r.startswith("/"), F.concat(root, r)).otherwise(F.concat(root, F.lit("/"), F.array_join(flat, "/")))
    )


def asset_rank(url: Column) -> Column:
    """How much an asset may tell: stylesheets most, then entry bundles, built files, other scripts, anything else; trackers least."""
    p = F.lower(path(url))
    entry = reduce(lambda a, b: a | b, [p.rlike(x) for x in ENTRY])
    return F.when(p.rlike(TRACKER), -10).when(p.endswith(".css"), 100).when(entry, 90).when(p.rlike(BUILT), 60).when(p.endswith(".js"), 40).otherwise(10)


def _ranked_assets(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, _ranked): the same-host scripts and stylesheets of a page, best first."""
    refs = F.flatten(F.array(*[F.regexp_extract_all(F.col(html_col), F.lit(p), F.lit(1)) for p in (SCRIPT, STYLESHEET, CSS)]))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_base"), F.array_distinct(F.transform(refs, lambda r: resolve(r, F.col(url_col)))).alias("_all"))
    same = F.filter("_all", lambda a: F.coalesce((host(a) == host(F.col("_base"))) & (host(a) != ""), F.lit(False)))
    ranked = F.transform(same, lambda a, i: F.struct((-asset_rank(a)).alias("order"), i.alias("i"), a.alias("asset")))
    return rows.select("page_id", F.sort_array(ranked).alias("_ranked"))


def page_assets(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = MAX_ASSETS) -> DataFrame:
    """(page_id, asset, rank, place): the same-host scripts and stylesheets of a page that are worth fetching, at most ``most``, best first."""
    best = _ranked_assets(pages, id_col, url_col, html_col).select("page_id", F.posexplode(F.slice("_ranked", 1, most)).alias("place", "a"))
    return best.select("page_id", F.col("a.asset").alias("asset"), (-F.col("a.order")).alias("rank"), "place")


def fetched_assets(pages: DataFrame, bodies: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = MAX_ASSETS) -> DataFrame:
    """(page_id, assets): a map of address to body of the first ``most`` assets, best first, that can be fetched.

    bodies: (url, status, body), what a fetch of an address brings; errors and empty bodies don't count, so the next best
    asset takes their place. Bodies are cut at MAX_ASSET_BYTES. Only addresses that exist are joined with bodies. Pages
    without any asset are left out.
    """
    fine = bodies.filter((F.coalesce("status", F.lit(200)) < 400) & (F.coalesce("body", F.lit("")) != "")).groupBy("url").agg(F.min("body").alias("body"))
    wanted = _ranked_assets(pages, id_col, url_col, html_col).select("page_id", F.posexplode("_ranked").alias("_at", "_a")).select("page_id", "_at", F.col("_a.asset").alias("url"))
    there = wanted.join(fine.select("url"), "url", "left_semi")
    first = there.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("_at"))).filter(F.col("_n") <= most)  # the assets of one page
    found = first.join(fine, "url").select("page_id", F.struct("_n", "url", safe_cut(F.col("body"), MAX_ASSET_BYTES).alias("body")).alias("_b"))
    return found.groupBy("page_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list("_b")), lambda b: F.struct(b["url"], b["body"]))).alias("assets"))


def decode_data_uri(uri: Column) -> Column:
    """The text of a base64 or percent-encoded data address; null if it has none or is too long."""
    head, body = F.substring_index(uri, ",", 1), F.substring(uri, F.instr(uri, ",") + 1, F.length(uri))
    plain = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    return F.when((F.instr(uri, ",") > 0) & (F.octet_length(body) <= MAX_MAP_BYTES), F.when(head.rlike("(?i);base64"), F.try_to_binary(body, F.lit("base64")).cast("string")).otherwise(plain))


def read_map(url: Column, body: Column) -> Column:
    """(url, sources, content) of a source map in JSON: its own files, without those of libraries; null if it names none."""
    data = F.from_json(body, _MAP_JSON)
    files = F.filter(F.arrays_zip(F.transform(data["sources"], lambda x: x).alias("s"), F.coalesce(data["sourcesContent"], F.array().cast("array<string>")).alias("c")), lambda f: F.coalesce((f["s"] != "") & ~f["s"].rlike(LIBRARY_PATH), F.lit(False)))
    content = F.array_join(F.transform(F.filter(files, lambda f: f["c"].isNotNull()), lambda f: F.concat(F.lit("\n"), f["c"])), "")
    return F.when(F.size(files) > 0, F.struct(url.alias("url"), F.transform(files, lambda f: f["s"]).alias("sources"), safe_cut(content, MAX_ASSET_BYTES).alias("content")))


def source_maps(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, source_maps): at most MAX_MAPS source maps of a page's scripts, inline or of the same host.

    pages has assets (map of address to body) and may have bodies (map of address to body) of maps that were fetched.
    """
    bodies = F.col("bodies") if "bodies" in pages.columns else F.create_map().cast("map<string,string>")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_base"), F.coalesce(F.col("assets"), F.create_map().cast("map<string,string>")).alias("assets"), bodies.alias("bodies"))
    scripts = F.filter(F.map_entries("assets"), lambda e: e["key"].rlike(r"(?i)\.js(?:[?#]|$)"))
    noted = F.transform(scripts, lambda e: F.struct(e["key"].alias("asset"), F.regexp_extract(F.right(e["value"], F.lit(4096)), MAP_NOTE, 1).alias("ref")))
    inline = lambda n: n["ref"].rlike("(?i)^data:")
    far = lambda n: resolve(n["ref"], n["asset"])
    named = F.transform(F.filter(noted, lambda n: n["ref"] != ""), lambda n: F.when(inline(n), F.struct(F.concat(n["asset"], F.lit(" (inline)")).alias("url"), decode_data_uri(n["ref"]).alias("body"))).when(host(far(n)) == host(F.col("_base")), F.struct(far(n).alias("url"), F.col("bodies")[far(n)].alias("body"))))
    maps = F.filter(F.transform(F.filter(named, lambda m: m.isNotNull() & (m["body"] != "")), lambda m: read_map(m["url"], m["body"])), lambda m: m.isNotNull())
    return rows.select("page_id", F.slice(maps, 1, MAX_MAPS).alias("source_maps"))


def map_paths(maps: Column) -> Column:
    """The distinct file paths of source maps, one to a line."""
    return F.array_join(F.slice(F.array_distinct(F.flatten(F.transform(maps, lambda m: m["sources"]))), 1, MAX_PATHS), "\n")


def readable_sources(assets: Column, maps: Column, most: int) -> Column:
    """Scripts and other non-style assets and the contents of source maps as one text of at most ``most`` bytes."""
    bodies = F.transform(F.filter(F.map_entries(assets), lambda e: (e["value"] != "") & ~e["key"].rlike(r"(?i)\.css(?:[?#]|$)")), lambda e: e["value"])
    return safe_cut(F.array_join(F.concat(bodies, F.transform(maps, lambda m: m["content"])), "\n"), most)


def strings(source: Column) -> Column:
    """The string literals of six characters and more."""
    return F.filter(F.regexp_extract_all(source, F.lit(STRING), F.lit(2)), lambda x: F.octet_length(x) >= 6)


def is_class_list(s: Column) -> Column:
    """Whether a string is a list of utility classes: two at least, and seven of ten of its words."""
    t = F.trim(s)
    words = F.split(t, r"\s+")
    useful = F.size(F.filter(words, lambda w: w.rlike(UTILITY)))
    return F.contains(t, F.lit(" ")) & ~t.rlike(r"[<>{};=()]|https?://") & F.size(words).between(2, 40) & (useful >= 2) & (useful * 10 >= F.size(words) * 7)


def is_prose(s: Column) -> Column:
    """Whether a string is a sentence: three words, mostly letters, beginning like one."""
    t = F.trim(s)
    starts = t.rlike(r"^[\p{L}\p{N}\p{Pi}\x{2018}\x{201C}\"'(]")
    return (F.octet_length(t) >= 15) & ~t.rlike(NO_PROSE) & (F.size(F.split(t, r"\s+")) >= 3) & starts & (F.regexp_count(t, F.lit(r"\p{L}")) * 10 > F.octet_length(t) * 6)


def harvest(source: Column) -> Column:
    """The string literals that are class lists or sentences, the first MAX_STRINGS of both together."""
    return F.slice(F.filter(strings(source), lambda x: is_class_list(x) | is_prose(x)), 1, MAX_STRINGS)


def class_attributes(harvested: Column) -> Column:
    return F.array_join(F.transform(F.filter(harvested, is_class_list), lambda x: F.concat(F.lit('class="'), x, F.lit('"'))), "\n")


def sentences(harvested: Column) -> Column:
    return F.array_join(F.filter(harvested, lambda x: ~is_class_list(x)), "\n")


def minified(assets: Column) -> Column:
    """Whether a page's larger assets are all bundled: long lines, or few."""
    sized = F.transform(F.filter(F.map_entries(assets), lambda e: F.octet_length(e["value"]) >= 400), lambda e: F.struct(e["key"].alias("k"), F.octet_length(e["value"]).alias("n"), (F.length(e["value"]) - F.length(F.replace(e["value"], F.lit("\n"), F.lit(""))) + 1).alias("lines")))
    dense = lambda x: (x["n"] > 300 * x["lines"]) | (x["lines"] < 8)
    return F.exists(sized, dense) & ~F.exists(sized, lambda x: ~dense(x) & x["k"].rlike(r"(?i)\.js(?:[?#]|$)"))

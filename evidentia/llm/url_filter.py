"""URL rules with redirect equivalence.

A rule blocks or allows a host, its subdomains and the paths that begin with the rule's. Redirects and canonical links
make URLs aliases of each other; the connected components of these links, found by distributed star contraction, carry
block decisions: a URL that no rule fits is blocked if any URL of its component is blocked by a rule. A rule that fits
the URL itself always decides, so an explicit allow takes precedence over a block that reaches the URL through aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import write

#: (verdict, host, path): a host and its subdomains, and the beginning of the path.
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_rule(text: str) -> Rule:
    """``block example.com/de/`` as (verdict, host, path)."""
    verdict, _, where = text.partition(" ")
    host, slash, path = where.partition("/")
    if verdict not in ("block", "allow") or not host:
        raise ValueError(f"not a rule: {text!r}")
    return verdict, host.lower(), slash + path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(rules: list[Rule], host: Column, path: Column) -> Column:
    """``verdict rule`` of the longest rule that fits, or null; of equally long ones the first by name."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        found = found.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(f"{verdict} {h}{p}"))
    return found


def with_alias(df: DataFrame, url_col: str, name: str) -> DataFrame:
    """df with the name of a URL among aliases: without its fragment, and with a lower-case host; null without ``://``."""
    bare = df.withColumn("_bare", F.regexp_replace(F.col(url_col), "(?s)#.*$", ""))
    parts = bare.withColumn("_scheme", F.substring_index("_bare", "://", 1)).withColumn("_host", host_of(F.col("_bare"))).withColumn("_rest", F.regexp_extract("_bare", "(?s)://[^/?#]*(.*)$", 1))
    return parts.withColumn(name, F.when(F.instr("_bare", "://") > 0, F.concat("_scheme", F.lit("://"), "_host", "_rest"))).drop("_bare", "_scheme", "_host", "_rest")


#: What a tag consists of: text without quotes, and quoted values, in which ``>`` may occur.
_TAG = "(?is)<(?:link|meta|base)\\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_ATTRIBUTE = "([^\\s\"'>/=]+)(?:\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+))?"
_REFRESH = "(?is)^\\s*(?:[\\d.]+[\\s;,]+(?:url\\s*=\\s*)?|url\\s*=\\s*)[\"']?([^\"']*)"
_SCHEME, _ROOT = "^[A-Za-z][A-Za-z0-9+.-]*:", "(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def attribute(tag: Column, name: str) -> Column:
    """A tag's first attribute of this name, without quotes and with ``&amp;`` decoded; null if there is none."""
    pairs = F.arrays_zip(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)).alias("k"), F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)).alias("v"))
    value = F.get(F.filter(pairs, lambda p: F.lower(p["k"]) == name), F.lit(0))["v"]
    return F.trim(F.regexp_replace(F.regexp_replace(value, "^[\"']|[\"']$", ""), "(?i)&(?:amp|#38|#x26);", "&"))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    flat = F.aggregate(F.slice(parts, 2, F.size(parts)), none, lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x)))
    closed = F.element_at(parts, -1).isin(".", "..") & (F.size(flat) > 0)
    return F.concat(F.lit("/"), F.array_join(flat, "/"), F.when(closed, "/").otherwise(""))


def resolve(base: Column, target: Column) -> Column:
    """The address that a link on page ``base`` leads to; null for none, for the page itself and for schemes without ``//``."""
    root = F.regexp_extract(base, _ROOT, 1)
    scheme = F.substring_index(root, "://", 1)
    own = F.regexp_extract(base, "(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_replace(own, "[^/]*$", ""))
    path, rest = F.regexp_extract(target, "(?s)^[^?#]*", 0), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string")).when(target.rlike(_SCHEME), F.when(target.rlike(_SCHEME + "//"), target)).when(root == "", F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(path == "", F.concat(root, own, rest)).otherwise(F.concat(root, without_dots(whole), rest))
    )


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): a page's URL and where its canonical links and refresh redirects lead.

    Tags in comments, scripts and styles don't count; quoted attributes may hold ``>``; ``canonical`` may be any word of
    rel. Targets are resolved against the page's URL or its first ``<base href>``.
    """
    found = pages.filter(F.col(html_col).rlike("(?i)canonical|http-equiv") & F.col(url_col).isNotNull())
    bare = F.regexp_replace(html_col, "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>", " ")
    rows = found.select(F.col(url_col).alias("source"), F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0)).alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base\\b")), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    rows = rows.withColumn("base", F.coalesce(resolve(F.col("source"), F.get(bases, F.lit(0))), F.col("source")))
    tags = rows.select("source", "base", F.explode("tags").alias("tag")).withColumn("link", F.col("tag").rlike("(?i)^<link\\b"))
    tags = tags.filter(F.col("link") | F.col("tag").rlike("(?i)^<meta\\b")).withColumn("kind", attribute(F.col("tag"), "rel")).withColumn("equiv", attribute(F.col("tag"), "http-equiv"))
    canonical = F.when(F.col("link") & F.array_contains(F.split(F.lower("kind"), "\\s+"), "canonical"), attribute(F.col("tag"), "href"))
    refresh = F.when(~F.col("link") & (F.lower("equiv") == "refresh"), F.trim(F.regexp_extract(attribute(F.col("tag"), "content"), _REFRESH, 1)))
    leads = tags.withColumn("to", F.coalesce(canonical, refresh)).filter("to <> ''")
    return leads.select("source", resolve(F.col("base"), F.col("to")).alias("target")).filter("target is not null")


def judge(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row.

    rules: at most a few thousand, as they become one expression. links: known redirects (source, target); those in
    html_col are added, if it is given. Rows with a null URL or one without ``://`` have an empty host and path, fit no
    rule and are allowed. Repeated rows are judged alike. An empty table gives no rows; other columns are not read.
    """
    known = [html_links(pages, url_col, html_col)] if html_col else []
    if links is not None:
        known.append(links.select("source", "target"))
    url = F.col(url_col)
    own = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("_url"))
    own = with_alias(own, "_url", "_alias")
    own = own.withColumn("_match", match(rules, F.col("host"), F.col("path")))
    if not known:
        blocked = None
    else:
        edges = known[0]
        for x in known[1:]:
            edges = edges.unionAll(x)
        edges = write(edges, "links")
        joined = components(with_alias(with_alias(edges.df, "source", "a"), "target", "b"))
        edges.drop()
        nodes = joined.df.withColumn("_block", F.coalesce(match(rules, host_of(F.col("id")), path_of(F.col("id"))).startswith("block "), F.lit(False)))
        bad = write(nodes.groupBy("component").agg(F.max("_block").alias("_block")).filter("_block"), "blocked")
        blocked = write(joined.df.join(bad.df, "component").select(F.col("id").alias("_alias"), F.lit(True).alias("_blocked")), "blocked")
        joined.drop()
        bad.drop()
    reached = own.withColumn("_blocked", F.lit(None).cast("boolean")) if blocked is None else own.join(blocked.df, "_alias", "left")
    verdict = F.coalesce(F.substring_index("_match", " ", 1), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return reached.select(id_col, "host", "path", F.regexp_extract("_match", "^\\w+ (?s)(.*)$", 1).alias("rule"), verdict.alias("verdict"))

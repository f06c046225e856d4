"""The registered queries of this package: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, language_id, lloyd, minhash, mixing, packing, quality, topk, toxicity, url_filter, warc_zip, whitening
from .scratch import fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(parts: int, remainder: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), parts) == remainder, F.lit(False))


RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rules and through canonical links and refresh redirects."""
    return url_filter.judge(_read(spark, sf_dir, "pages"), [url_filter.parse_rule(r) for r in RULES])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(F.col("doc_id"), 3) != 1)
    return language_id.predict(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.score(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector with all others."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written to ZIP archives and read back from them."""
    records = warc_zip.read_archives(warc_zip.write_archives(_read(spark, sf_dir, "pages")), payloads=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 3, 17
#: Whole-number weights by path; nodes that aren't named weigh 1.
MIX_WEIGHTS = {("web",): 2, ("curated",): 3, **{(d, lang): w for d in ("web", "curated") for lang, w in (("en", 4), ("de", 3), ("fr", 3), ("es", 5))}, ("curated", "en", "src1"): 6, ("curated", "de", "src2"): 5}


def mix_levels() -> dict[str, Column]:
    """Domain, language and source of a document; the domain ``web`` is the source src0."""
    return {"domain": F.when(F.col("source") == "src0", "web").otherwise("curated"), "lang": F.col("lang"), "source": F.col("source")}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken of every document to spend a token budget by the weights of domains, languages and sources."""
    return mixing.mix(_read(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles have a similarity of 0.8 or more."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=2, percent=80)


def digest_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, with the CRC-32 of each piece's ids."""
    return digest_pieces(packing.pack(_read(spark, sf_dir, "documents"), special=packing.SPECIAL))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors linked by a cosine of 0.95 or more."""
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector projected on the first 32 principal components, scaled to unit variance."""
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth vector."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after five rounds over 40 centroids."""
    return lloyd.cluster(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_top_k": op4_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_warc_zip": op6_warc_zip,
    "op7_mixing": op7_mixing,
    "op8_minhash": op8_minhash,
    "op9_packing": op9_packing,
    "op10_embeddings": op10_embeddings,
    "op11_whitening": op11_whitening,
    "op12_neighbours": op12_neighbours,
    "op13_clusters": op13_clusters,
}

_HOST = "coalesce(translate(regexp_extract({0}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '')"
_BARE = "regexp_replace({0}, '(?s)#.*$', '')"
_ALIAS = "CASE WHEN contains({0}, '://') THEN split_part(" + _BARE + ", '://', 1) || '://' || " + _HOST.format(_BARE) + " || regexp_extract(" + _BARE + ", '(?s)://[^/?#]*(.*)$', 1) END"
_ATTRIBUTE = r"""([^\s"''>/=]+)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+))?"""


def _attribute_sql(name: str) -> str:
    value = f"regexp_extract_all(tag, '{_ATTRIBUTE}', 2)[nullif(list_position(list_transform(regexp_extract_all(tag, '{_ATTRIBUTE}', 1), lambda x: lower(x)), '{name}'), 0)]"
    return f"""trim(regexp_replace(regexp_replace({value}, '^["'']|["'']$', '', 'g'), '(?i)&(amp|#38|#x26);', '&', 'g'))"""


def _resolve_sql(base: str, target: str) -> str:
    """The address of a link: segments are folded one by one, the last one apart."""
    root, own = f"regexp_extract({base}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    path, rest = f"regexp_extract({target}, '(?s)^[^?#]*')", f"regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1)"
    whole = f"CASE WHEN starts_with({path}, '/') THEN {path} ELSE CASE WHEN {own} = '' THEN '/' ELSE regexp_replace({own}, '[^/]*$', '') END || {path} END"
    parts = f"string_split({whole}, '/')[2:]"
    flat = f"list_reduce(list_prepend([''], list_transform({parts}, lambda x: [x])), lambda acc, x: CASE x[1] WHEN '.' THEN acc WHEN '..' THEN CASE WHEN len(acc) > 1 THEN acc[:len(acc) - 1] ELSE acc END ELSE list_append(acc, x[1]) END)"
    dotted = f"array_to_string({flat}, '/')"
    path_sql = f"CASE WHEN {dotted} = '' THEN '/' WHEN {parts}[-1] IN ('.', '..') THEN {dotted} || '/' ELSE {dotted} END"
    return f"""CASE WHEN {target} IS NULL OR {target} = '' OR starts_with({target}, '#') THEN NULL WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target} END
        WHEN {root} = '' THEN NULL WHEN starts_with({target}, '//') THEN split_part({root}, '://', 1) || ':' || {target} WHEN {path} = '' THEN {root} || {own} || {rest} ELSE {root} || {path_sql} || {rest} END"""


_RULE = "CASE " + " ".join(
    f"WHEN ({{0}} = '{h}' OR ends_with({{0}}, '.{h}')) AND starts_with({{1}}, '{p}') THEN '{v} {h}{p}'"
    for v, h, p in sorted((url_filter.parse_rule(r) for r in RULES), key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
) + " END"


def _mix_sql() -> str:
    weights = ", ".join(f"({len(k)}, '{'/'.join(k)}', {w})" for k, w in MIX_WEIGHTS.items())
    names = ["domain", "lang", "source"]
    parts = []
    for depth in (1, 2, 3):
        keys = ", ".join(names[:depth])
        up = ", ".join(names[: depth - 1]) or "0"
        path = " || '/' || ".join(names[:depth])
        budget = f"(SELECT floor({MIX_SHARE}::DOUBLE * sum(available))::BIGINT FROM leaves)" if depth == 1 else "budget"
        source = "leaves" if depth == 1 else f"leaves JOIN s{depth - 1} USING ({', '.join(names[: depth - 1])})"
        group = keys if depth == 1 else f"{keys}, budget"
        before = f"(PARTITION BY {up} ORDER BY capacity / weight, {names[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(f"""n{depth} AS (
    SELECT {keys}, sum(available * {MIX_EPOCHS})::BIGINT AS capacity, coalesce(max(w), 1) AS weight, {budget} AS budget
    FROM {source} LEFT JOIN weights ON depth = {depth} AND path = {path} GROUP BY {group}
), f{depth} AS (
    SELECT *, capacity * (sum(weight) OVER (PARTITION BY {up}) - coalesce(sum(weight) OVER {before}, 0)) <= weight * (budget - coalesce(sum(capacity) OVER {before}, 0)) AS isfull FROM n{depth} WHERE weight > 0
), g{depth} AS (
    SELECT *, budget - coalesce(sum(capacity) FILTER (isfull) OVER (PARTITION BY {up}), 0) AS rest, sum(weight) FILTER (NOT isfull) OVER (PARTITION BY {up}) AS opened,
        sum(weight) FILTER (NOT isfull) OVER (PARTITION BY {up} ORDER BY md5({names[depth - 1]}) ROWS UNBOUNDED PRECEDING) AS upto FROM f{depth}
), s{depth} AS (
    SELECT {keys}, CASE WHEN isfull THEN capacity ELSE (upto::HUGEINT * rest::HUGEINT) // opened::HUGEINT - ((upto - weight)::HUGEINT * rest::HUGEINT) // opened::HUGEINT END::BIGINT AS budget FROM g{depth}
)""")
    return f"""
WITH weights(depth, path, w) AS (VALUES {weights}), docs AS (
    SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents
), known AS (SELECT * FROM docs WHERE tokens > 0 AND doc_id IS NOT NULL),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS available FROM known GROUP BY ALL),
{", ".join(parts)}, taken AS (
    SELECT *, budget // available AS whole, budget % available AS part FROM known JOIN s3 USING (domain, lang, source) JOIN leaves USING (domain, lang, source) WHERE budget > 0
), placed AS (
    SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || whole::VARCHAR || ':' || doc_id::VARCHAR), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM taken
)
SELECT doc_id, domain, lang, source, unnest(range(whole))::INT AS epoch, tokens AS doc_tokens, tokens AS taken FROM taken
UNION ALL
SELECT doc_id, domain, lang, source, whole::INT AS epoch, tokens AS doc_tokens, least(tokens, part - start)::BIGINT AS taken FROM placed WHERE start < part
"""


SQL: dict[str, str] = {
    "op1_url_filter": f"""
WITH RECURSIVE clean AS (
    SELECT url AS source, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g') AS html
    FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')
), lists AS (SELECT source, regexp_extract_all(html, '(?is)<(?:link|meta|base)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS tags FROM clean),
tags AS (SELECT row_number() OVER () AS row, source, tags FROM lists),
parts AS (SELECT row, source, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM tags),
read AS (
    SELECT row, source, pos, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) AS kind, {_attribute_sql("href")} AS href, {_attribute_sql("rel")} AS rel, {_attribute_sql("http-equiv")} AS equiv, {_attribute_sql("content")} AS content FROM parts
), bases AS (SELECT row, min_by(href, pos) AS href FROM read WHERE kind = 'base' AND href IS NOT NULL GROUP BY 1),
based AS (SELECT r.*, coalesce({_resolve_sql("r.source", "b.href")}, r.source) AS base FROM read r LEFT JOIN bases b USING (row)),
leads AS (
    SELECT source, base, CASE WHEN kind = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\\s+'), 'canonical') THEN href
        WHEN kind = 'meta' AND lower(equiv) = 'refresh' THEN trim(regexp_extract(content, '(?is)^\\s*(?:[\\d.]+[\\s;,]+(?:url\\s*=\\s*)?|url\\s*=\\s*)["'']?([^"'']*)', 1)) END AS goal FROM based
), links AS (SELECT source, {_resolve_sql("base", "goal")} AS target FROM leads WHERE goal <> ''),
named AS (SELECT {_ALIAS.format("source")} AS a, {_ALIAS.format("target")} AS b FROM links WHERE target IS NOT NULL),
edges AS (SELECT a, b FROM named WHERE a <> b UNION SELECT b, a FROM named WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
blocked AS (SELECT DISTINCT a FROM reach WHERE {_RULE.format(_HOST.format("b"), _PATH.format("b"))} LIKE 'block %'),
judged AS (SELECT page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_ALIAS.format("url")} AS name FROM pages),
matched AS (SELECT *, {_RULE.format("host", "path")} AS found FROM judged)
SELECT page_id, host, path, split_part(found, ' ', 2) AS rule, coalesce(split_part(found, ' ', 1), CASE WHEN b.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM matched m LEFT JOIN blocked b ON m.name = b.a
""",
    "op6_warc_zip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(CASE WHEN payload_bytes >= 1000 THEN page_id END) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS DISTINCT FROM page_id AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to FROM k
""",
    "op7_mixing": _mix_sql(),
    "op8_minhash": """
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
""",
    "op10_embeddings": """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1), deg AS (SELECT a AS vec_id, count(*) AS k FROM edges GROUP BY 1)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN low USING (vec_id) LEFT JOIN deg USING (vec_id)
""",
    "op4_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}

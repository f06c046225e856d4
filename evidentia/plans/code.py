"""Queries over source files: documents with pieces of source code added, so that signals fire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.catalog import caps_sql, values_sql
from ..operators import code as C
from ..operators import scoring
from ..operators.pages import spread
from .repositories import report_sql

#: (every k-th document, remainder, lines that are put before its text)
PIECES = [
    (2, 0, ["// TODO: implement this", "const password = 'abcdef123';", "// see PROJ-12 because of safari"]),
    (3, 1, ["/* ---- Helpers ---- */", "/* ==== Data ==== */", "try {", "} catch (e) {}", "try {", "} catch (e) {}", "try {", "} catch (e) {}"]),
    (4, 2, ["console.log('a');"] * 8),
    (5, 3, ["# sure, here's a helper", "def foo():", "    raise NotImplementedError"]),
    (6, 4, ["/*", " * magic, sorry", "", " */ after", "int x = 1; // somehow used"]),
    (7, 5, ["\tif (a) {", "\t} else {", "\t}", " b", " c", " d"] * 7),
    (37, 0, ["// 🚀 launch the rocket", "console.log('🚀 started');"]),
    (37, 1, ["/**", " * This module handles the billing of all orders and provides their totals.", " */", "const total = 1;"]),
    (37, 2, ["// step of the plan", "x = 1;"] * 60),
    (37, 3, [x for i in range(1, 5) for x in ("/**", f" * Gets number {i}.", " */", f"function number{i}() {{", f"return {i}; }}")]),
    (37, 4, ["fetch('https://api.example.com/v1/orders');", " * @param userName - the user name", " * @param {string} orderId the order id", " * @param value - value to use"]),
    (37, 5, ["const userName = a, orderTotal = b, itemCount = c, user_name = d, order_total = e;", "user['name'] = user.name;", "f('aa', \"bb\"); f('cc', \"dd\"); f('ee', \"ff\"); f('gg', \"hh\"); f('ii', \"jj\");"]),
    (37, 6, ["a?.b; c?.d; e?.f; g?.h; i?.j; k?.l; m ?? n; o ?? p; q ?? r;"]),
    (37, 7, ["throw new Error('The value is not valid here.');", "throw new Error(\"Please note that it cannot be done.\");"]),
    (37, 8, ["let calculateTotalPriceForEachOrderLine = 1;", "let validateUserInputBeforeSaving = 2;", "let data1 = 1, result2 = 2, value_final = 3;", "let cfgMain = 1, svcName = 2, idxLast = 3, userRepo = 4;"]),
    (37, 9, ["const data = 1;", "const item = 2;", "function result() {}", "function processData() {}"]),
    (37, 10, ["class StringUtils {}", "class OrderManager {}", "class ViewHelper {}", "const createToggleFactory = () => ({ enabled: true });"]),
    (37, 11, ["it('works', () => {", "  expect(true).toBe(true);", "  })", "describe('x')"]),
    (37, 12, ["import a1 from 'a'", "import b1 from 'b'", "import c1 from 'c'", "import d1 from 'd'", "import e1 from 'e'", "import f1 from 'f'", "import { g1 as h1, i1 } from 'g'"]),
    (37, 13, ["axios.get(1); fetch(2); moment(3); dayjs(4);", "uuid(); nanoid();"]),
    (37, 14, ["import os", "class Thing:", "    pass", "def main():", "    self.x = 1", "if __name__ == '__main__':", "    main()"]),
    (37, 15, ["function unusedThing() {}", "function otherThing() {}", "const lastThing = 1;", "export function publicThing() {}"]),
    (37, 16, ["requests.get(u, verify=False)", "jwt.sign(payload);", "$(document).ready(f);"]),
    (37, 17, ["it’s one — line", "it’s another", "// if (a) {", "// b = c;", "// return d;", "// increment counter", "counter += 1;", "// update total value", "total = value;", "// store result", "result = store(x);"]),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [F.when(F.col("doc_id") % k == r, F.lit("\n".join(x) + "\n")).otherwise("") for k, r, x in PIECES]
    return d.select(F.col("doc_id").alias("subject_id"), F.concat(*extra, "text").alias("src"))


def code_comment_lines(spark, sf_dir):
    """How many lines and comments each file has."""
    rows = C.with_lines(C.sources(spread(files(spark, sf_dir))))
    return rows.select("subject_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: x["comment"].isNotNull())).cast("long").alias("comments"), F.size(F.filter("lines", lambda x: x["line"].startswith("\t"))).cast("long").alias("tabs"))


def code_line_features(spark, sf_dir):
    return C.line_features(C.with_lines(C.sources(spread(files(spark, sf_dir))))).select("subject_id", *[F.col(c).cast("long").alias(c) for c in ("banners", "chatter", "informal", "tickets", "stubs", "spaces")])


def code_source_features(spark, sf_dir):
    f = C.source_features(C.sources(spread(files(spark, sf_dir))))
    return f.select("subject_id", "tries", "swallowed", "logs", "secrets", "ifs", "elses", "solutions", "helpers")


def code_single_use(spark, sf_dir):
    return C.single_use(C.sources(spread(files(spark, sf_dir)))).select("subject_id", "declares", "dead_imports", "dead_names")


def code_hits(spark, sf_dir):
    return C.fired(C.features(files(spark, sf_dir))).select("subject_id", "signal_id")


def code_notes(spark, sf_dir):
    """What a reader should know of how each file was read."""
    rows = C.sources(files(spark, sf_dir)).select("subject_id", F.size(F.split("src", "\n")).alias("n_lines"))
    return C.notes(rows).withColumn("notes", F.array_join("notes", ","))


def code_reports(spark, sf_dir):
    """Score, verdict and confidence of every file."""
    thin = files(spark, sf_dir).select("subject_id", (F.size(F.split(F.regexp_replace(F.coalesce("src", F.lit("")), r"\r\n?", "\n"), "\n")) < C.THIN_LINES).alias("thin"))
    return scoring.reports(C.fired(C.features(files(spark, sf_dir))), thin).drop("signals", "thin", "fingerprint")


QUERIES = {f.__name__: f for f in (code_comment_lines, code_line_features, code_source_features, code_single_use, code_hits, code_notes, code_reports)}


def _q(p: str) -> str:
    return p.replace("'", "''")


_SRC = "s AS (SELECT doc_id AS subject_id, " + " || ".join(f"CASE WHEN doc_id % {k} = {r} THEN '{_q(chr(10).join(x) + chr(10))}' ELSE '' END" for k, r, x in PIECES) + " || text AS src FROM documents)"
_LINES = r"""l0 AS (SELECT subject_id, unnest(range(len(string_split(src, chr(10))))) AS ln, unnest(string_split(src, chr(10))) AS line FROM s), l1 AS (SELECT *, regexp_replace(line, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g') AS t FROM l0),
l2 AS (SELECT *, coalesce(max(CASE WHEN starts_with(t, '/*') AND NOT contains(t, '*/') THEN ln END) OVER w, -1) > coalesce(max(CASE WHEN contains(t, '*/') THEN ln END) OVER w, -1) AS inside FROM l1
    WINDOW w AS (PARTITION BY subject_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN inside OR starts_with(t, '/*') OR regexp_matches(t, '^(?://|#(?:[^!]|$|!(?:[^\[]|$))|\*|<!--|--\s)') THEN t
    WHEN regexp_matches(line, '\S\s+(?://[^\n]{3,}|#[^\n]{3,})$') THEN regexp_extract(line, '\S\s+(//[^\n]{3,}|#[^\n]{3,})$', 1) END AS comment FROM l2)"""
_F = lambda cond: f"count(*) FILTER ({cond})"
_M = lambda s, p: f"regexp_matches({s}, '{_q(p)}')"
_N = lambda p: f"len(regexp_extract_all(src, '{_q(p)}'))::INT"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g')"


def _parts(x: str, least: int) -> str:
    """Lower-case words of more than ``least`` characters."""
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > {least})"


def _split(x: str) -> str:
    return rf"translate(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_-', '  ')"


def _sum(patterns: list[str]) -> str:
    return "(" + " + ".join(_N(p) for p in patterns) + ")"


def _all(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(src, '{_q(pattern)}', {group})"


def _some(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(_M(x, p) for p in patterns) + ")"


_COMMENTED = r"regexp_matches(t, '^(?://|#(?:[^!]|$|!(?:[^\[]|$))|\*|<!--|--\s)')"
_WHY = lambda x: f"({_M(x, T.WHY_WORDS)} OR {_M(x, T.WHY_MARKS)})"
_METHOD = _q(C._METHOD)
_ABOVE = r"^(?:\*/|///|#''|" + '"' * 3 + "|" + "'" * 6 + ")"
_DECLARES = rf"(regexp_matches(line, '\b(?:function|def|func|fn)\s+\w+\s*\(') OR regexp_matches(line, '\b(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>)') OR (regexp_extract(line, '{_METHOD}', 1) <> '' AND lower(regexp_extract(line, '{_METHOD}', 1)) NOT IN ({', '.join(f"'{w}'" for w in C.NOT_METHODS)})))"
_CODE = lambda k: f"CASE WHEN lead(t, {k}) OVER w <> '' AND NOT lead(marked, {k}) OVER w THEN lead(t, {k}) OVER w END"
_LINE = rf"""m AS (SELECT *, {_COMMENTED} AS marked FROM l), q0 AS (
    SELECT *, coalesce({_CODE(1)}, {_CODE(2)}, {_CODE(3)}) AS near, coalesce(nullif(lag(t, 1) OVER w, ''), nullif(lag(t, 2) OVER w, ''), nullif(lag(t, 3) OVER w, '')) AS above, lead(t) OVER w AS after, count(*) OVER (PARTITION BY subject_id) AS n,
        {_trim(r"regexp_replace(regexp_replace(comment, '^\s*(?://+|#+|/\*+|\*+|<!--|--)\s*', ''), '(?:\*/|-->)\s*$', '')")} AS body, {_trim(r"regexp_replace(comment, '^\s*(?://+|#+|/\*+|\*+)\s*', '')")} AS off, {_DECLARES} AS declares FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY ln)
), q AS (SELECT *, declares AND coalesce(regexp_matches(above, '{_ABOVE}'), false) AS documented, regexp_matches(line, '^\s*(?:import\s+|from\s+\S+\s+import\s+|use\s+[A-Z])') AS imports, least(7, floor(ln / ceil(n / 8)))::INT AS eighth FROM q0),
f AS (
    SELECT subject_id, count(*) AS n_lines, count(comment) AS comments, {_F(f"regexp_matches(comment, '{T.EMOJI_OR_ARROW}')")} AS emoji_comments, {_F(_M('comment', C.BANNER))} AS banners, {_F(_M('comment', C.CHATTER))} AS chatter, {_F(_WHY('comment'))} AS why,
        {_F(_M('comment', C.TICKETS))} AS tickets, {_F(_M('comment', C.INFORMAL))} AS informal, {_F(f"body <> '' AND strlen(body) <= 90 AND NOT {_WHY('body')} AND {_M('body', C.IMPERATIVE)} AND list_has_any({_parts('body', 3)}, {_parts(_split('near'), 2)})")} AS what_comments,
        {_F(r"off <> '' AND ((regexp_matches(off, '[;{}]\s*$') AND regexp_matches(off, '[=(]')) OR regexp_matches(off, '^(?:(?:if|for|while|return|const|let|var|def|print|echo)\b|\$\w+\s*=\b)') OR regexp_matches(off, '(?i)^[a-z_$][\w.$]*\([^()]*\)\s*;?(?:\s|$)'))")} AS switched_off,
        {_F("declares")} AS declared, {_F("documented")} AS documented, {_F(r"documented AND regexp_matches(after, '^(?:return|\$this->|self::)')")} AS trivial, {_F("starts_with(line, chr(9))")} AS tabs, {_F("starts_with(line, ' ')")} AS spaces, {_F(_some('line', C.TODO))} AS stubs, {_F("regexp_matches(line, '[‘’“”—]')")} AS typography,
        [{', '.join(_F(f'comment IS NOT NULL AND eighth = {k}') for k in range(8))}] AS eighths, list({{'ln': ln, 't': lower(t)}} ORDER BY ln) FILTER (imports) AS imports, string_agg(line, chr(10) ORDER BY ln) FILTER (ln < 12) AS head FROM q GROUP BY 1
)"""
_WORDS = rf"""w AS (SELECT subject_id, x, count(*) AS uses FROM (SELECT subject_id, unnest(regexp_extract_all(src, '\w+')) AS x FROM s) GROUP BY ALL),
names AS (SELECT subject_id, list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(src, '(?m)^\s*import\s+(\w+)\s+from', 1), flatten(list_transform(regexp_extract_all(src, '(?m)^\s*import\s+\{{([^}}]+)\}}\s+from', 1), lambda x: string_split(x, ',')))), lambda x: {_trim(f"regexp_replace({_trim('x')}, '[ \t\r\n]+as[ \t\r\n]+.*$', '')")}), lambda x: length(x) >= 2)) AS imported,
    list_filter(list_distinct(regexp_extract_all(src, '\b(?:function|def|const|class)\s+([A-Za-z_]\w{{3,}})', 1)), lambda x: NOT regexp_matches(x, '{_q(C.SMALL_NAMES)}') AND NOT list_contains(flatten(list_transform(regexp_extract_all(src, '\b(?:export|module\.exports|public)\b[^\n]*'), lambda y: regexp_extract_all(y, '\w+'))), x)) AS declared,
    regexp_matches(src, '\b(?:function|def|const|class)\s+[A-Za-z_]\w{{3,}}') AS declares FROM s),
asked AS (SELECT subject_id, 'i' AS kind, unnest(imported) AS x FROM names UNION ALL SELECT subject_id, 'd' AS kind, unnest(declared) AS x FROM names),
used AS (SELECT a.subject_id, count(*) FILTER (kind = 'i' AND coalesce(uses, 0) <= 1) AS i, count(*) FILTER (kind = 'd' AND uses = 1) AS d FROM asked a LEFT JOIN w USING (subject_id, x) GROUP BY 1),
single AS (SELECT n.subject_id, n.declares, coalesce(i, 0)::INT AS dead_imports, coalesce(d, 0)::INT AS dead_names FROM names n LEFT JOIN used u USING (subject_id))"""
_IDENTS = _all(r"\b([a-z][a-zA-Z0-9_]{2,})\b")
_PIECES = lambda x: f"len(list_filter(string_split({_split(x)}, ' '), lambda v: v NOT IN ('', '0')))"
_LANGUAGE = f"CASE WHEN greatest({', '.join(_N(p) for p in T.CODE_LANGUAGES.values())}) = 0 THEN 'unknown' " + " ".join(f"WHEN {_N(p)} = greatest({', '.join(_N(x) for x in T.CODE_LANGUAGES.values())}) THEN '{name}'" for name, p in T.CODE_LANGUAGES.items()) + " END"
_SINGLE, _DOUBLE = _N(r"(?:^|[^\\\w])'[^'\n]{2,40}'"), _N('(?:^|[^\\\\\\w])"[^"\\n]{2,40}"')
_VAGUE = " + ".join(_M("src", rf"(?i)\b(?:const|let|var|function|def)\s*{w}\b|\$\s*{w}\b|\b(?:for|foreach)\s*\(\s*(?:const|let|var)?\s*{w}\b") + "::INT" for w in C.VAGUE)
_SOLUTIONS = " + ".join(f"CASE WHEN {n} >= 3 THEN 3 WHEN {n} >= 2 THEN 1 ELSE 0 END" for n in (f"({' + '.join(f"contains(src, '{m}')::INT" for m in ms)})" for ms in C.FAMILIES.values()))
_NAME, _TEXT = _all(r"(?i)@param\s+(?:\{[^}]*\}\s+)?\$?(\w+)\s*[-:]?\s*[^\n*]{4,90}"), _all(r"(?i)@param\s+(?:\{[^}]*\}\s+)?\$?\w+\s*[-:]?\s*([^\n*]{4,90})")
_SOURCE = rf"""g0 AS (SELECT subject_id, src, {_LANGUAGE} AS lang, list_distinct({_IDENTS}) AS idents, {_NAME} AS pn, {_TEXT} AS pt, list_transform({_all(C.CEREMONY)}, lambda b: regexp_replace(b, '{_q(C.NEXT_DECLARATION)}', '')) AS bodies FROM s),
g1 AS (SELECT *, list_filter(idents, lambda x: strlen(x) >= 20 AND {_PIECES('x')} >= 4) AS long FROM g0), g AS (
    SELECT subject_id, src, lang, len(long) AS wordy, len(list_filter(long, lambda x: strlen(x) >= 28 AND {_PIECES('x')} >= 5)) AS egregious, len(list_filter(idents, lambda x: {_some('x', C.LAZY)})) AS lazy, len(list_filter(idents, lambda x: {_some('x', C.ABBREVIATED)})) AS abbreviated,
        {_N(r'\btry\s*[:{]')} AS tries, greatest(1, {_N(r'\b(?:function|def|func)\s+\w+')}) AS functions, {_sum(C.SWALLOWED)} AS swallowed, {_N(r'\bconsole\.(?:log|debug|info)\s*\(')} + {_N(r'\b(?:var_dump|print_r|error_log)\s*\(')} AS logs,
        len(list_filter({_all(C.LOG_TEXT)}, lambda x: regexp_matches(x, '{T.EMOJI_OR_ARROW}'))) AS emoji_logs, {_N(r'\?\.')} + {_N(r'\?\?')} AS chains, greatest(1, {_N(r'[a-zA-Z_$)\]]\s*\.\s*[a-zA-Z_$]')}) AS accesses, {_N(r'(?:^|[^\w$])if\s*\(')} AS ifs, {_N(r'(?:^|[^\w$])else\b')} AS elses,
        len(list_filter({_all(C.FORMAL)}, lambda x: {_M('x', C.MODAL)})) AS formal, {_sum(C.ENDPOINTS)} AS endpoints,
        len(list_filter(range(1, len(pn) + 1), lambda i: list_has_any({_parts(_split('pn[i]'), 2)}, regexp_split_to_array(lower({_trim('pt[i]')}), '[^a-z0-9]+')) OR {_M(f"lower({_trim('pt[i]')})", C.FILLER)})) AS tautologies,
        {_SOLUTIONS} AS solutions, {_VAGUE} AS vague, {_N(C.VAGUE_FUNCTION)} AS vague_functions, len(list_distinct({_all(C.HELPER)})) AS helpers, len(list_filter(bodies, lambda b: {_M('b', C.BOOLEAN_BODY)} AND NOT {_M('b', C.FLOW)})) + {_N(C.BOOLEAN_MEMO)} AS ceremony,
        (lang NOT IN ('python', 'php', 'sql') AND len(list_distinct({_all(r'\b([a-z]+[A-Z][a-zA-Z0-9]*)\b')})) >= 3 AND len(list_distinct({_all(r'\b([a-z]+_[a-z][a-z0-9_]*)\b')})) >= 2)::INT + list_has_any({_all('(\\w+)\\[["\']\\w+["\']\\]')}, {_all(r'\b(\w+)\.\w')})::INT
            + (lang IN ('javascript', 'typescript', 'jsx') AND {_SINGLE} + {_DOUBLE} >= 8 AND least({_SINGLE}, {_DOUBLE}) / greatest(1, {_SINGLE} + {_DOUBLE}) > 0.25)::INT AS mixed,
        {_M('src', C.IS_TEST)} AS tests, {_sum(C.HOLLOW)} + len(list_filter({_all(C.TEST_BODY)}, lambda b: NOT regexp_matches(b, '\b(?:expect|assert|should)\b'))) AS hollow, {_N(C.NEGATIVE)} AS negatives, {_N(r'\b(?:expect|assert\w*)\s*\(')} AS assertions, {_sum(C.SECRETS)} AS secrets, {_some('src', C.INSECURE)} AS insecure,
        (regexp_matches(src, '(?i)\b(?:jwt|sign)\s*\(') AND NOT regexp_matches(src, '(?i)\b(?:expiresIn|exp\b|setExpiration|ttl|expires_at)')) OR (regexp_matches(src, '(?i)(?:params|query|body|\$_GET|\$_POST)\s*\[?[''"]?(?:id|user_?id|order_?id)') AND regexp_matches(src, '(?i)\b(?:findById|findOne|SELECT|->find\(|get\()')
            AND NOT regexp_matches(src, '(?i)\b(?:user_?id\s*[=:]{{1,2}}\s*(?:\$?(?:current|auth|session|req)\w*)|owner|belongs_?to|->user_?id|can\(|authorize|abort\(403|403\b)')) AS weak_auth,
        {_M('src', C.LEGACY)} AS legacy, lang = 'python' AND regexp_matches(src, 'if\s+__name__\s*==\s*[''"]__main__[''"]\s*:') AND (regexp_matches(src, '__main__[''"]\s*:\s*\n\s*(?:pass|print\(|main\(\)\s*$)') OR regexp_matches(src, '\bclass\s+\w+')) AS main_guard FROM g1
)"""
#: SQL of every signal of source files, over the numbers of lines (f), of the whole text (g) and of names used once.
_RULES = {
    "cd.emoji_comments": "emoji_comments >= 1", "cd.section_header_comments": "banners >= 2", "cd.what_comments": "what_comments >= 3",
    "st.file_header_block": f"""regexp_matches(head, '^\\s*(?:/\\*\\*|{'"' * 3}|{"'" * 6}|//|#)') AND {_M('head', C.PURPOSE)} AND strlen({_trim('head')}) > 60""",
    "st.uniform_comment_density": "n_lines >= 80 AND comments >= 8 AND list_avg(eighths) >= 0.8 AND list_min(eighths) > 0 AND list_stddev_pop(eighths) < 0.45 * list_avg(eighths)",
    "st.docblock_on_everything": "declared >= 4 AND documented >= declared AND trivial >= 1", "cd.assistant_chatter": "chatter >= 1", "cd.placeholder_endpoint": "endpoints >= 1", "cd.tautological_params": "tautologies >= 2", "cd.mixed_conventions": "mixed >= 2",
    "cd.blanket_try": "tries >= 3 AND tries >= functions * 0.7", "cd.swallowed_errors": "swallowed >= 2", "cd.console_noise": "logs >= 5 AND logs * 100 >= 2 * n_lines", "cd.emoji_logging": "emoji_logs >= 1", "cd.defensive_chaining": "chains >= 8 AND chains > 0.28 * accesses",
    "cd.over_symmetric_branches": "ifs >= 5 AND elses >= 0.85 * ifs", "cd.formal_errors": "formal >= 2", "cd.verbose_names": "wordy >= 2 OR egregious >= 1", "cd.lazy_names": "lazy >= 2", "cd.generic_domain_names": "vague >= 3 OR (vague_functions >= 1 AND vague >= 1)",
    "cd.helper_pileup": "helpers >= 3", "cd.ceremony_for_nothing": "ceremony >= 1", "hu.abbrevs": "abbreviated >= 3", "cd.empty_tests": "tests AND (hollow >= 1 OR (assertions >= 6 AND negatives = 0))",
    "st.import_block_sorted": "len(imports) >= 6 AND imports[-1].ln - imports[1].ln <= len(imports) + 3 AND len(list_filter(range(2, len(imports) + 1), lambda i: imports[i - 1].t <= imports[i].t)) >= 0.85 * (len(imports) - 1)",
    "st.multiple_solutions": "solutions >= 2", "cd.todo_placeholders": "stubs >= 1", "cd.main_guard": "main_guard", "st.dead_code": "CASE WHEN declares THEN dead_imports + dead_names >= 3 ELSE dead_imports >= 2 END", "se.placeholder_secret": "secrets >= 1", "se.insecure_defaults": "insecure", "se.weak_auth": "weak_auth",
    "cd.typography": "typography >= 2", "hu.why_comments": "why >= 1", "hu.ticket_refs": "tickets >= 1", "hu.informal": "informal >= 1", "hu.commented_code": "switched_off >= 2", "hu.inconsistent_format": "tabs > 2 AND spaces > 2 AND n_lines > 30", "hu.legacy_stack": "legacy",
}
_HITS = f"{_SRC}, {_LINES}, {_LINE}, {_WORDS}, {_SOURCE}, j AS MATERIALIZED (SELECT * FROM f JOIN g USING (subject_id) JOIN single USING (subject_id)), hits AS ({' UNION ALL '.join(f"SELECT subject_id, '{n}' AS signal_id FROM j WHERE {r}" for n, r in _RULES.items())})"
_TOTALS = f"""{_HITS}, known AS (SELECT subject_id, k.* FROM hits JOIN {values_sql()} k USING (signal_id)), totals AS (SELECT subject_id, category, direction, sum(weight) AS total FROM known GROUP BY ALL),
capped AS (SELECT t.*, CASE WHEN cap IS NULL THEN total ELSE least(total, cap) END AS capped FROM totals t JOIN {caps_sql()} USING (category))"""
SQL = {
    "code_comment_lines": f"WITH {_SRC}, {_LINES} SELECT subject_id, count(*) AS n_lines, count(comment) AS comments, count(*) FILTER (starts_with(line, chr(9))) AS tabs FROM l GROUP BY 1",
    "code_line_features": f"WITH {_SRC}, {_LINES} SELECT subject_id, {_F(_M('comment', C.BANNER))} AS banners, {_F(_M('comment', C.CHATTER))} AS chatter, {_F(_M('comment', C.INFORMAL))} AS informal, {_F(_M('comment', C.TICKETS))} AS tickets, {_F(' OR '.join(_M('line', p) for p in C.TODO))} AS stubs, {_F("starts_with(line, ' ')")} AS spaces FROM l GROUP BY 1",
    "code_source_features": f"WITH {_SRC} SELECT subject_id, {_N(r'\btry\s*[:{]')} AS tries, ({' + '.join(_N(p) for p in C.SWALLOWED)})::INT AS swallowed, ({_N(r'\bconsole\.(?:log|debug|info)\s*\(')} + {_N(r'\b(?:var_dump|print_r|error_log)\s*\(')})::INT AS logs, ({' + '.join(_N(p) for p in C.SECRETS)})::INT AS secrets, "
    + f"{_N(r'(?:^|[^\w$])if\s*\(')} AS ifs, {_N(r'(?:^|[^\w$])else\b')} AS elses, ("
    + " + ".join(f"CASE WHEN {n} >= 3 THEN 3 WHEN {n} >= 2 THEN 1 ELSE 0 END" for n in (f"({' + '.join(f"contains(src, '{m}')::INT" for m in ms)})" for ms in C.FAMILIES.values()))
    + f")::INT AS solutions, len(list_distinct(regexp_extract_all(src, '{_q(C.HELPER)}', 1)))::INT AS helpers FROM s",
    "code_single_use": f"WITH {_SRC}, {_WORDS} SELECT * FROM single",
    "code_notes": f"WITH {_SRC} SELECT subject_id, CASE WHEN length(src) - length(replace(src, chr(10), '')) < 24 THEN 'short_sample,no_history' ELSE 'no_history' END AS notes FROM s",
    "code_hits": f"WITH {_HITS} SELECT subject_id, signal_id FROM hits",
    "code_reports": report_sql(_TOTALS, "(SELECT subject_id, n_lines < 25 AS thin FROM f)", "subject_id"),
}

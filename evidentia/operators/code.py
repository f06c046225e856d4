"""Source files: signals from comments, naming, error handling, tests, structure and security.

A file stays one row: its lines are an array, and whether a line is in a block comment, the comment above a declaration
and the code below a comment are expressions over the array, so nothing is shuffled and repeated ids do no harm.
fired() gives one row per file and signal with evidence; the numbers behind them are columns of features().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import spread
from ..functions.guards import fold, led, seen
from ..functions.text import detect_code_language, has_emoji, identifier_words, is_comment_line, looks_like_why, once, split_identifiers

# What the rules look for.
BANNER = r"(?:={3,}|-{3,}|\*{3,}|_{3,})\s*[A-Za-z][^=\-*_]{2,40}\s*(?:={3,}|-{3,}|\*{3,}|_{3,})"
IMPERATIVE = (
    r"(?i)^(?:set|get|gets|sets|increment|decrement|initiali[sz]e|initiali[sz]ing|loop through|iterate|check if|checks if|return|returns|create|creates|define|defines|import|imports|add|adds|"
    r"remove|removes|update|updates|handle|handles|convert|converts|calculate|calculates|store|stores|fetch|fetches|declare|assign|call|render|display|print|log|start|stop|close|open|read|write|"
    r"parse|validate|clear|reset|build|make|find|filter|map|sort|save|load|send|wait|apply|extract|format|generate|setup|configure|register|toggle|show|hide|enable|disable)\b"
)
CHATTER = (
    r"(?i)(?:sure[,!]|certainly[,!]|of course[,!]|absolutely[,!]|great question|here'?s (?:a|the|how|an) |here is (?:a|the|an) |let'?s (?:start|begin|create|build|add|make|fetch|define|write|go|dive|take a look)|"
    r"i'?(?:ve|ll) (?:added|created|updated|refactored|implemented|assumed|used)|feel free to|hope this helps|let me know if|you (?:can|should|may want to|might want to) (?:adjust|replace|customi|modify|change)|"
    r"(?:comprehensive|production-ready|fully functional|robust) (?:solution|implementation|example|service)|as (?:an? )?(?:ai|assistant|language model))"
)
PURPOSE = r"(?i)\b(?:this (?:file|module|class|script)|handles|responsible for|provides|contains|implements)\b"
ENDPOINTS = [
    r"(?i)https?://(?:api\.)?(?:example|yourdomain|your-domain|yoursite|mysite)\.(?:com|org|net)[^\s\"'`<]*",
    r"[\"'`](?:https?://)?(?:YOUR|MY)[_-]?(?:API|BASE|SERVER)?[_-]?(?:URL|ENDPOINT|DOMAIN|HOST)[^\"'`]*[\"'`]",
    r"<(?:YOUR|MY)[_-][A-Z_]+>",
    r"(?i)(?://|#)\s*(?:TODO:?\s*)?(?:add|replace|put|insert)\s+your\s+(?:api\s+)?(?:endpoint|url|key|token|domain)",
]
FILLER = r"^(?:the |a |an )?(?:first |second |third |input |given |provided )?(?:number|string|value|object|array|item|param|parameter|argument|data)\b"
SWALLOWED = [
    r"catch\s*\([^)]*\)\s*\{\s*(?:console\.(?:error|log|warn)\([^)]*\);?\s*)?\}",
    r"except[^\n:]*:\s*\n\s*pass",
    r"(?s)catch\s*\([^)]*\)\s*\{\s*(?://[^\n]*|/\*.*?\*/)?\s*\}",
    r"catch\s*\([^)]*\)\s*\{\s*return\s+(?:null|false|undefined|\[\]|\{\})\s*;?\s*\}",
]
FORMAL = r"[\"']((?:The|An?|Your|This|Please)\s+[^\"']{18,120}\.)[\"']"
MODAL = r"(?i)\b(?:is|are|was|were|must|cannot|could not|does not|has not|should)\b"
LOG_TEXT = r"(?:console\.\w+|print|println|printf|echo|logger?\.\w+|log)\s*\(\s*[`'\"]([^`'\"]{0,120})"
LAZY = [
    r"(?i)^(?:data|result|response|res|temp|tmp|item|value|arr|obj|list|output|input|handler|handle\w*|new\w*|final\w*|test|foo|bar)\d$",
    r"(?i)^\w+_(?:final|new|old|copy|v\d|2)$",
    r"(?i)^(?:newFunction|myFunction|doStuff|doSomething|processData|handleData)\d*$",
]
VAGUE = ["data", "item", "items", "result", "results", "obj", "value", "values", "element", "entry", "record", "output", "input", "response", "payload", "params", "options", "config", "temp"]
VAGUE_FUNCTION = r"(?i)\b(?:function|def|const)\s+(?:process|handle|manage|do|get|set|transform|convert)(?:Data|Item|Stuff|Things?|Result|Object|Info|Values?)\b"
HELPER = r"\b(?:class|interface|abstract\s+class)\s+(\w*(?:Utils?|Manager|Handler|Helper|Service|Factory|Provider|Wrapper|Adapter)\w*)"
CEREMONY = r"(?i)\b(?:const|function|class)\s+((?:create\w*(?:Factory|Provider|Builder|Manager)|\w*Factory|\w*Provider)\b[\s\S]{0,300})"
NEXT_DECLARATION = r"\n(?:export |const |function |class )[\s\S]*$"
BOOLEAN_BODY = r"(?i)\b(?:true|false|toggle|isEnabled|enabled|visible|open)\b|!\s*\w+"
FLOW = r"(?i)\b(?:switch|case|extends|implements|async|await|fetch|query)\b"
BOOLEAN_MEMO = r"useMemo\s*\(\s*\(\s*\)\s*=>\s*(?:!|\w+\s*===|\w+\s*!==|true|false)"
#: Names that rules of names may fit: of more than lower-case letters, or one of LAZY.
IDENTIFIER = r"\b(?=[a-z]++[A-Z0-9_]|newfunction|myfunction|dostuff|dosomething|processdata|handledata)([a-z][a-zA-Z0-9_]{2,})\b"
ABBREVIATED = [r"(?:^|[a-z])(?:Svc|Cfg|Mgr|Ctx|Idx|Buf|Repo|Auth|Btn|El|Ln|Msg|Qty|Amt)(?:[A-Z]|$)", r"^(?:cfg|svc|mgr|ctx|idx|buf|acc|prev|curr|dst|src|tmp|qty|amt)[A-Z0-9_]"]
IS_TEST = r"\b(?:describe|it|test|assert\w*|expect|@Test|def test_|TestCase)\b"
HOLLOW = [
    r"(?i)expect\s*\(\s*(?:true|1)\s*\)\s*\.\s*to\w*\s*\(\s*(?:true|1)\s*\)",
    r"assert(?:Equals?|True|That)?\s*\(\s*(?:true|True|1)\s*(?:,\s*(?:true|True|1)\s*)?\)",
    r"expect\s*\([^)]*\)\s*\.\s*(?:toBeDefined|not\.toBeNull|toBeTruthy)\s*\(\s*\)",
    r"assert\s+\w+\s+is\s+not\s+None",
]
TEST_BODY = r"(?s)\b(?:it|test)\s*\(\s*['\"][^'\"]+['\"]\s*,\s*(?:async\s*)?\(\s*\)\s*=>\s*\{(.*?)\n\s*\}\s*\)"
NEGATIVE = r"\b(?:toThrow|assertRaises|rejects|expectError|toBeFalsy|assertFalse|pytest\.raises)\b"
FAMILIES = {
    "HTTP": ["fetch(", "axios", "XMLHttpRequest", "http.request", "got(", "superagent", "requests.", "urllib", "httpx", "curl_init"],
    "dates": ["moment(", "dayjs", "date-fns", "luxon", "new Date(", "DateTime::", "strtotime", "datetime."],
    "validation": ["zod", "joi", "yup", "ajv", "class-validator", "pydantic", "filter_var("],
    "hashing": ["bcrypt", "argon2", "scrypt", "md5(", "sha1(", "password_hash("],
    "ids": ["uuid", "nanoid", "randomUUID", "cuid", "ObjectId"],
}
TODO = [r"(?i)(?:TODO|FIXME)\s*:?\s*(?:implement|add|handle|complete|finish|replace this|actual)", r"(?i)^\s*(?://|#)\s*(?:Implementation goes here|Your code here|Add your .* here)", r"\braise NotImplementedError\b"]
SECRETS = [
    r"(?i)['\"](?:your|my)[-_](?:secret|api|private|access)[-_]?(?:key|token|secret)?['\"]",
    r"(?i)['\"](?:change[-_]?me|replace[-_]?me|SECRET_KEY_HERE|YOUR_API_KEY|xxx+|placeholder)['\"]",
    r"(?i)\b(?:secret|api_?key|password|token|passwd)\s*[:=]\s*['\"][A-Za-z0-9_\-]{6,}['\"]",
    r"<YOUR_[A-Z_]+>",
]
INSECURE = [
    r"(?i)Access-Control-Allow-Origin['\"]?\s*[,:=]\s*['\"]\*",
    r"(?i)verify\s*=\s*False|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)|rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED",
    r"(?i)(?:SELECT|INSERT|UPDATE|DELETE)[^\n;]{0,80}(?:\.\s*\$|'\s*\.\s*\$|\+\s*\w+\s*\+|\$\{|%s'\s*%|f[\"'])",
    r"\b(?:echo|print|innerHTML\s*=)\s*[^;\n]*\$_(?:GET|POST|REQUEST)",
]
TICKETS = r"(?i)(?:#\d{2,}|\b[A-Z]{2,8}-\d+\b|(?:github|gitlab|jira|linear|atlassian)\.[a-z]{2,}/|\bcf\.?\s|see\s+(?:issue|ticket|bug|PR)\b)"
INFORMAL = r"(?i)\b(?:HACK|XXX|WTF|UGH|ARGH|sigh|do ?n['o]?t touch|no idea why|god knows|for some reason|somehow|apparently|used to be|blame|sorry|yikes|gross|nasty|horrible|stupid|dumb|cursed|jank\w*|footgun|magic\b|voodoo)\b"
LEGACY = r"\$\(document\)\.ready|jQuery\(|\$\.ajax\(|\.live\(|var\s+\w+\s*=\s*function"
NOT_METHODS = ["if", "for", "while", "switch", "catch", "return", "do", "else", "function", "with"]
SMALL_NAMES = r"(?i)^(?:main|index|app|default|constructor|render|__init__|setUp)$"
THIN_LINES = 25
#: So many names are looked for one after another; more would take the square of a file's length.
FEW_NAMES = 40
WHITE = " \t\n\r\x00\x0B"
_METHOD = r"^\s+(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?([A-Za-z_$]\w*)\s*\([^()]*\)\s*\{\s*$"


def trimmed(s: Column) -> Column:
    return F.trim(s, F.lit(WHITE))


def is_declaration(line: Column) -> Column:
    """Whether a line declares a function: by keyword, as an assigned function, or as a method."""
    method = F.lower(F.regexp_extract(line, _METHOD, 1))
    some = line.contains("(") | line.contains("function")  # cheap, and without these no pattern fits
    return some & (line.rlike(r"\b(?:function|def|func|fn)\s+\w+\s*\(") | line.rlike(r"\b(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>)") | (line.rlike(_METHOD) & ~method.isin(NOT_METHODS)))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _if_seen(pattern: str, found: Column, none: Column) -> Column:
    """found, or none where ``_low``, the folded text, has none of the pattern's plain texts."""
    may = seen(F.col("_low"), pattern)
    return found if may is None else F.when(may, found).otherwise(none)


def _words(s: Column) -> Column:
    return F.split(F.lower(s), "[^a-z0-9]+")


def sources(files: DataFrame, id_col: str = "subject_id", src_col: str = "src") -> DataFrame:
    """(subject_id, src, code_language) with line ends as LF; null sources are empty."""
    src = once(F.coalesce(F.col(src_col), F.lit("")), lambda s: F.when(F.contains(s, F.lit("\r")), F.regexp_replace(s, r"\r\n?", "\n")).otherwise(s))
    rows = files.select(F.col(id_col).alias("subject_id"), src.alias("src")).withColumn("_low", fold(F.col("src")))
    return rows.withColumn("code_language", detect_code_language(F.col("src"), lambda p: seen(F.col("_low"), p), led)).drop("_low")


def with_lines(src: DataFrame) -> DataFrame:
    """src with ``lines``, an array of (ln, line, t, comment): comment is a line's comment text, null if it has none.

    A line is inside a block comment if the last line that opens one without closing it comes after the last that closes one.
    Each line gives one letter, for what it does to a block; a run from an opening letter to the next closing one is a block,
    of which all but the first line are inside. The flags meet the lines as the second array of zip_with: as a column that
    a lambda captures they would be worked out again for every line.
    """
    rows = src.withColumn("lines", F.transform(F.split("src", "\n"), lambda x, i: F.struct(i.alias("ln"), x.alias("line"), trimmed(x).alias("t"))))
    letters = F.array_join(F.transform("lines", lambda x: F.when(x["t"].contains("*/"), "c").when(x["t"].startswith("/*"), "o").otherwise("-")), "")
    inside = lambda run: F.when(run.startswith("o"), F.concat(F.lit("0"), F.repeat(F.lit("1"), F.length(run) - 1))).otherwise(F.repeat(F.lit("0"), F.length(run)))
    flags = F.slice(F.split(F.array_join(F.transform(F.regexp_extract_all(letters, F.lit("o[^c]*c?|[^o]+"), F.lit(0)), inside), ""), ""), 1, F.size("lines"))

    def told(x: Column, flag: Column) -> Column:
        own = (flag == "1") | x["t"].startswith("/*") | is_comment_line(x["t"])
        behind = x["line"].contains("//") | x["line"].contains("#")  # else there is no comment behind code
        tail = F.regexp_extract(x["line"], r"\S\s+(//[^\n]{3,}|#[^\n]{3,})$", 1)
        comment = F.when(x["t"] == "", F.lit(None).cast("string")).when(own, x["t"]).when(behind, F.nullif(trimmed(tail), F.lit("")))
        return F.struct(x["ln"].alias("ln"), x["line"].alias("line"), x["t"].alias("t"), comment.alias("comment"))

    return rows.withColumn("lines", F.zip_with("lines", flags, told))


def lines(src: DataFrame) -> DataFrame:
    """(subject_id, ln, line, t, comment): a row for each line."""
    return with_lines(src).select("subject_id", F.explode("lines").alias("x")).select("subject_id", "x.*")


def line_features(rows: DataFrame) -> DataFrame:
    """rows (with_lines) with counts over a file's lines and comments, and for some the first lines counted (``*_shown``).

    Only comments and declarations look at the lines around them.
    """
    at = lambda i: F.get("lines", i)["t"]
    up = lambda i, k: F.when(i >= k, at(F.greatest(i - k, F.lit(0))))
    code = lambda t: (t != "") & ~is_comment_line(t)

    def noted(x: Column) -> Column:
        i = x["ln"]
        near = F.coalesce(*[F.when(code(at(i + k)), at(i + k)) for k in (1, 2, 3)])  # the first code line within three below
        body = F.regexp_replace(F.regexp_replace(x["comment"], r"^\s*(?://+|#+|/\*+|\*+|<!--|--)\s*", ""), r"(?:\*/|-->)\s*$", "")
        off = F.regexp_replace(x["comment"], r"^\s*(?://+|#+|/\*+|\*+)\s*", "")
        return F.struct(i.alias("ln"), x["comment"].alias("comment"), trimmed(body).alias("body"), trimmed(off).alias("off"), near.alias("near"))

    def declaring(x: Column) -> Column:
        i = x["ln"]
        above = F.coalesce(*[F.when(up(i, k) != "", up(i, k)) for k in (1, 2, 3)])
        return F.struct(above.alias("above"), at(i + 1).alias("next"))

    def what(x: Column) -> Column:
        code_words = F.filter(_words(split_identifiers(x["near"])), lambda w: F.length(w) > 2)
        own_words = F.filter(_words(x["body"]), lambda w: F.length(w) > 3)
        return (x["body"] != "") & (F.octet_length(x["body"]) <= 90) & x["body"].rlike(IMPERATIVE) & ~looks_like_why(x["body"]) & F.arrays_overlap(own_words, code_words)

    def switched_off(x: Column) -> Column:
        o = x["off"]
        return (o != "") & ((o.rlike(r"[;{}]\s*$") & o.rlike(r"[=(]")) | o.rlike(r"^(?:(?:if|for|while|return|const|let|var|def|print|echo)\b|\$\w+\s*=\b)") | o.rlike(r"(?i)^[a-z_$][\w.$]*\([^()]*\)\s*;?(?:\s|$)"))

    true = lambda test: lambda x: F.coalesce(test(x), F.lit(False))
    equals = lambda k: lambda x: x == k
    documented = lambda x: x["above"].rlike(r"^(?:\*/|///|#'|\"\"\"|''')")
    rows = rows.withColumn("told", F.transform(F.filter("lines", lambda x: x["comment"].isNotNull()), noted)).withColumn("_declared", F.transform(F.filter("lines", lambda x: is_declaration(x["line"])), declaring))
    shown = {
        "emoji_comments": lambda x: has_emoji(x["comment"]), "banners": lambda x: x["comment"].rlike(BANNER), "what_comments": what, "chatter": lambda x: x["comment"].rlike(CHATTER), "why": lambda x: looks_like_why(x["comment"]),
        "tickets": lambda x: x["comment"].rlike(TICKETS), "informal": lambda x: x["comment"].rlike(INFORMAL), "switched_off": switched_off,
    }
    for name, test in shown.items():
        rows = rows.withColumn(name, F.filter("told", true(test)))
    n = F.size("lines")
    size = F.ceil(n / 8)
    count = lambda test: F.size(F.filter("lines", true(test)))
    part = lambda x, k: F.least(F.lit(7), F.floor(x["ln"] / k)).cast("int")
    imports = F.filter("lines", lambda x: x["line"].rlike(r"^\s*(?:import\s+|from\s+\S+\s+import\s+|use\s+[A-Z])"))
    line_of = lambda x: F.concat(F.lit("line "), (x["ln"] + 1).cast("string"), F.lit(": "), x["comment"])
    rows = rows.withColumn("_documented", F.filter("_declared", lambda x: F.coalesce(documented(x), F.lit(False)))).withColumn("_told", F.zip_with("told", F.array_repeat(size, F.size("told")), part))
    found = {name: F.size(name) for name in shown} | {f"{name}_shown": F.transform(F.slice(name, 1, 4), line_of) for name in shown}
    found |= {
        "n_lines": n, "comments": F.size("told"), "declared": F.size("_declared"), "documented": F.size("_documented"), "trivial": F.size(F.filter("_documented", lambda x: F.coalesce(x["next"].rlike(r"^(?:return|\$this->|self::)"), F.lit(False)))),
        "tabs": count(lambda x: x["line"].startswith("\t")), "spaces": count(lambda x: x["line"].startswith(" ")), "stubs": count(lambda x: _any([x["line"].rlike(p) for p in TODO])), "typography": count(lambda x: x["line"].rlike(r"[\x{2018}\x{2019}\x{201C}\x{201D}\x{2014}]")),
        "eighths": F.array(*[F.size(F.filter("_told", equals(k))) for k in range(8)]), "imports": F.transform(imports, lambda x: F.struct(x["ln"].alias("ln"), F.lower(x["t"]).alias("t"))), "head": F.array_join(F.transform(F.slice("lines", 1, 12), lambda x: x["line"]), "\n"),
    }
    keep = [c for c in rows.columns if c not in found and c not in ("lines", "told") and not c.startswith("_")]
    return rows.select(*keep, *[c.alias(name) for name, c in found.items()])


def single_use(src: DataFrame) -> DataFrame:
    """src with declares, dead_imports and dead_names: imported and declared names that occur once among all words of the file."""
    rows = src.withColumn("_low", fold(F.col("src")))
    none = F.array().cast("array<string>")
    all_of = lambda p, g=1: _if_seen(p, F.regexp_extract_all("src", F.lit(led(p)), F.lit(g)), none)
    one = all_of(r"(?m)^\s*import\s+(\w+)\s+from")
    many = F.flatten(F.transform(all_of(r"(?m)^\s*import\s+\{([^}]+)\}\s+from"), lambda x: F.split(x, ",")))
    imported = F.filter(F.transform(F.concat(one, many), lambda x: trimmed(F.regexp_replace(trimmed(x), r"\s+as\s+.*$", ""))), lambda x: F.length(x) >= 2)
    rows = rows.withColumn("_i", imported).withColumn("_named", all_of(r"\b(?:function|def|const|class)\s+([A-Za-z_]\w{3,})"))
    declared = F.filter(F.array_distinct("_named"), lambda x: ~x.rlike(SMALL_NAMES))
    public = F.flatten(F.transform(all_of(r"\b(?:export|module\.exports|public)\b[^\n]*", 0), lambda x: F.regexp_extract_all(x, F.lit(r"\w+"), F.lit(0))))
    rows = rows.withColumn("declares", F.size("_named") > 0).withColumn("_d", F.when(F.size("_named") > 0, F.array_except(declared, public)).otherwise(none)).drop("_low", "_named")
    # only names that are asked for count, so others go first where these are few; equal ones are neighbours in the sorted array
    rows = rows.withColumn("_asked", F.concat("_i", "_d"))
    n, every = F.size("_asked"), F.regexp_extract_all("src", F.lit(r"\w+"), F.lit(0))
    words = F.array_sort(F.when(n == 0, none).when(n <= FEW_NAMES, F.filter(every, lambda w: F.array_contains("_asked", w))).otherwise(every))
    rows = rows.withColumn("_w", words).withColumn("_again", F.array_distinct(F.filter("_w", lambda w, i: (i > 0) & (F.get("_w", F.greatest(i - 1, F.lit(0))) == w))))
    dead = rows.withColumn("dead_imports", F.size(F.array_except("_i", "_again"))).withColumn("dead_names", F.size(F.array_except(F.array_intersect("_d", "_w"), "_again")))
    return dead.drop("_i", "_d", "_asked", "_w", "_again")


def source_features(src: DataFrame) -> DataFrame:
    """src with counts over a file's whole text."""
    s = F.col("src")
    none = F.array().cast("array<string>")
    # the plain texts of a pattern come first (guards)
    n = lambda p: _if_seen(p, F.regexp_count(s, F.lit(led(p))), F.lit(0))
    all_of = lambda p, g=1: _if_seen(p, F.regexp_extract_all(s, F.lit(led(p)), F.lit(g)), none)
    like = lambda p: _if_seen(p, s.rlike(led(p)), F.lit(False))
    total = lambda ps: reduce(lambda a, b: a + b, [n(p) for p in ps])
    idents = src.withColumn("_low", fold(s)).withColumn("idents", F.array_distinct(all_of(IDENTIFIER))).withColumn("chains", n(r"\?\.") + n(r"\?\?"))
    long = F.filter("idents", lambda x: (F.octet_length(x) >= 20) & (identifier_words(x) >= 4))
    first = idents.select(
        "*", F.size(long).alias("verbose"), F.size(F.filter(long, lambda x: (F.octet_length(x) >= 28) & (identifier_words(x) >= 5))).alias("egregious"),
        F.size(F.filter("idents", lambda x: _any([x.rlike(p) for p in LAZY]))).alias("lazy"), F.size(F.filter("idents", lambda x: _any([x.rlike(p) for p in ABBREVIATED]))).alias("abbreviated"),
        n(r"\btry\s*[:{]").alias("tries"), F.greatest(F.lit(1), n(r"\b(?:function|def|func)\s+\w+")).alias("functions"), total(SWALLOWED).alias("swallowed"),
        (n(r"\bconsole\.(?:log|debug|info)\s*\(") + n(r"\b(?:var_dump|print_r|error_log)\s*\(")).alias("logs"), F.size(F.filter(all_of(LOG_TEXT), has_emoji)).alias("emoji_logs"),
        F.when(F.col("chains") >= 8, F.greatest(F.lit(1), n(r"[a-zA-Z_$)\]]\s*\.\s*[a-zA-Z_$]"))).otherwise(1).alias("accesses"), n(r"(?<![\w$])if\s*\(").alias("ifs"), n(r"(?<![\w$])else\b").alias("elses"),
        F.size(F.filter(all_of(FORMAL), lambda x: x.rlike(MODAL))).alias("formal"),
    )
    params = F.arrays_zip(all_of(r"(?i)@param\s+(?:\{[^}]*\}\s+)?\$?(\w+)\s*[-:]?\s*[^\n*]{4,90}").alias("name"), all_of(r"(?i)@param\s+(?:\{[^}]*\}\s+)?\$?\w+\s*[-:]?\s*([^\n*]{4,90})").alias("text"))
    restates = lambda p: F.arrays_overlap(F.filter(_words(split_identifiers(p["name"])), lambda w: F.length(w) > 2), _words(trimmed(p["text"])))
    families = [reduce(lambda a, b: a + b, [s.contains(m).cast("int") for m in members]) for members in FAMILIES.values()]
    solved = reduce(lambda a, b: a + b, [once(f, lambda k: F.when(k >= 3, 3).when(k >= 2, 1).otherwise(0)) for f in families])
    named = all_of(rf"(?i)(?:\b(?:const|let|var|function|def)\s*|\$\s*|\b(?:for|foreach)\s*\(\s*(?:const|let|var)?\s*)({'|'.join(VAGUE)})\b")
    bracketed, dotted = all_of(r"(\w+)\[[\"']\w+[\"']\]"), all_of(r"\b(\w+)\.\w")
    bodies = F.transform(all_of(CEREMONY), lambda b: F.regexp_replace(b, NEXT_DECLARATION, ""))
    web = F.col("code_language").isin("javascript", "typescript", "jsx")
    # what few sources have comes first
    snakes, camels = (F.size(F.array_distinct(all_of(p))) for p in (r"\b([a-z]+_[a-z][a-z0-9_]*)\b", r"\b([a-z]+[A-Z][a-zA-Z0-9]*)\b"))
    quotes = F.array(n(r"(?<![\\\w])'[^'\n]{2,40}'"), n(r"(?<![\\\w])\"[^\"\n]{2,40}\""))
    uneven = once(quotes, lambda q: (q[0] + q[1] >= 8) & (F.least(q[0], q[1]) / F.greatest(F.lit(1), q[0] + q[1]) > 0.25))
    mixed = (
        (~F.col("code_language").isin("python", "php", "sql") & s.contains("_") & (snakes >= 2) & (camels >= 3)).cast("int")
        + once(bracketed, lambda b: F.when(F.size(b) > 0, F.arrays_overlap(b, dotted)).otherwise(False)).cast("int") + (web & uneven).cast("int")
    )
    hollow = total(HOLLOW) + F.size(F.filter(all_of(TEST_BODY), lambda b: ~b.rlike(r"\b(?:expect|assert|should)\b")))
    second = first.drop("idents").select(
        "*", total(ENDPOINTS).alias("endpoints"), F.size(F.filter(params, lambda p: F.coalesce(restates(p), F.lit(False)) | F.lower(trimmed(p["text"])).rlike(FILLER))).alias("tautologies"),
        solved.alias("solutions"), F.size(F.array_distinct(F.transform(named, F.lower))).alias("vague"), n(VAGUE_FUNCTION).alias("vague_functions"), F.size(F.array_distinct(all_of(HELPER))).alias("helpers"),
        (F.size(F.filter(bodies, lambda b: b.rlike(BOOLEAN_BODY) & ~b.rlike(FLOW))) + n(BOOLEAN_MEMO)).alias("ceremony"), F.coalesce(mixed, F.lit(0)).alias("mixed"),
    )
    return second.select(
        "*", like(IS_TEST).alias("tests"), hollow.alias("hollow"), n(NEGATIVE).alias("negatives"), n(r"\b(?:expect|assert\w*)\s*\(").alias("assertions"),
        total(SECRETS).alias("secrets"), _any([like(p) for p in INSECURE]).alias("insecure"),
        ((like(r"(?i)\b(?:jwt|sign)\s*\(") & ~like(r"(?i)\b(?:expiresIn|exp\b|setExpiration|ttl|expires_at)")) | (
            like(r"(?i)\b(?:findById|findOne|SELECT|->find\(|get\()") & like(r"(?i)(?:params|query|body|\$_GET|\$_POST)\s*\[?['\"]?(?:id|user_?id|order_?id)")
            & ~like(r"(?i)\b(?:user_?id\s*[=:]{1,2}\s*(?:\$?(?:current|auth|session|req)\w*)|owner|belongs_?to|->user_?id|can\(|authorize|abort\(403|403\b)")
        )).alias("weak_auth"),
        like(LEGACY).alias("legacy"),
        ((F.col("code_language") == "python") & like(r"if\s+__name__\s*==\s*['\"]__main__['\"]\s*:") & (like(r"__main__['\"]\s*:\s*\n\s*(?:pass|print\(|main\(\)\s*$)") | like(r"\bclass\s+\w+"))).alias("main_guard"),
    ).drop("_low")


def features(files: DataFrame, id_col: str = "subject_id", src_col: str = "src") -> DataFrame:
    """One row of counts per row of files, in as many projections as their size needs and without a shuffle but that of spread()."""
    src = sources(spread(files), id_col, src_col)
    return single_use(source_features(line_features(with_lines(src)))).drop("src")


def notes(f: DataFrame) -> DataFrame:
    """(subject_id, notes): codes of what a reader should know of how a file was read: a short sample, and that no history was seen."""
    said = {"short_sample": F.col("n_lines") < THIN_LINES, "no_history": F.lit(True)}
    return f.select("subject_id", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in said.items()]), lambda x: x.isNotNull()).alias("notes"))


def fired(f: DataFrame) -> DataFrame:
    """(subject_id, signal_id, fire_seq, evidence) of the signals that fire; evidence is the first lines that show them, or the number behind them."""
    c = F.col
    cv_mean = F.aggregate("eighths", F.lit(0.0), lambda s, x: s + x) / 8
    deviation = F.sqrt(F.aggregate("eighths", F.lit(0.0), lambda s, x: s + (x - cv_mean) * (x - cv_mean)) / 8)
    uniform = (c("n_lines") >= 80) & (c("comments") >= 8) & (cv_mean >= 0.8) & (F.array_min("eighths") > 0) & (deviation < 0.45 * cv_mean)
    k = F.size("imports")
    ordered = F.size(F.filter(F.zip_with(F.slice("imports", 1, k - 1), F.slice("imports", 2, k - 1), lambda a, b: a["t"] <= b["t"]), lambda x: x))
    sorted_imports = F.when(k >= 6, (F.element_at("imports", -1)["ln"] - F.element_at("imports", 1)["ln"] <= k + 3) & (ordered >= 0.85 * (k - 1))).otherwise(False)
    head = trimmed(c("head"))
    dead = c("dead_imports") + c("dead_names")
    rules = {
        "cd.emoji_comments": (c("emoji_comments") >= 1, "emoji_comments_shown"), "cd.section_header_comments": (c("banners") >= 2, "banners_shown"), "cd.what_comments": (c("what_comments") >= 3, "what_comments_shown"),
        "st.file_header_block": (c("head").rlike(r"^\s*(?:/\*\*|\"\"\"|'''|//|#)") & c("head").rlike(PURPOSE) & (F.octet_length(head) > 60), head),
        "st.uniform_comment_density": (uniform, F.array_join(F.transform("eighths", lambda x: x.cast("string")), ", ")),
        "st.docblock_on_everything": ((c("declared") >= 4) & (c("documented") >= c("declared")) & (c("trivial") >= 1), c("declared")),
        "cd.assistant_chatter": (c("chatter") >= 1, "chatter_shown"), "cd.placeholder_endpoint": (c("endpoints") >= 1, c("endpoints")), "cd.tautological_params": (c("tautologies") >= 2, c("tautologies")),
        "cd.mixed_conventions": (c("mixed") >= 2, c("mixed")), "cd.blanket_try": ((c("tries") >= 3) & (c("tries") >= c("functions") * 0.7), c("tries")), "cd.swallowed_errors": (c("swallowed") >= 2, c("swallowed")),
        "cd.console_noise": ((c("logs") >= 5) & (c("logs") / (c("n_lines") / 100) >= 2.0), c("logs")), "cd.emoji_logging": (c("emoji_logs") >= 1, c("emoji_logs")),
        "cd.defensive_chaining": ((c("chains") >= 8) & (c("chains") / c("accesses") > 0.28), c("chains")), "cd.over_symmetric_branches": ((c("ifs") >= 5) & (c("elses") >= c("ifs") * 0.85), c("elses")),
        "cd.formal_errors": (c("formal") >= 2, c("formal")), "cd.verbose_names": ((c("verbose") >= 2) | (c("egregious") >= 1), c("verbose")), "cd.lazy_names": (c("lazy") >= 2, c("lazy")),
        "cd.generic_domain_names": ((c("vague") >= 3) | ((c("vague_functions") >= 1) & (c("vague") >= 1)), c("vague")), "cd.helper_pileup": (c("helpers") >= 3, c("helpers")),
        "cd.ceremony_for_nothing": (c("ceremony") >= 1, c("ceremony")), "hu.abbrevs": (c("abbreviated") >= 3, c("abbreviated")),
        "cd.empty_tests": (c("tests") & ((c("hollow") >= 1) | ((c("assertions") >= 6) & (c("negatives") == 0))), c("hollow")), "st.import_block_sorted": (sorted_imports, k),
        "st.multiple_solutions": (c("solutions") >= 2, c("solutions")), "cd.todo_placeholders": (c("stubs") >= 1, c("stubs")), "cd.main_guard": (c("main_guard"), c("code_language")),
        "st.dead_code": (F.when(c("declares"), dead >= 3).otherwise(c("dead_imports") >= 2), dead), "se.placeholder_secret": (c("secrets") >= 1, c("secrets")), "se.insecure_defaults": (c("insecure"), F.lit("insecure")),
        "se.weak_auth": (c("weak_auth"), F.lit("weak")), "cd.typography": (c("typography") >= 2, c("typography")), "hu.why_comments": (c("why") >= 1, "why_shown"), "hu.ticket_refs": (c("tickets") >= 1, "tickets_shown"),
        "hu.informal": (c("informal") >= 1, "informal_shown"), "hu.commented_code": (c("switched_off") >= 2, "switched_off_shown"),
        "hu.inconsistent_format": ((c("tabs") > 2) & (c("spaces") > 2) & (c("n_lines") > 30), F.concat_ws("/", c("tabs").cast("string"), c("spaces").cast("string"))), "hu.legacy_stack": (c("legacy"), F.lit("legacy")),
    }
    found = F.array(*[F.when(rule, F.struct(F.lit(s).alias("signal_id"), F.lit(i).alias("fire_seq"), (F.col(e) if isinstance(e, str) else F.array(e.cast("string"))).alias("evidence"))) for i, (s, (rule, e)) in enumerate(rules.items())])
    return f.select("subject_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("h")).select("subject_id", "h.*")

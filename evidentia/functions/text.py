"""Column builders over text: all native expressions, so that they stay inside generated code."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of emoji, words that tell of things outside the code, markers of languages.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{1F000}-\x{1F0FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
EMOJI_OR_ARROW = r"[\x{1F300}-\x{1FAFF}\x{1F000}-\x{1F0FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{2190}-\x{21FF}]"
WHY_WORDS = (
    r"(?i)\b(?:because|since|otherwise|so that|in order to|to avoid|to work around|workaround|due to|thanks to|turns out|it seems|apparently|historically|legacy|deprecated|"
    r"required by|mandated|per (?:the )?(?:spec|rfc|standard|audit|policy)|RFC\s?\d+|NIST|GDPR|HIPAA|PCI|SOC ?2|ISO ?\d+|CVE-\d+|bug|regression|incident|outage|postmortem|hotfix|"
    r"safari|ie ?\d+|firefox|chrome|android|ios|webkit|do not|don't|never|must not|careful|caution|warning|beware|tradeoff|trade-off|compromise|for now|temporary|until we|once we|"
    r"faster|slower|performance|memory|race condition|deadlock|timeout|see |ref |cf |as discussed|per )\b"
)
WHY_MARKS = r"\b(?:19|20)\d{2}\b|\bv?\d+\.\d+\.\d+\b|\b[A-Z]{2,8}-\d+\b|#\d{2,}"
LANGUAGE_MARKERS = {
    "fr": [" le ", " la ", " les ", " des ", " vous ", " nous ", " pour ", " avec ", " est ", " plus "],
    "es": [" el ", " la ", " los ", " las ", " para ", " con ", " que ", " una ", " nuestro ", " más "],
    "de": [" der ", " die ", " das ", " und ", " mit ", " für ", " ist ", " auf ", " wir ", " sie "],
    "en": [" the ", " and ", " for ", " with ", " you ", " our ", " that ", " this ", " from ", " are "],
}
CODE_LANGUAGES = {
    "php": r"<\?php|\$this->|->\w+\(|namespace\s+\w+;|\becho\b",
    "python": r"(?m)^\s*(?:def|class)\s+\w+.*:\s*$|^\s*import\s+\w+$|elif\b|self\.",
    "typescript": r":\s*(?:string|number|boolean|void|any|unknown)\b|\binterface\s+\w+\s*\{|\btype\s+\w+\s*=|<\w+>\(",
    "jsx": r"<[A-Z]\w*[\s/>]|className=|useState\(|useEffect\(",
    "javascript": r"\b(?:const|let|function|=>|require\(|module\.exports)\b",
    "html": r"(?i)<!DOCTYPE html|<html|<div|<section|<body",
    "css": r"[.#]?[\w-]+\s*\{[^}]*:[^}]*;[^}]*\}",
    "go": r"\bfunc\s+\w+\(|package\s+main",
    "java": r"\b(?:public|private)\s+(?:static\s+)?(?:void|class|int|String)\b",
    "sql": r"(?i)\b(?:SELECT|INSERT INTO|CREATE TABLE)\b",
}
#: A pattern with as many matches that takes linear time: the last character of a selector, and the first colon and the first semicolon behind it.
_COUNTED = {CODE_LANGUAGES["css"]: r"[\w-]\s*+\{[^}:]*+:[^};]*+;[^}]*+\}"}
LANGUAGE_LABELS = {"php": "PHP", "python": "Python", "typescript": "TypeScript", "jsx": "React / JSX", "javascript": "JavaScript", "html": "HTML", "css": "CSS", "go": "Go", "java": "Java", "sql": "SQL", "unknown": "Unrecognised language"}
ENTITY = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);"
_SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space that isn't one blank already; letters are told from the first, narrow class.
UNICODE_SPACES = rf" [{_SPACES}]+|[[^ -~\x{{A1}}-\x{{167F}}]&&[{_SPACES}]][{_SPACES}]*"


def has_emoji(s: Column) -> Column:
    return s.rlike(EMOJI_OR_ARROW)


def find_emoji(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(EMOJI), F.lit(0)))


def looks_like_why(s: Column) -> Column:
    """Whether a comment carries information from outside the code: a reason, a standard, a date, a ticket."""
    return s.rlike(WHY_WORDS) | s.rlike(WHY_MARKS)


def split_identifiers(s: Column) -> Column:
    return F.translate(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2"), "_-", "  ")


def identifier_words(s: Column) -> Column:
    """The number of words of an identifier; empty ones and ``0`` don't count."""
    return F.size(F.filter(F.split(split_identifiers(s), " "), lambda x: ~x.isin("", "0")))


def once(s: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` s, which is worked out once however often it is used: as the variable of a lambda."""
    return F.transform(F.array(s), of)[0]


def _trimmed(s: Column) -> Column:
    """Without the apostrophes and hyphens that it begins with and the hyphens at its end, of the last line too."""
    ends = F.left(s, F.lit(1)).isin("'", "-") | F.contains(F.right(s, F.lit(3)), F.lit("-"))
    return F.when(ends, F.regexp_replace(s, r"^['-]+|-+$", "")).otherwise(s)


def word_count(s: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens, those at the ends of the text trimmed first."""
    return F.regexp_count(_trimmed(F.coalesce(s, F.lit(""))), F.lit(r"[A-Za-z'-]+"))


def occurrences(s: Column, word: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(word), F.lit("")))) / len(word.encode())).cast("int")


def unescape(s: Column) -> Column:
    """s with its character references decoded in one pass: every name of HTML 5, decimal and hexadecimal ones.

    A reference ends with a semicolon; unknown names and numbers that stand for no character of a document stay as they are.
    """
    names = F.from_json(F.lit(json.dumps({name.rstrip(";"): char for name, char in html5.items() if name.endswith(";")})), "map<string,string>")  # one literal, folded when planning

    def decoded(piece: Column) -> Column:
        whole = F.regexp_extract(piece, rf"^{ENTITY}", 0)
        name = F.substring(whole, 2, F.length(whole) - 2)
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        # more than seven digits are beyond any character
        code = F.when(F.length(digits) <= 7, F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long")))
        plane = code.bitwiseAND(F.lit(0xFFFF))
        known = ((code >= 0x20) & (code <= 0x7E)) | code.isin(9, 10, 12, 13) | ((code >= 0xA0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & ~code.between(0xFDD0, 0xFDEF) & (plane < 0xFFFE))
        char = F.when(~name.startswith("#"), F.element_at(names, name)).when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(whole == "", piece).otherwise(F.concat(F.coalesce(char, whole), F.substring(piece, F.length(whole) + 1, F.length(piece))))

    pieces = lambda t: F.transform(F.regexp_extract_all(t, F.lit("(?s)&[^&]*|^[^&]+"), F.lit(0)), lambda x: F.when(x.startswith("&"), decoded(x)).otherwise(x))
    return once(s, lambda t: F.when(F.contains(t, F.lit("&")) & t.rlike(ENTITY), F.array_join(pieces(t), "")).otherwise(t))


def visible_text(html: Column) -> Column:
    """A page's text: no scripts, styles or tags, character references decoded, white space collapsed."""

    def without(tag: str, text: Column, low: Column) -> Column:
        return once(text, lambda t: F.when(F.contains(low, F.lit("/" + tag)), F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")).otherwise(t))

    def bare(text: Column, low: Column) -> Column:
        text = reduce(lambda t, tag: without(tag, t, low), ("script", "style", "noscript", "svg"), text)
        return F.regexp_replace(text, "<[^>]+>", " ")

    text = unescape(once(html, lambda s: once(F.lower(s), lambda low: bare(s, low))))
    return F.trim(F.regexp_replace(text, UNICODE_SPACES, " "))


def _marked() -> str:
    """A pattern of the markers. Two equal ones with one blank between them are one, as occurrences don't overlap."""
    words = sorted({w.strip() for ws in LANGUAGE_MARKERS.values() for w in ws})
    initials = sorted({w[0] for w in words})
    some = "|".join(x + "(?:" + "|".join(w[1:] for w in words if w[0] == x) + ")" for x in initials)
    return rf" (?=[{''.join(initials)}])({some})(?= )(?: \1(?= ))?"


def declared_language(text: Column) -> Column:
    """fr, es, de or en; empty if there are fewer than 60 words or no language has 12 markers."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))

    def best(found: Column) -> Column:
        # an entry of its own for too few markers, so that the best is worked out once
        scores = [F.struct(F.lit(12).alias("score"), F.lit(-len(LANGUAGE_MARKERS)).alias("order"), F.lit("").alias("lang"))]
        for k, (lang, words) in enumerate(LANGUAGE_MARKERS.items()):
            total = F.size(F.filter(found, lambda w: w.isin([x.strip() for x in words])))
            scores.append(F.struct(total.alias("score"), F.lit(-k).alias("order"), F.lit(lang).alias("lang")))
        return F.array_max(F.array(*scores))["lang"]

    # the first sixty words are enough to tell
    enough = _trimmed(F.coalesce(text, F.lit(""))).rlike(r"^(?:[^A-Za-z'-]*+[A-Za-z'-]++){60}")
    return F.when(enough, once(F.regexp_extract_all(low, F.lit(_marked()), F.lit(1)), best)).otherwise("")


def detect_code_language(src: Column, may: Callable[[str], Column | None] = lambda pattern: None, led: Callable[[str], str] = lambda pattern: pattern) -> Column:
    """The language most of whose marks occur; the first of equals; ``unknown`` without any. may and led speed up patterns (guards.seen, guards.led)."""

    def count(pattern: str) -> Column:
        n, some = F.regexp_count(src, F.lit(_COUNTED.get(pattern, led(pattern)))), may(pattern)
        return n if some is None else F.when(some, n).otherwise(0)

    counts = [F.struct(count(p).alias("n"), F.lit(-k).alias("order"), F.lit(lang).alias("lang")) for k, (lang, p) in enumerate(CODE_LANGUAGES.items())]
    return F.array_max(F.array(F.struct(F.lit(0).alias("n"), F.lit(1).alias("order"), F.lit("unknown").alias("lang")), *counts))["lang"]


def language_label(name: Column) -> Column:
    """The name of a code language as it is shown; others with a capital letter."""
    shown = F.coalesce(*[F.when(name == n, F.lit(label)) for n, label in LANGUAGE_LABELS.items()])
    return F.coalesce(shown, F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 1_000_000)))


def is_comment_line(line: Column) -> Column:
    return line.rlike(r"^(?://|#(?!!\[)|\*|<!--|--\s)")


def redact(s: Column) -> Column:
    """Long values of secret-like assignments shortened to their first four characters."""
    return F.regexp_replace(s, r"(?i)((?:secret|token|password|api[_-]?key)\s*[:=]\s*[\"']?)([^\s\"']{4})[^\s\"']+", "$1$2…")

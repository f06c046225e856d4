"""Plain texts that any match of a pattern has in it: looking for these first is far cheaper than matching the pattern.

A pattern's guard is a list of lower-case texts of which each match has one at least, whatever the case: ASCII, or characters
without case. A pattern may have further guards, as the parts of a match are all needed. So
``seen(folded, p) & s.rlike(p)`` is ``s.rlike(p)``, where ``folded`` is fold() of s or of a text that has s in it.

Searching a page and all it loads some thousand times is most of the cost of its rules, so words() of it come first: the
different runs of ASCII letters and digits, a text of a tenth of the length. A text of the guard that is one run is looked for
there only, others only where their longest run is found there.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: A guard has at most so many texts, of so many characters at least.
MOST, LEAST = 80, 2
#: Texts of a further guard at most, and what is in most pages.
FEW, COMMON = 16, {"<", ">", "=", '"', "'", "/", "-", ".", ",", ":", ";", "(", ")", "_", "</", "<a", "<p", "#"}
_REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)


#: Letters beyond ASCII that patterns without case take for others, and these.
_ODD = {"\u0131": "i", "\u0307": "", "\u017f": "s", "\u212a": "k"}


def fold(s: Column) -> Column:
    """s in lower case, with the letters beyond ASCII that patterns without case take for i and s as these."""

    def plain(low: Column) -> Column:
        # replacing takes far longer than finding that there is nothing to replace
        odd = (F.octet_length(low) > F.char_length(low)) & reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in _ODD])
        return F.when(odd, reduce(lambda out, x: F.replace(out, F.lit(x), F.lit(_ODD[x])), _ODD, low)).otherwise(low)

    return once(F.lower(s), plain)


def words(folded: Column) -> Column:
    """The different runs of ASCII letters and digits of a folded text, with blanks between them. Its different lines are enough."""
    lines = F.array_join(F.array_distinct(F.split(folded, "\n")), "\n")
    return F.array_join(F.array_distinct(F.regexp_extract_all(lines, F.lit("[a-z0-9]+"), F.lit(0))), " ")


def held(folded: Column, text: str, known: Column | None = None) -> Column:
    """Whether a folded text has a lower-case text in it; known is words() of it."""
    run = max(re.findall("[a-z0-9]+", text), key=len, default="")
    whole = F.contains(folded, F.lit(text))
    if known is None or len(run) < LEAST:
        return whole
    some = F.contains(known, F.lit(run))
    return some if run == text else some & whole


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    value = lambda g: (min(min(map(len, g)), 6), -len(g), min(map(len, g)))
    return a if b is None or (a is not None and value(a) >= value(b)) else b


def _plain(code: int) -> bool:
    """Whether a character stays what it is in fold(), or is an ASCII letter."""
    x = chr(code)
    return code < 128 or (x.lower() == x.upper() == x and x != "\u0307")


def _all_needed(nodes) -> list[frozenset]:
    """Guards of a sequence: every match has a text of each."""
    found, run = [], ""
    for op, arg in [*nodes, (None, None)]:
        if op is C.LITERAL and _plain(arg):
            run += chr(arg).lower()
            continue
        if len(run) >= LEAST or (run and not run.isalnum() and not run.isspace()):
            found.append(frozenset([run]))
        run = ""
        if op is C.SUBPATTERN:
            found += _all_needed(arg[3])
        elif op is C.BRANCH:
            parts = [_needed(x) for x in arg[1]]
            if all(parts):
                found.append(frozenset().union(*parts))
        elif op is C.IN and all(o is C.LITERAL and _plain(x) and not chr(x).isalnum() and not chr(x).isspace() for o, x in arg):
            found.append(frozenset(chr(x) for _, x in arg))
        elif op in _REPEATS and arg[0] > 0:
            found += _all_needed(arg[2])
    return [x for x in found if len(x) <= MOST]


def _needed(nodes) -> frozenset | None:
    return reduce(_better, _all_needed(nodes), None)


@lru_cache(maxsize=None)
def _guards(pattern: str) -> tuple[frozenset, ...]:
    """The guards of a pattern, the best one first."""
    plain = re.sub(r"^\(\?[imsuU]+\)", "", pattern)
    plain = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", re.sub(r"\\[pP]\{\w+\}", r"\\d", plain))
    try:
        found = _all_needed(parser.parse(plain))
    except re.error:
        return ()
    best = reduce(_better, found, None)
    return (best, *dict.fromkeys(x for x in found if x != best)) if best else ()


def guard(pattern: str) -> tuple[str, ...] | None:
    """The texts of a pattern's guard; None if it has none."""
    return tuple(sorted(_guards(pattern)[0])) if _guards(pattern) else None


def _firsts(nodes) -> set[str] | None:
    """What a match may begin with, as parts of a character class; None if that can't be told, or if a match may be empty."""
    found: set[str] = set()
    for op, arg in nodes:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if op in (C.LITERAL, C.IN):
            parts = [(op, arg)] if op is C.LITERAL else arg
            if not all(o in (C.LITERAL, C.RANGE) for o, _ in parts):
                return None
            return found | {f"\\x{{{x:X}}}" if o is C.LITERAL else f"\\x{{{x[0]:X}}}-\\x{{{x[1]:X}}}" for o, x in parts}
        if op is C.BRANCH:
            some = [_firsts(x) for x in arg[1]]
            return found.union(*some) if all(some) else None
        if op is C.SUBPATTERN and not arg[1] and not arg[2]:
            some = _firsts(arg[3])
            return found | some if some else None
        if op not in _REPEATS or not (some := _firsts(arg[2])):
            return None
        found |= some
        if arg[0] > 0:
            return found
    return None


@lru_cache(maxsize=None)
def led(pattern: str) -> str:
    """The pattern, preceded by a look at the first character where that can be told: it matches the same, and the rest of it,
    which is far slower, is tried at few places. Patterns that begin with a text are found fast as they are.
    """
    flags, plain = re.match(r"((?:\(\?[imsuU]+\))?)(.*)", pattern, re.S).groups()
    if re.search(r"\\[pPhHvVRXQGZ]|\[\[|&&|\[\^?\]", plain):
        return pattern  # not as Python reads it
    try:
        nodes = parser.parse(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", plain))
    except re.error:
        return pattern
    if "i" not in flags and len(nodes) and nodes[0][0] is C.LITERAL:
        return pattern
    first = _firsts(nodes)
    return f"{flags}(?=[{''.join(sorted(first))}]){plain}" if first else pattern


def seen(folded: Column, pattern: str, known: Column | None = None) -> Column | None:
    """Whether a text may match, by its fold() and, where they are known, its words(); None if that can't be told."""
    # short lists tell sooner; what nearly every page has tells nothing
    others = sorted((x for x in _guards(pattern)[1:] if len(x) <= FEW and not any(t in COMMON for t in x)), key=len)[:2]
    parts = [reduce(lambda a, b: a | b, [held(folded, t, known) for t in sorted(x)]) for x in sorted([*others, *_guards(pattern)[:1]], key=len)]
    return reduce(lambda a, b: a & b, parts) if parts else None

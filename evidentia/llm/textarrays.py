"""Texts as numpy arrays: letters, spans and n-gram hashes, in blocks so that one long text needs bounded memory."""

from __future__ import annotations

import functools
import re
import sys

import numpy as np

#: Characters handled at a time.
BLOCK = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(1)
def letter_table() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.lru_cache(1)
def space_table() -> np.ndarray:
    """True for each code point that Python treats as white space."""
    return np.fromiter((chr(i).isspace() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_grown: list[tuple[np.ndarray, np.ndarray]] = []


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _grown or len(_grown[0][0]) < n:
        _grown[:] = [_powers(max(1 << 16, 1 << (n - 1).bit_length()))]
    return _grown[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, without a loop over spans."""
    up, down = powers_for(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(mask.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def blocks(text: str, overlap: int = 0):
    """Pieces of a text of at most BLOCK characters that together cover it; neighbours share ``overlap`` characters."""
    if len(text) <= BLOCK:
        yield text
        return
    at = 0
    while at < len(text):
        yield text[max(0, at - overlap) : at + BLOCK]
        at += BLOCK


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters; each run of other characters is one space; a space at either end."""
    a = codes(text.lower())
    is_letter = letter_table()[a]
    a = np.where(is_letter, a, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.concatenate(([np.uint32(32)], a[keep], [np.uint32(32)] if not len(a) or is_letter[-1] else np.empty(0, np.uint32)))


def letter_ngrams(text: str, orders: tuple[int, ...]) -> list[np.ndarray]:
    """uint64 hashes of the character n-grams of letter_codes(text), an array for each order and block."""
    found = []
    for piece in blocks(text, max(orders)):
        a = letter_codes(piece).astype(np.uint64)
        h = np.zeros(len(a), np.uint64)
        for n in range(1, max(orders) + 1):
            if len(a) < n:
                break
            h = h[: len(a) - n + 1] * np.uint64(_BASE) + a[n - 1 :] + np.uint64(n)
            if n in orders:
                found.append(h * _M2)
    return found


_BREAK = re.compile("[ \t\n\x0b\x0c\r]")


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of a whole text, A-Z lower-cased. Long texts are cut at white space."""
    found, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK:
            cut = _BREAK.search(text, at + BLOCK)
            end = cut.start() if cut else end
        a = codes(text[at:end] if at or end < len(text) else text)
        a = np.where((a >= 65) & (a <= 90), a + np.uint32(32), a)
        starts, ends = runs(~((a == 32) | ((a >= 9) & (a <= 13))))
        found.append(span_hashes(a, starts, ends))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of ``words`` words; of the whole sequence if it has fewer; empty without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(_BASE) + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(total + np.uint64(0 if n == words else n))

"""Positions of names in page texts, where every character keeps its place in the source.

Plain functions over strings; operators.align runs them over Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from .text import ABBREVIATIONS, LOOKALIKES

SNIPPET_LEAST, SNIPPET_MOST = 10, 100
_SPACES = frozenset(" \t\n\r\f\x0b")
_EDGES = frozenset(" ，,。.；;：:、\"'“”‘’《》<>【】[]")
_BRACKETS = frozenset("()[]【】「」·")
_ALIKE: dict[str, str] = {}  # each character's lookalikes
for _a, _b in LOOKALIKES:
    _ALIKE[_a], _ALIKE[_b] = _ALIKE.get(_a, "") + _b, _ALIKE.get(_b, "") + _a
_SHORT = re.compile(rf"(?:^|[ ,.])(?:{'|'.join(ABBREVIATIONS)})\Z", re.I)


class Hit(NamedTuple):
    start: int  # in the normal form
    stop: int
    source_start: int
    source_stop: int


def is_cjk(c: str) -> bool:
    return "一" <= c <= "鿿" or "㐀" <= c <= "䶿"


def fold(c: str) -> str:
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return {"　": " ", "•": "·", "・": "·"}.get(c, c)


def _glue(c: str) -> bool:
    return is_cjk(c) or c in _BRACKETS or unicodedata.category(c) == "Nd"


def normal_form(text: str) -> tuple[str, list[int]]:
    """Folded text with its white space joined, and each character's place in text."""
    folded = [fold(c) for c in text]
    kept: list[tuple[str, int]] = []
    gap = None  # where a run of white space began
    for k, c in enumerate(folded):
        if c in _SPACES:
            gap = k if gap is None else gap
            continue
        if gap is not None and kept:
            before = kept[-1][0]
            glued = _glue(before) and _glue(c) and (is_cjk(before) or is_cjk(c))
            if not glued:
                kept.append((" ", gap))
        gap = None
        kept.append((c, k))
    return "".join(c for c, _ in kept), [k for _, k in kept]


def _edges(s: str) -> tuple[int, int]:
    a, z = 0, len(s)
    while a < z and s[a] in _EDGES:
        a += 1
    while z > a and s[z - 1] in _EDGES and not (s[z - 1] == "." and _SHORT.search(s[a : z - 1])):
        z -= 1
    return a, z


def repair(text: str | None) -> str:
    s = normal_form(text or "")[0]
    a, z = _edges(s)
    s = s[a:z]
    if len(s) >= 2 and s[0] == "(" and s[-1] == ")":
        s = s[1:-1]
        a, z = _edges(s)
        s = s[a:z]
    return s


def identity(text: str | None) -> str:
    s = repair(text)
    return s[:-1] if len(s) > 2 and s.endswith(".") and _SHORT.search(s[:-1]) else s


name_form = lru_cache(4096)(repair)  # of names, which come again for each page


@lru_cache(4096)
def one_off(name: str) -> re.Pattern | None:
    """What reads like name but for one lookalike; null for fewer than six characters, or where none has a lookalike."""
    ways = [re.escape(name[:k]) + f"[{_ALIKE[c]}]" + re.escape(name[k + 1 :]) for k, c in enumerate(name) if c in _ALIKE]
    return re.compile("|".join(ways)) if ways and len(name) >= 6 else None


def alike(a: str, b: str) -> bool:
    """Equal but for one lookalike, in six characters or more."""
    return len(a) == len(b) and (ways := one_off(b)) is not None and ways.fullmatch(a) is not None


class Page:
    """A page's text with the beginning of the next, normalised once for all names."""

    def __init__(self, text: str | None, head: str | None = None):
        self.own = len(text or "")
        self.source = (text or "") + ("\n" + head if head else "")
        self.norm, self.places = normal_form(self.source)

    def _hit(self, at: int, name: str) -> Hit | None:
        stop = at + len(name)
        a, z = self.places[at], self.places[stop - 1] + 1
        if z < len(self.source) and fold(self.source[z]) == "." and _SHORT.search(name):
            z += 1
        return Hit(at, stop, a, z) if a < self.own else None

    def find(self, name: str | None) -> list[Hit]:
        """Matches one after the other that begin on the page itself."""
        name = name_form(name)
        hits, at = [], self.norm.find(name) if name else -1
        while at >= 0:
            hits.append(self._hit(at, name))
            at = self.norm.find(name, at + len(name))
        return [h for h in hits if h]

    def find_alike(self, name: str | None) -> list[Hit]:
        """Exact matches; without one, stretches that differ by one lookalike."""
        exact, ways = self.find(name), one_off(name_form(name))
        if exact or ways is None:
            return exact
        return [h for m in ways.finditer(self.norm) if (h := self._hit(m.start(), m[0]))]

    def uncovered(self, name: str, others: list[str], loose: bool) -> list[Hit]:
        """Hits of name that no hit of a longer name in others encloses."""
        hits = self.find_alike(name) if loose else self.find(name)
        own = identity(name)
        longer = [o for o in others if len(o) > len(name) and own in identity(o)] if hits else []
        over = [h for o in longer for h in self.find(o)]
        return [h for h in hits if not any(o.start <= h.start and o.stop >= h.stop and o.stop - o.start > h.stop - h.start for o in over)]


def excerpt(source: str, start: int, stop: int) -> str:
    """A repaired stretch of SNIPPET_LEAST to SNIPPET_MOST characters around source[start:stop]."""
    stop = min(stop, len(source))
    if not 0 <= start < stop:
        return ""
    name = around = repair(source[start:stop])
    if not name:
        return ""
    a, z = start, stop
    while len(around) < SNIPPET_MOST and (a > 0 or z < len(source)):
        step = max(8, SNIPPET_MOST - len(around))
        a, z = max(0, a - step), min(len(source), z + step)
        around = repair(source[a:z])
    at = around.find(name)
    if at < 0:
        around, at = name, 0
    if len(around) <= SNIPPET_MOST:
        return around
    if len(name) >= SNIPPET_MOST:
        return name[:SNIPPET_MOST]
    begin = max(0, at - (SNIPPET_MOST - len(name)) // 2)
    begin = min(begin, len(around) - SNIPPET_MOST)
    return around[begin : begin + SNIPPET_MOST]


def prefer_corrected(snippet: str, name: str) -> str:
    """snippet with its lookalike stretches of name written as name."""
    name = name_form(name)
    ways = one_off(name)
    return snippet if ways is None or name in snippet else ways.sub(lambda _: name, snippet)

"""Tokens of the query language.

Keywords may be in any case, and a semicolon is optional. A minus is a token of its own, so "5-3" is a difference;
with hyphens=True names may hold hyphens, as in the original notation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from millrace.errors import QueryError

# The words of the language.
KEYWORDS = frozenset("CREATE TABLE INTEGER DOUBLE STRING HEAP SORTED ON INSERT INTO DROP SET OUTPUT SELECT FROM WHERE SUM AND GROUP DISTINCT BY OR AS QUIT".split())
SYMBOLS = "()<>=+-*/,;"

_WORD = r"[A-Za-z][A-Za-z0-9_{}]*"


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, int, float, string, symbol or end
    text: str
    at: int


def _pattern(hyphens: bool) -> re.Pattern:
    word = _WORD.format("-" if hyphens else "")
    return re.compile(rf"(?P<space>\s+)|(?P<float>\d+\.\d*)|(?P<int>\d+)|(?P<name>{word}(?:\.{word})?)|'(?P<string>(?:[^'\\\n]|\\.)*)'|(?P<symbol>[{re.escape(SYMBOLS)}])")


_PATTERNS = {hyphens: _pattern(hyphens) for hyphens in (False, True)}


def tokenize(text: str, hyphens: bool = False) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        found = _PATTERNS[hyphens].match(text, at)
        if not found:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind, value = found.lastgroup, found[found.lastgroup]
        if kind == "name" and value.upper() in KEYWORDS:
            kind, value = "keyword", value.upper()
        if kind != "space":
            out.append(Token(kind, value, at))
        at = found.end()
    out.append(Token("end", "", len(text)))
    return out

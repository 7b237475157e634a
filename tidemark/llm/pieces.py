"""Splitting texts by a tokenizer's pattern.

Patterns are given with ``\\p{L}``, ``\\p{N}``, ``\\s`` and ``\\S``, which the ``regex`` module knows.  Most texts hold only
characters of a few Unicode blocks, whose classes have long been settled; for these the same pattern with the classes
written out runs in Python's own ``re``, about twice as fast.  Other texts take the ``regex`` module.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

#: Latin, general punctuation and currency signs.
BLOCKS = ((0x0, 0x250), (0x1E00, 0x1F00), (0x2010, 0x2028), (0x20A0, 0x20C0))
SPACES = r"\t-\r\x20\x85\xa0"
PLAIN = re.compile("[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in BLOCKS) + "]*")


def _members(kind: str) -> str:
    """Characters of BLOCKS whose category begins with ``kind``, as the inside of a class."""
    return "".join(re.escape(chr(c)) for a, b in BLOCKS for c in range(a, b) if unicodedata.category(chr(c))[0] == kind)


@lru_cache
def splitter(pattern: str):
    """(fast pattern for plain texts, pattern for all texts)."""
    inside = {r"\p{L}": _members("L"), r"\p{N}": _members("N"), r"\s": SPACES}
    classes = r"\\p\{[LN]\}|\\s|\\S"

    def outside(m: re.Match) -> str:
        if m[0][0] == "[":
            return re.sub(classes, lambda x: inside[x[0]], m[0])
        return f"[^{SPACES}]" if m[0] == r"\S" else f"[{inside[m[0]]}]"

    return re.compile(re.sub(rf"\[[^\]]*\]|{classes}", outside, pattern)), regex.compile(pattern)


def is_plain(text: str) -> bool:
    try:  # one pass of a fast codec settles most texts
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None


def split(text: str, pattern: str) -> list[str]:
    fast, full = splitter(pattern)
    return (fast if is_plain(text) else full).findall(text)

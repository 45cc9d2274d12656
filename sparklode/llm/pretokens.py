"""Splits text as the public byte-level BPE pattern does, with the standard ``re`` module.

``re`` has no Unicode categories, and its white space is wider than Unicode's White_Space,
so the classes are spelled out once from the categories. Classes without characters beyond
the 16-bit plane compile to a bitmap, so texts without such characters have their own one.
"""

import re
import sys
import unicodedata
from functools import lru_cache

WHITE_SPACE = ("\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f"
               "\\u205f\\u3000")
_PLANE = 0xFFFF


def _ranges(initial: str, top: int) -> str:
    """The code points whose category starts with ``initial``, as ranges of a class."""
    spans, start = [], None
    for point in range(top + 2):
        inside = point <= top and unicodedata.category(chr(point))[0] == initial
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            spans.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(spans)


def _pattern(top: int):
    letter, number, white = _ranges("L", top), _ranges("N", top), WHITE_SPACE
    # Only what starts with an apostrophe has to be tried in the public order.
    return re.compile(
        rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{white}{letter}{number}]+"
        rf"|[{white}]+(?![^{white}])|[{white}]+").findall


@lru_cache(maxsize=1)
def splitter():
    """``text -> list of pre-tokens``, the same as the public pattern gives."""
    near, far = _pattern(_PLANE), _pattern(sys.maxunicode)

    def split(text: str) -> list[str]:
        # Beyond the plane a character takes two 16-bit units.
        return (near if len(text.encode("utf-16-le")) == 2 * len(text) else far)(text)
    return split

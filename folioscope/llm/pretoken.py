"""Parts a text into the words of the byte-level tokenizers.

The libraries part by letters, numbers and white space as Unicode has them. Texts of Latin-1 characters, most of them,
take a pattern with 256 characters to tell apart; others take one built from Python's character table; a text that holds
a code point which that table doesn't know is parted by the tokenizer library itself, whose table may be newer.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

#: White space as Unicode has it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = 0x100


def _class(first: str, top: int) -> str:
    """The code points below ``top`` whose category begins with one of the letters, as ranges of a character class."""
    out, start = [], None
    for c in range(top + 1):
        inside = c < top and unicodedata.category(chr(c))[0] in first if first != "Cn" else c < top and unicodedata.category(chr(c)) == "Cn"
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@cache
def _pattern(top: int) -> re.Pattern:
    letter, number, space = _class("L", top), _class("N", top), SPACE if top > LATIN else r"\t-\r \x85\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


@cache
def _unknown() -> re.Pattern:
    return re.compile(f"[{_class('Cn', 0x110000)}]")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def words(text: str, library) -> list[str]:
    """``library``: text to words, for texts with code points that Python doesn't know."""
    if is_latin(text):
        return _pattern(LATIN).findall(text)
    if _unknown().search(text):
        return library(text)
    return _pattern(0x110000).findall(text)

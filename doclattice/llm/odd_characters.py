"""Characters of which the tokenizer library's tables and those of Python and regex say different things.

Each of the three has the letters, numbers, lower-case forms and combining classes
of another version of Unicode. Texts without such characters are read by Python's
and regex's tables; parts of texts with one are normalised and split by the
library's own parts. The characters are found by asking all of them about every
code point, so they follow whatever versions are installed.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import regex
from tokenizers import Regex, normalizers, pre_tokenizers


def matched(pattern: str, text: str) -> set[str]:
    """The characters of a text that the library's pattern matches."""
    found = pre_tokenizers.Split(Regex(f"(?:{pattern})+"), "removed", invert=True).pre_tokenize_str(text)
    return set("".join(piece for piece, _ in found))


def differing(chars: list[str], around: str, ours, theirs) -> set[str]:
    """The characters for which two functions of a text differ. around: a text with {}; line feeds keep the texts apart."""
    before, after = around.split("{}")
    text = before + f"{after}\n{before}".join(chars) + after
    if ours(text) == theirs(text):
        return set()
    return {c for c, a, b in zip(chars, ours(text).split("\n"), theirs(text).split("\n"), strict=True) if a != b}


@functools.cache
def odd_characters() -> str:
    nfc, lower = normalizers.NFC(), normalizers.Lowercase()
    by_python = lambda t: unicodedata.normalize("NFC", t)
    out: set[str] = set()
    letter, number = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")
    for start in range(0, 0x110000, 0x2000):
        chars = [chr(c) for c in range(start, start + 0x2000) if not 0xD800 <= c < 0xE000 and c not in (10, 13)]
        if not chars:
            continue
        text = "".join(chars)
        letters = matched(r"\p{L}", text)
        out |= letters ^ set("".join(letter.findall(text)))
        out |= letters ^ set(filter(str.isalpha, chars))
        out |= matched(r"\p{N}", text) ^ set("".join(number.findall(text)))
        out |= differing(chars, "{}", str.lower, lower.normalize_str)
        # A mark is told by how it is ordered among marks of other classes, below and above.
        for around in ("{}", "a{}̣́", "ạ́{}̣"):
            out |= differing(chars, around, by_python, nfc.normalize_str)
        # Compositions that only one of them knows.
        parts = [unicodedata.normalize("NFD", c) for c in chars if unicodedata.decomposition(c)[:1] not in ("", "<")]
        for p in parts:
            if by_python(p) != nfc.normalize_str(p):
                out.update(p[1:])
    return "".join(sorted(c for c in out if ord(c) >= 128))


def pattern_of(chars: str) -> re.Pattern | None:
    """Finds one of the characters; runs of code points as ranges."""
    ranges: list[list[int]] = []
    for c in map(ord, sorted(chars)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges) + "]") if ranges else None


class Library:
    """The library's normalisation and splits, for parts of texts with odd characters."""

    def __init__(self, odd: str | None, pattern: str | None = None) -> None:
        self.at = pattern_of(odd_characters() if odd is None else odd)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True) if pattern is None else pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def odd(self, text: str) -> bool:
        return self.at is not None and not text.isascii() and self.at.search(text) is not None

    def pieces(self, text: str) -> list[str]:
        return [piece for piece, _ in self.split.pre_tokenize_str(text)]

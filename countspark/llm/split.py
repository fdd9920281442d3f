"""Splitting texts into the pieces that a tokenizer's pattern gives, with a faster equal pattern for plain Latin texts."""

from __future__ import annotations

import re

import regex

# Characters on which the standard library's classes and the Unicode properties of the patterns agree.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ſ‘’“”–—…¡¿«»]")
# What the two public patterns say, in classes that the standard library has.
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_BPE = re.compile(rf"{_SUFFIX}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_BPE = re.compile(rf"{_SUFFIX}|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_WORD_BPE_LINES = re.compile(_WORD_BPE.pattern + r"|\n")


def usual(text: str) -> bool:
    return not _UNUSUAL.search(text)


def byte_bpe_pieces(pattern: str):
    """A function from a text to the list of the pattern's matches; pattern: of the byte-level vocabularies."""
    whole = regex.compile(pattern)
    return lambda text: (_BYTE_BPE if usual(text) else whole).findall(text)


def word_bpe_pieces(text: str, marks: bool = False) -> list[str]:
    """The pieces of a lower-cased text for which usual() holds; marks: ends of lines, too."""
    return (_WORD_BPE_LINES if marks else _WORD_BPE).findall(text)

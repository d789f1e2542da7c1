"""Cutting texts where a tokenizer's own pattern is sure to cut, so that distinct pieces are encoded once.

Every tokenizer used here starts a new match at white space that follows a visible character. A text without two
adjacent white-space characters may thus be cut before each space and newline, other texts before each run of white
space, and the ids of a text are the ids of its pieces in order.
"""

from __future__ import annotations

import regex

_SPACE = "\t-\r \x85\xa0  -     　"
_ADJACENT = regex.compile(f"[{_SPACE}][{_SPACE}]")
_RUNS = regex.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def pieces_of(text: str) -> list[str]:
    """Pieces of a text. The text is their concatenation."""
    if not text:
        return []
    if _ADJACENT.search(text):
        return _RUNS.findall(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    pieces = [x if x[:1] == "\n" else " " + x for x in rest]
    if first:
        pieces.insert(0, first)
    return pieces

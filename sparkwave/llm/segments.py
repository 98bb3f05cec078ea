"""Cutting texts where byte-level tokenizers cannot see across, and caches per piece.

Pre-tokens never run from a character that is not white space into white space, so
a text falls into segments (leading white space, then other characters) that are
tokenized one by one with the same result as the whole. Strings that a vocabulary
lists as added tokens hold no white space and are looked for first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed value: the published pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Where a text can be cut for certain: after the left character, before the right one.
_BORDER = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

segments: Callable[[str], list[str]] = _SEGMENT.findall


def first_border(text: str) -> int | None:
    found = _BORDER.search(text)
    return found.start() if found else None


def last_border(text: str) -> int | None:
    """The last border, searched in growing windows from the end."""
    width = 256
    while True:
        begin = max(0, len(text) - width)
        at = None
        for found in _BORDER.finditer(text, begin):
            at = found.start()
        if at is not None or not begin:
            return at
        width *= 16


class Cache(dict):
    """A dictionary that fills itself from ``make``, in two generations.

    At ``limit`` entries the older generation is forgotten; what is asked for again moves to the younger one.
    """

    def __init__(self, make: Callable[[str], object], limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def known(self, key: str) -> bool:
        return key in self or key in self.older

    def put(self, key: str, value: object) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value


def between(text: str, special: Iterable[str]) -> Iterable[tuple[str, bool]]:
    """Pieces of the text in order, and whether each is one of the ``special`` strings (longest first at a place)."""
    marks = sorted(special, key=len, reverse=True)
    if not any(m in text for m in marks):
        yield text, False
        return
    for piece in re.split("(" + "|".join(map(re.escape, marks)) + ")", text):
        if piece:
            yield piece, piece in marks

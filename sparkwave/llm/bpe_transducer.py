"""A byte-pair tokenizer compiled, state by state, into a deterministic transducer.

Byte-pair encoding has two properties that make it finite-state: any run of
neighbouring tokens of an encoding is itself an encoding, and a sequence of tokens
is an encoding exactly when every two neighbours are one. So the encoding of a
prefix ends in the one token whose neighbour before it fits, and all that matters
for later bytes is, for every suffix that some token could still extend, the last
token before that suffix and how many tokens fewer it has than the whole prefix.
These lists are the states. Reading a byte leads to one next state, and the
transition carries the change of the token count (it may be negative: two tokens
can turn into one). States and transitions are made when first met.
"""

from __future__ import annotations

import json
from functools import lru_cache

_START = -1


def byte_letters() -> dict[str, int]:
    """The published letters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + k)] = b
    return letters


class Vocabulary:
    """Tokens as bytes, ranks of the merges, and the strings that are tokens by themselves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.token = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            key = (self.ids[a], self.ids[b])
            self.rank[key] = k
            self.merged[key] = self.ids[a + b]
        self.special = [t["content"] for t in spec.get("added_tokens") or []]

    def encode(self, word: bytes) -> list[int]:
        """Plain byte-pair encoding of a short word: merge the best-ranked pair, leftmost first."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(pair, none) for pair in zip(out, out[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            out[i : i + 2] = [self.merged[out[i], out[i + 1]]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((out[i - 1], out[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((out[i], out[i + 1]), none)
        return out


class Transducer:
    """Counts tokens of words by walking transitions ``(state, byte) -> (next state, change of the count)``."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = 200_000):
        self.v = vocabulary
        self.max_states = max_states
        self.begun = {t[:k] for t in vocabulary.ids for k in range(1, len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = ((b"", _START, 0),)
        self.start: dict = {}
        self.table = {start: self.start}
        self.keys = {id(self.start): start}

    def _fit(self, a: int, b: int) -> bool:
        if a == _START:
            return True
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[a, b] = self.v.encode(self.v.token[a] + self.v.token[b]) == [a, b]
        return known

    def _step(self, node: dict, byte: int) -> tuple[dict, int]:
        """The transition of a byte that this state has not read before."""
        b = bytes((byte,))
        open_now, last, less = [], None, 0
        for suffix, before, fewer in self.keys[id(node)]:
            longer = suffix + b
            if last is None and (token := self.v.ids.get(longer)) is not None and self._fit(before, token):
                last, less = token, fewer + 1
            if longer in self.begun:
                open_now.append((longer, before, fewer))
        key = (*((s, t, c - less) for s, t, c in open_now), (b"", last, 0))
        following = self.table.get(key)
        if following is None:
            following = self.table[key] = {}
            self.keys[id(following)] = key
        node[byte] = step = (following, less)
        return step

    def count(self, word: bytes) -> int:
        if len(self.table) > self.max_states:
            self._clear()
        node, total = self.start, 0
        for byte in word:
            step = node.get(byte)
            if step is None:
                step = self._step(node, byte)
            node, change = step
            total += change
        return total


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, compiled once per Python process."""
    return Transducer(Vocabulary(path))

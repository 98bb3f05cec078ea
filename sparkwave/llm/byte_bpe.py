"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is an encoding exactly when every two neighbours are one, and
every prefix of a word has one encoding. So a prefix has one last token: of the tokens
that the prefix ends with, the one that fits the last token of what lies before it.
An automaton over the tokens with suffix links names all tokens that end at a byte; two
tokens fit when their joined bytes are encoded as just these two. The last tokens are
stored for all prefixes, and following them back from the end gives the ids.

The work of a word grows with its length times the tokens that end at a byte, and so
words of any length are encoded whole. The words of a batch go through the automaton
together, byte by byte; a long word goes alone. What a stretch of text gave is remembered
(``remember`` stretches of a Python process at most; 0 remembers nothing and gives the
same ids).

One scan and no shuffle; memory is bounded by one Arrow batch of documents.

Defined results: a null or empty text has no ids and decodes to the empty text. Rows are
handled one by one; null and repeated ids are kept, other columns left out. Strings that
the vocabulary lists as added tokens are tokens by themselves, longest first at a place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.bpe_transducer import Vocabulary
from sparkwave.llm.common import map_batches, text_of
from sparkwave.llm.segments import PRE_TOKEN, Cache, between, segments

REMEMBER = 400_000
#: Pairs of tokens whose fit is remembered.
PAIRS = 1_000_000
#: Bytes of a word that goes through the automaton together with others, and how many go together.
SHORT, TOGETHER = 48, 2048
#: Characters of the texts that are encoded together.
CHARS = 2_000_000


class Endings:
    """The tokens that end at each byte: a table ``(state, byte) -> state`` and the tokens of every state.

    A state is the longest beginning of a token that the bytes so far end with; its suffix
    link is the next shorter one, and the transitions of missing bytes are those of the link.
    """

    def __init__(self, tokens: dict[bytes, int]):
        trie: list[dict[int, int]] = [{}]
        depth, own = [0], [-1]
        for token, i in tokens.items():
            at = 0
            for b in token:
                following = trie[at].get(b)
                if following is None:
                    following = trie[at][b] = len(trie)
                    trie.append({})
                    depth.append(depth[at] + 1)
                    own.append(-1)
                at = following
            own[at] = i
        states = len(trie)
        edges = np.array([(depth[s], s, b, t) for s, found in enumerate(trie) for b, t in found.items()], np.int64).reshape(-1, 4)
        edges = edges[np.argsort(edges[:, 0], kind="stable")]
        self.next = np.zeros((states, 256), np.int32)
        link, token = np.zeros(states, np.int32), np.array(own, np.int32)
        #: the nearest state with a token on the way along the links, the state itself left out
        shorter = np.zeros(states, np.int32)
        level = np.array([0])
        for d in range(int(edges[-1, 0]) + 1 if len(edges) else 0):
            if d:
                self.next[level] = self.next[link[level]]
            _, s, b, t = edges[np.searchsorted(edges[:, 0], d) : np.searchsorted(edges[:, 0], d, "right")].T
            link[t] = self.next[link[s], b] if d else 0
            self.next[s, b] = t
            shorter[t] = np.where(token[link[t]] >= 0, link[t], shorter[link[t]])
            level = t
        if len(level):
            self.next[level] = self.next[link[level]]
        # tokens of all states, one range per state
        at, rows, found = np.where(token >= 0, np.arange(states), shorter), [], []
        state = np.arange(states)
        while len(state := state[at > 0]):
            at = at[at > 0]
            rows.append(state)
            found.append(token[at])
            at = shorter[at]
        rows, found = np.concatenate(rows or [[]]).astype(np.int64), np.concatenate(found or [[]])
        order = np.argsort(rows, kind="stable")
        self.tokens = found[order].astype(np.int32)
        self.count = np.bincount(rows, minlength=states).astype(np.int32)
        self.start = (np.cumsum(self.count) - self.count).astype(np.int32)


class PrefixEncoder:
    """Encodes and decodes with a byte-level vocabulary file that holds all 256 bytes."""

    def __init__(self, path: str, remember: int = REMEMBER):
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}
        self.vocabulary = v = Vocabulary(path)
        if any(bytes((b,)) not in v.ids for b in range(256)):
            raise ValueError("the vocabulary lacks some byte")
        self.special = {t: np.array([i], "<i4").tobytes() for t, i in added.items()}
        #: stands before the first token of a word
        self.none = 1 + max([*v.token, *added.values()])
        self.bytes = [v.token.get(i, b"") for i in range(self.none)]
        for t, i in added.items():
            self.bytes[i] = t.encode("utf-8")
        self.length = np.array([len(t) for t in self.bytes], np.int32)
        self.endings = Endings(v.ids)
        self.pairs: dict[int, bool] = {}
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.remembered = Cache(lambda s: self._compile([s])[0], remember) if remember else None

    def _fits(self, pair: int) -> bool:
        """Whether two tokens, or a first token, are their own encoding."""
        a, b = divmod(pair, self.none + 1)
        if a == self.none:
            fits = self.vocabulary.encode(self.bytes[b]) == [b]
        else:
            fits = self.vocabulary.encode(self.bytes[a] + self.bytes[b]) == [a, b]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = fits
        return fits

    def _long(self, word: bytes) -> list[int]:
        e, known, length, none = self.endings, self.pairs, self.length, self.none
        step, start, count, tokens = e.next.item, e.start.item, e.count.item, e.tokens.item
        state, last = 0, [none] + [-1] * len(word)
        for end, byte in enumerate(word, 1):
            state = step(state, byte)
            first = start(state)
            for k in range(first, first + count(state)):
                token = tokens(k)
                pair = last[end - length.item(token)] * (none + 1) + token
                fits = known.get(pair)
                if self._fits(pair) if fits is None else fits:
                    last[end] = token
                    break
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= length.item(last[at])
        return out[::-1]

    def _together(self, words: list[bytes]) -> Iterator[bytes]:
        """Short words, longest first: the last tokens of all prefixes of one length at a time."""
        e, length, none, known = self.endings, self.length, self.none, self.pairs.get
        size = np.array([len(w) for w in words])
        longest = int(size[0])
        letters = np.frombuffer(b"".join([w.ljust(longest, b"\0") for w in words]), np.uint8).reshape(-1, longest)
        last = np.full((len(words), longest + 1), -1, np.int32)
        last[:, 0] = none
        state = np.zeros(len(words), np.int32)
        for end in range(1, longest + 1):
            n = int(np.searchsorted(-size, -end, "right"))
            state = e.next[state[:n], letters[:n, end - 1]]
            count = e.count[state]
            row = np.repeat(np.arange(n), count)
            token = e.tokens[np.arange(len(row)) + np.repeat(e.start[state] - (np.cumsum(count) - count), count)]
            pair = (last[row, end - length[token]].astype(np.int64) * (none + 1) + token).tolist()
            fits = list(map(known, pair))
            if None in fits:
                fits = [self._fits(p) if f is None else f for p, f in zip(pair, fits)]
            fits = np.array(fits, bool)
            last[row[fits], end] = token[fits]
        # back from the ends, all words at once
        columns, at, row = [], size.copy(), np.arange(len(words))
        while at.any():
            token = np.where(at > 0, last[row, at], -1)
            columns.append(token)
            at = at - np.where(at > 0, length[token], 0)
        back = np.stack(columns[::-1], axis=1)
        found = back >= 0
        ids, ends = back[found].astype("<i4").tobytes(), (4 * np.cumsum(found.sum(axis=1))).tolist()
        return map(lambda begin, end: ids[begin:end], [0, *ends], ends)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of every word."""
        out = [b""] * len(words)
        short = []
        for k in sorted(range(len(words)), key=lambda k: -len(words[k])):
            if len(words[k]) > SHORT:
                out[k] = np.array(self._long(words[k]), "<i4").tobytes()
            elif words[k]:
                short.append(k)
        for begin in range(0, len(short), TOGETHER):
            part = short[begin : begin + TOGETHER]
            for k, ids in zip(part, self._together([words[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _compile(self, stretches: list[str]) -> list[bytes]:
        # a space and letters are one word for certain
        split = [[s] if s[0] == " " and s.isascii() and s[1:].isalpha() else self.pre_tokens(s) for s in stretches]
        distinct = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(distinct, self.words([w.encode("utf-8") for w in distinct]), strict=True))
        return [ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for words in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian 32-bit integers."""
        special, cache = self.special, self.remembered
        split: list[list[tuple[list[str], bytes]]] = []
        for text in texts:
            alone = any(s in text for s in special)
            split.append([([], special[p]) if s else (segments(p), b"") for p, s in between(text, special)] if alone else [(segments(text), b"")])
        distinct = dict.fromkeys(chain.from_iterable(found for parts in split for found, _ in parts))
        made = {} if cache is None else {s: ids for s in distinct if (ids := dict.get(cache, s) or cache.older.get(s))}
        new = [s for s in distinct if s not in made]
        made.update(zip(new, self._compile(new), strict=True))
        if cache is not None:
            for s, ids in made.items():
                if s not in cache:
                    cache.put(s, ids)
        get = made.__getitem__
        return [b"".join([mark or b"".join(map(get, found)) for found, mark in parts]) for parts in split]

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, remember: int = REMEMBER) -> PrefixEncoder:
    """One per Python process, so that what it remembers lasts over batches and tasks."""
    return PrefixEncoder(path, remember)


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of ``CHARS`` characters and a text."""
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= CHARS:
            yield part
            part, chars = [], 0
    yield part


def encode(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """One row per row of ``df``: the id, ``ids`` (array of int) and ``decoded``, the text that the ids decode to.

    ``tokenizer`` is the path of a byte-level vocabulary file, present on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, remember)
        for batch in batches:
            begin = 0
            for texts in together(batch["t"].to_pylist()):
                found = [np.frombuffer(x, "<i4") for x in e.encode(texts)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, "<i4")])))
                decoded = pa.array([e.decode(x.tolist()) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch["id"].slice(begin, len(texts)), ids, decoded], ["id", "ids", "decoded"])
                begin += len(texts)

    kind = df.schema[id].dataType.simpleString()
    docs = df.select(F.col(id).alias("id"), text_of(text).alias("t"))
    return map_batches(docs, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id)


def decode(df: DataFrame, tokenizer: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``df``: the id and ``text``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            texts = pa.array([e.decode(x or []) for x in batch["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], texts], ["id", "text"])

    kind = df.schema[id].dataType.simpleString()
    listed = df.select(F.col(id).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return map_batches(listed, run, f"id {kind}, text string").withColumnRenamed("id", id)

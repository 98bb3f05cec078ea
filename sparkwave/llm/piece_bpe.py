"""SentencePiece encoding and decoding for merge-type vocabularies.

Symbols start as single characters. An agenda holds every adjacent pair whose
concatenation is a piece, ordered by score and then from the left; the best pair
is merged, and the pairs it forms with its neighbours join the agenda. Characters
outside the vocabulary become their UTF-8 bytes.

No merge crosses a place where the two neighbouring characters never meet inside
any piece. Vocabularies trained on words never hold a space mark after another
character, so texts are cut there and the agenda's result is remembered per word.
Words that are new go through their agendas side by side: each step merges the best
pair of every one of them.

Arrow batches are checked against the ``sentencepiece`` library: every word when it
is first met, and the ids and decoded text of every ``WHOLE_EVERY``-th document as a
whole. Should they differ, the library's are used and ``agrees`` is false for that row;
it is true where the whole text was compared, and null where only its words were.

Defined results: a null text counts as empty, which has only the begin and end ids.
Rows are handled one by one; null and repeated ids are kept, other columns left out.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress
from operator import itemgetter, not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.llm.common import map_batches, text_of
from sparkwave.llm.segments import Cache

SPACE_MARK = "▁"
WHOLE_EVERY = 16
_WORD = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*")
#: Characters of a word that is merged beside others or by a plain list; longer ones go through a heap.
SHORT = 48
#: Words merged side by side, and the fewest for which that pays.
TOGETHER, FEW = 4096, 32
#: An agenda entry is a rank and a place below PLACES; NEVER is a pair that is no piece.
PLACES = 64
NEVER = np.int32(2**31 - 1)


class Pairs:
    """Pairs of pieces whose concatenation is a piece, in an open hash table: the agenda's rank and the id of what they become."""

    def __init__(self, ids: dict[str, int], score: dict[str, float]):
        ranks = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for name, whole in ids.items():
            for i in range(1, len(name)):
                if (a := ids.get(name[:i])) is not None and (b := ids.get(name[i:])) is not None:
                    pairs[a << 32 | b] = ranks[score[name]], whole
        self.bits = max(8, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank, self.whole = np.full(size, NEVER, np.int32), np.zeros(size, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for k, at, (rank, whole) in zip(keys.tolist(), self._place(keys).tolist(), pairs.values(), strict=True):
            while self.key[at] >= 0:
                at = (at + 1) % size
            self.key[at], self.rank[at], self.whole[at] = k, rank * PLACES, whole

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For neighbours ``a`` and ``b``: rank times PLACES (or NEVER), and the id of the piece."""
        keys = a.astype(np.int64) << 32 | b
        at = self._place(keys)
        held = self.key[at]
        rank, whole = np.where(held == keys, self.rank[at], NEVER), self.whole[at]
        todo = np.nonzero((held != keys) & (held >= 0))
        while todo[0].size:
            at[todo] = (at[todo] + 1) % len(self.key)
            held, asked = self.key[at[todo]], keys[todo]
            hit = held == asked
            rank[todo] = np.where(hit, self.rank[at[todo]], NEVER)
            whole[todo] = self.whole[at[todo]]
            more = ~hit & (held >= 0)
            todo = tuple(x[more] for x in todo)
        return rank, whole


class Pieces:
    """A merge-type vocabulary with its encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(len(sp))]
        usual = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in usual}
        self.score = {names[i]: sp.get_score(i) for i in usual}
        self.unknown = sp.unk_id()
        self.byte = {int(names[i][3:5], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        # bytes stand as characters that a whole text's decoding resolves
        self.text = [n.replace(SPACE_MARK, " ") for n in names]
        for b, i in self.byte.items():
            self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        for i in range(len(sp)):
            if sp.is_control(i):
                self.text[i] = ""
        if sp.is_unknown(self.unknown):
            self.text[self.unknown] = " ⁇ "
        self.pairs = Pairs(self.ids, self.score)
        # single characters, and bytes that stand for a character by themselves; what is neither has id -1
        self.first = np.full(0x110000, -1, np.int32)
        for b, i in self.byte.items():
            if b < 128:
                self.first[b] = i
        for name, i in self.ids.items():
            if len(name) == 1:
                self.first[ord(name)] = i
        self.width = np.array([len(t) for t in self.text])
        self.is_byte = np.zeros(len(sp), bool)
        self.is_byte[[i for b, i in self.byte.items() if b >= 128]] = True
        self.crossing = any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", n) for n in self.ids)
        self.cache = Cache(lambda w: self._compile([w])[w])
        self.disputed: set[str] = set()

    def cut(self, text: str) -> list[str]:
        """The words of a text that is not empty, each without the space mark that it begins with."""
        if not self.crossing and SPACE_MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = text.replace(" ", SPACE_MARK)
        return [marked] if self.crossing else [w[1:] for w in _WORD.findall(SPACE_MARK + marked)]

    def _compile(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids of words met for the first time and what they decode to; the library is asked for all of them at once."""
        if not words:
            return {}
        marked, ids, ends = self._merge_all([SPACE_MARK + w for w in words])
        words = [w[1:] for w in marked]
        # the library puts the first space mark in front by itself, and nothing for an empty text
        asked = [k for k, w in enumerate(words) if w]
        theirs = self.library.encode([words[k].replace(SPACE_MARK, " ") for k in asked], num_threads=1)
        cuts = [0, *ends.tolist()]
        own = ids.tolist()
        wrong = {}
        if len(asked) < len(words) or list(chain.from_iterable(theirs)) != own or list(accumulate(map(len, theirs))) != cuts[1:]:
            wrong = {k: t for k, t in zip(asked, theirs, strict=True) if t != own[cuts[k] : cuts[k + 1]]}
        blob, text = ids.astype("<u4").tobytes(), "".join(map(self.text.__getitem__, own))
        places = np.concatenate([[0], np.cumsum(self.width[ids])])[cuts].tolist()
        made = {w: (blob[4 * a : 4 * b], text[c:d]) for w, a, b, c, d in zip(words, cuts, cuts[1:], places, places[1:])}
        # no character's bytes lie in two words
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(self.is_byte[ids]), side="right")).tolist():
            made[words[k]] = made[words[k]][0], self._joined(own[cuts[k] : cuts[k + 1]])
        for k, t in wrong.items():
            self.disputed.add(words[k])
            made[words[k]] = np.array(t, "<u4").tobytes(), self._joined(t)
        return made

    def _merge_all(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words (one at least) in another order, the ids of all of them one after the other, and where each word's ids end."""
        words = sorted(words, key=len)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        first = self.first[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        beside = (lengths <= SHORT) & (np.minimum.reduceat(first, starts) >= 0)
        if beside.sum() < FEW:
            beside[:] = False
        many, alone = np.flatnonzero(beside), np.flatnonzero(~beside)
        parts = [many[k : k + TOGETHER] for k in range(0, len(many), TOGETHER)]
        found = [self._side_by_side(first, starts[at], lengths[at]) for at in parts]
        for k in alone.tolist():
            ids = self.merge(words[k])
            found.append((np.array(ids, np.int32), np.array([len(ids)])))
        words = [words[k] for k in chain(many.tolist(), alone.tolist())]
        ids, counts = zip(*found)
        return words, np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _side_by_side(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most SHORT characters, and how many each has. Tables have a row per place and a column per word; the last row is no place."""
        n, longest = len(starts), int(lengths.max())
        word = np.repeat(np.arange(n), lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols = symbols[np.repeat(starts, lengths) + place]
        cell = place * n + word
        held = np.full((longest + 1) * n, -1, np.int32)
        held[cell] = symbols
        agenda, whole = np.full((longest + 1) * n, NEVER), np.zeros((longest + 1) * n, np.int32)
        rank, made = self.pairs.find(symbols[:-1], symbols[1:])
        rank[word[1:] != word[:-1]] = NEVER
        agenda[cell[:-1]], whole[cell[:-1]] = rank | place[:-1], made
        # neighbours, as places
        right = np.repeat(np.arange(1, longest + 2, dtype=np.int32), n)
        left = np.repeat(np.array([longest, *range(longest)], np.int32), n)
        while (w := np.flatnonzero((best := agenda.reshape(-1, n).min(axis=0)) != NEVER)).size:
            i = best[w] & (PLACES - 1)
            at = i * n + w
            j = right[at] * n + w
            h, k = left[at], right[j]
            before, after, m = h * n + w, k * n + w, whole[at]
            held[at], held[j], agenda[j] = m, -1, NEVER
            right[at], left[after] = k, i
            rank, made = self.pairs.find(np.concatenate([held[before], m]), np.concatenate([m, held[after]]))
            agenda[before], whole[before] = rank[: len(w)] | h, made[: len(w)]
            agenda[at], whole[at] = rank[len(w) :] | i, made[len(w) :]
        held = held.reshape(-1, n).T
        left_over = held >= 0
        return held[left_over], left_over.sum(axis=1)

    def merge(self, text: str) -> list[int]:
        return self._ids(self._short(list(text)) if len(text) <= SHORT else self._long(list(text)))

    def _short(self, symbols: list[str]) -> list[str]:
        """The agenda of a short word by itself is a plain list, one score per adjacent pair."""
        score, none = self.score.get, float("-inf")
        agenda = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := max(agenda)) != none:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], none)
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], none)
        return symbols

    def _long(self, characters: list[str]) -> list[str]:
        """The agenda of a long stretch is a heap."""
        symbols: list[str | None] = list(characters)
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (joined := symbols[i] + symbols[j]) in self.ids:
                heapq.heappush(agenda, (-self.score[joined], i, j, joined))

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            propose(left[i], i)
            propose(i, right[i])
        return [s for s in symbols if s is not None]

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            if s in self.ids:
                out.append(self.ids[s])
            elif self.byte:
                out.extend(self.byte[b] for b in s.encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """For every text its ids with the begin and end ids, as little-endian unsigned 32-bit integers, what they decode to, and whether no word is disputed."""
        split = [self.cut(t) if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        found = list(map(self.cache.get, words))
        unknown = dict.fromkeys(compress(words, map(not_, found)))
        made = {w: known for w in unknown if (known := self.cache.older.get(w))}
        made |= self._compile([w for w in unknown if w not in made])
        for w, value in made.items():
            self.cache.put(w, value)
        found = [f or made[w] for w, f in zip(words, found)]
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        blob, shown = itemgetter(0), itemgetter(1)
        out, at = [], 0
        for words in split:
            part = found[at : (at := at + len(words))]
            text = "".join(map(shown, part))
            agree = not self.disputed or self.disputed.isdisjoint(words)
            out.append((b"".join([begin, *map(blob, part), end]), text[1:] if text.startswith(" ") else text, agree))
        return out

    def _joined(self, ids: list[int]) -> str:
        text = "".join(map(self.text.__getitem__, ids))
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self._joined(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``ids`` (binary, as above), ``decoded`` and ``agrees``.

    ``model`` is the path of a vocabulary file, present on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = pieces(model), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts, blobs, decoded, agrees = part["t"].to_pylist(), [], [], []
                for t, (ids, back, agree) in zip(texts, p.encode(texts), strict=True):
                    seen += 1
                    if seen % WHOLE_EVERY == 0:
                        theirs = p.library.encode(t, add_bos=True, add_eos=True)
                        shown, whole = p.library.decode(theirs), np.array(theirs, "<u4").tobytes()
                        if whole != ids or shown != back:
                            ids, back, agree = whole, shown, False
                    elif agree:
                        agree = None
                    blobs.append(ids)
                    decoded.append(back)
                    agrees.append(agree)
                made = [pa.array(blobs, pa.binary()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part["id"], *made], ["id", "ids", "decoded", "agrees"])

    kind = df.schema[id].dataType.simpleString()
    docs = df.select(F.col(id).alias("id"), text_of(text).alias("t"))
    return map_batches(docs, run, f"id {kind}, ids binary, decoded string, agrees boolean").withColumnRenamed("id", id)

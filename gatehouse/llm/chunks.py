"""Texts cut into chunks that a tokenizer encodes alike alone and in place, so that a task encodes each distinct chunk once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from gatehouse.llm import common

#: Bits of the table's slots; at half as many chunks, or CODES codes, it starts afresh.
SLOTS, CODES = 21, 1 << 23
#: Bytes of the documents that are encoded together, and texts of the library's calls.
TOGETHER, FEW = 1 << 20, 8


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class ChunkTable:
    """Codes of the chunks that a task has seen, by the 64-bit hash of their bytes, in flat arrays of bounded size.

    encode(raw, start, end, edge) gives the number of codes of each chunk and all codes in order; slots
    is the number of bits of the table's slots.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> None:
        self.encode, self.slots = encode, slots
        self.key, self.at = np.zeros(1 << slots, np.uint64), np.zeros(1 << slots, np.int64)
        self.start, self.size = np.zeros(1 << (slots - 1), np.int64), np.zeros(1 << (slots - 1), np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.n = self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        slot = (keys >> np.uint64(64 - self.slots)).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.key[slot]
            same = held == keys[todo]
            out[todo[same]] = self.at[slot[same]]
            on = ~same & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.slots) - 1)
        return out

    def _put(self, keys: np.ndarray) -> None:
        """Distinct new keys get the places from n on."""
        slot = (keys >> np.uint64(64 - self.slots)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.key[slot] == 0)
            self.key[slot[free]] = keys[todo[free]]
            own = free[self.key[slot[free]] == keys[todo[free]]]
            self.at[slot[own]] = self.n + todo[own]
            left = np.ones(len(todo), bool)
            left[own] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.slots) - 1)

    def codes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of codes of each chunk, and the codes of all of them in order.

        edge marks chunks that a text's beginning or end bounds.
        """
        keys = common.span_hashes(raw, start, end)
        keys[keys == 0] = 1
        at = self._find(keys)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new, first, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            if self.n + len(new) > 1 << (self.slots - 1) or self.used > CODES:
                self.key[:] = 0
                self.n = self.used = 0
                if len(new) > 1 << (self.slots - 1) or len(missed) < len(keys):
                    half = (len(keys) + 1) // 2
                    parts = [self.codes(raw, start[a:b], end[a:b], edge[a:b]) for a, b in ((0, half), (half, len(keys)))]
                    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            some = np.sort(missed[first])
            order = np.argsort(keys[some])
            size, codes = self.encode(raw, start[some], end[some], edge[some])
            while len(self.flat) < self.used + len(codes):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(codes)] = codes
            self.size[self.n : self.n + len(some)] = size[order]
            self.start[self.n : self.n + len(some)] = (self.used + np.cumsum(size) - size)[order]
            self._put(new)
            at[missed] = self.n + back
            self.n += len(some)
            self.used += len(codes)
        size = self.size[at].astype(np.int64)
        return size, self.flat[ragged(self.start[at], size)]


_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
#: First bytes of characters that surely aren't white space.
_BEFORE = _GRAPH.copy()
_BEFORE[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True


def byte_level_cuts(raw: np.ndarray) -> np.ndarray:
    """Where a text for a byte-level vocabulary may be cut: before a space between two characters that surely aren't white space.

    A pre-token boundary always lies there, whatever the text's other parts.
    """
    at = np.flatnonzero(raw == 0x20)
    at = at[(at > 1) & (at < len(raw) - 1)]
    before, two = raw[at - 1], raw[at - 2]
    return at[_BEFORE[raw[at + 1]] & (_GRAPH[before] | ((before >= 0x80) & (before < 0xC0) & _TWO[two]))]


def word_cuts(raw: np.ndarray) -> np.ndarray:
    """Where a text may be cut for pieces that go on behind no space: before each run of spaces but a leading one."""
    at = np.flatnonzero(raw == 0x20)
    at = at[at > 0]
    return at[raw[at - 1] != 0x20]


def runs(start: np.ndarray, end: np.ndarray, together: int):
    """Runs of documents with about so many bytes together, as (from, to)."""
    done = np.cumsum(end - start)
    low = 0
    while low < len(start):
        base = done[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(done, base + together, "right")))
        yield low, high
        low = high


def by_document(column, cuts: Callable[[np.ndarray], np.ndarray], table: ChunkTable, together: int = TOGETHER):
    """For each run of documents of a text column: (from, to, bytes, starts and ends of the documents in them, codes, ends of the documents in the codes)."""
    raw, start, end = common.texts_of(column)
    for low, high in runs(start, end, together):
        sizes = end[low:high] - start[low:high]
        part = raw[start[low] : end[high - 1]] if int(sizes.sum()) == int(end[high - 1] - start[low]) else np.concatenate([raw[a:b] for a, b in zip(start[low:high], end[low:high], strict=True)])
        stops = np.cumsum(sizes)
        begins = stops - sizes
        have = np.flatnonzero(sizes)
        inner = [cuts(part[begins[k] : stops[k]]) + begins[k] for k in have]
        n = np.zeros(len(sizes), np.int64)
        n[have] = [len(x) + 1 for x in inner]
        if not len(have):
            yield low, high, part, begins, stops, np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
            continue
        a = np.concatenate([np.concatenate(([begins[k]], x)) for k, x in zip(have, inner, strict=True)])
        b = np.append(a[1:], stops[have[-1]])
        last = np.cumsum(n[have]) - 1
        edge = np.zeros(len(a), bool)
        edge[last] = edge[np.append(0, last[:-1] + 1)] = True
        size, codes = table.codes(part, a, b, edge)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n)]
        yield low, high, part, begins, stops, codes, ends


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library, used on chunks; every id stands for a fixed number of bytes."""

    def __init__(self, vocabulary: str) -> None:
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; more threads only hold more memory
        self.own = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        size = self.own.get_vocab_size()
        self.bytes = np.array([len(self.own.id_to_token(i)) for i in range(size)], np.int64)

    def encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner chunks may stand in a row as in a text, so they are encoded many together and told apart by the bytes of their ids."""
        inner, outer = np.flatnonzero(~edge), np.flatnonzero(edge)
        lengths = end[inner] - start[inner]
        upto = np.cumsum(lengths)
        index, total = ragged(start[inner], lengths), int(lengths.sum())
        together = raw[index].tobytes()
        stops = upto[np.append(np.flatnonzero(np.diff(upto >> 15)), len(upto) - 1)] if total else upto
        joined = [together[a:b].decode() for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        ids = self._batch(joined)
        places = np.searchsorted(np.cumsum(self.bytes[ids]), upto, "left") + 1
        texts = [raw[start[k] : end[k]].tobytes().decode() for k in outer]
        coded = [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.zeros(len(start), np.int64)
        sizes[inner], sizes[outer] = np.diff(places, prepend=0), list(map(len, coded))
        both = np.concatenate([ids, np.fromiter(chain.from_iterable(coded), np.int32, int(sizes[outer].sum()))])
        own = np.append(inner, outer)
        begins = np.empty(len(start), np.int64)
        begins[own] = np.cumsum(sizes[own]) - sizes[own]
        return sizes, both[ragged(begins, sizes)]

    def _batch(self, texts: list[str]) -> np.ndarray:
        """A few texts at a time, as what the library returns takes many times their size."""
        found = [np.array(e.ids, np.int32) for k in range(0, len(texts), FEW) for e in self.own.encode_batch_fast(texts[k : k + FEW], add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def table(self) -> ChunkTable:
        return ChunkTable(self.encode)

"""Elias-Fano sequences over numpy arrays, with vectorised look-ups, and a trie of n-grams in levels of them, one mapped
file for each trie."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .common import mapped_file, put_file

class EliasFano:
    """A sequence that never falls, of n numbers below `universe`: about 2 + log2(universe / n) bits a number."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high

    @cached_property
    def ones(self) -> np.ndarray:
        """Where the unary part has its ones: the k-th is the k-th number's high part plus k."""
        return np.flatnonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little").view(bool))[: self.n]

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """n, the width of the low parts, the low parts bit by bit, and the high parts in unary."""
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        words = ((universe >> width) + n + 64) // 64 + 1
        high = np.zeros(words, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            part, at = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.int64) * width
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        return n, width, low, high

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        return cls(*cls.parts(values, universe))

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        shift = (at & 63).astype(np.uint64)
        value = self.low[at >> 6] >> shift
        rest = self.low[(at >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63))
        return (value | np.where(shift > 0, rest, np.uint64(0))) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        return (self.ones[i] - i).astype(np.uint64) << np.uint64(self.width) | self.lows(i)

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of the first number of begin..end that is at least x (end if there is none)."""
        lo = np.broadcast_to(np.asarray(begin, np.int64), len(x)).copy()
        hi = np.broadcast_to(np.asarray(self.n if end is None else end, np.int64), len(x)).copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < x[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo


class Trie:
    """Contexts v, under each its contexts u (the word before v) and under these the words w that follow u v. Each level
    is a sequence that never falls: a child is its number plus the place of its parent times the level's span; pointers
    say where each parent's children begin. Beside them lie bytes: codes of the probabilities of v after u and of w after
    u v, and of the weight that u v leaves to shorter contexts."""

    SEQUENCES = ("contexts", "nodes_begin", "nodes", "words_begin", "words")
    CODES = ("backoff", "node_codes", "word_codes")

    @classmethod
    def write(cls, folder: str, name: str, contexts, nodes, words, backoff, node_codes, word_codes) -> list[int]:
        """contexts: ascending; nodes, words: (place of the parent, number), ascending by both; the codes of each.
        Returns what `Trie` needs beside the file: of each sequence its length, width and sizes, then the spans and
        the numbers of codes."""

        def spread(parents, numbers, n):
            span = int(numbers.max()) + 1 if len(numbers) else 1
            return parents.astype(np.uint64) * np.uint64(span) + numbers.astype(np.uint64), max(n, 1) * span, span

        sequences, spans = [(contexts, int(contexts[-1]) + 1 if len(contexts) else 1)], []
        for (parents, numbers), n in ((nodes, len(contexts)), (words, len(nodes[0]))):
            sequences.append((np.searchsorted(parents, np.arange(n + 1)), len(numbers) + 1))
            values, universe, span = spread(parents, numbers, n)
            sequences.append((values, universe))
            spans.append(span)
        head, data = [], []
        for values, universe in sequences:
            n, width, low, high = EliasFano.parts(values, universe)
            head += [n, width, len(low), len(high)]
            data += [low, high]
        codes = [np.concatenate([c.astype(np.uint8), np.zeros(-len(c) % 8, np.uint8)]).view(np.uint64) for c in (backoff, node_codes, word_codes)]
        put_file(folder, name, *data, *codes)
        return [*head, *spans, *map(len, (backoff, node_codes, word_codes))]

    def __init__(self, folder: str, name: str, head: list[int]):
        raw, at = mapped_file(folder, name, np.uint64), 0
        k = 4 * len(self.SEQUENCES)
        for level, (n, width, low, high) in zip(self.SEQUENCES, np.array(head[:k]).reshape(-1, 4).tolist()):
            setattr(self, level, EliasFano(n, width, raw[at : at + low], raw[at + low : at + low + high]))
            at += low + high
        self.spans = head[k : k + 2]
        for level, n in zip(self.CODES, head[k + 2 :]):
            setattr(self, level, raw[at : at + -(-n // 8)].view(np.uint8)[:n])
            at += -(-n // 8)

    def context(self, number: np.ndarray) -> np.ndarray:
        """Places of contexts (-1: none)."""
        at = self.contexts.successor(number.astype(np.uint64))
        return self._if_equal(self.contexts, at, np.full(len(at), self.contexts.n), number.astype(np.uint64))

    def child(self, level: str, parent: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Places, in a level, of numbers under parents (-1: none, or the parent is -1): the successor within the range
        that the parent's pointers give."""
        out = np.full(len(parent), -1, np.int64)
        sequence, begins = getattr(self, level), getattr(self, f"{level}_begin")
        span = self.spans[("nodes", "words").index(level)]
        rows = np.flatnonzero((parent >= 0) & (number < span))
        if len(rows):
            p = parent[rows]
            x = p.astype(np.uint64) * np.uint64(span) + number[rows].astype(np.uint64)
            begin, end = begins.get(p).astype(np.int64), begins.get(p + 1).astype(np.int64)
            out[rows] = self._if_equal(sequence, sequence.successor(x, begin, end), end, x)
        return out

    @staticmethod
    def _if_equal(sequence: EliasFano, at: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
        there = at < end
        there[there] = sequence.get(at[there]) == x[there]
        return np.where(there, at, -1)

    @staticmethod
    def code(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Codes at places; 0 for none."""
        out = np.zeros(len(at), np.uint8)
        there = at >= 0
        out[there] = codes[at[there]]
        return out

"""Run lengths, prefix codes and bit streams."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: The longest run in run-length pairs; the longest run written singly; the longest run of one escape.
MOST_RUN, SINGLY, MOST_ESCAPE = 255, 8, 1024


def runs(symbols: DataFrame) -> DataFrame:
    """symbols(cube_id, pos, s) -> (cube_id, start, s, length): maximal runs within a cube, which is one partition's work."""
    w = Window.partitionBy("cube_id").orderBy("pos")
    new = F.when(F.lag("s").over(w).eqNullSafe(F.col("s")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = symbols.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return marked.groupBy("cube_id", "run").agg(F.min("pos").alias("start"), F.first("s").alias("s"), F.count("*").alias("length")).drop("run")


def run_pairs(symbols: DataFrame) -> DataFrame:
    """Runs of at most MOST_RUN: longer ones come as several."""
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / MOST_RUN))).alias("part")
    split = runs(symbols).select("cube_id", "start", "s", "length", parts)
    return split.select("cube_id", (F.col("start") + F.col("part") * MOST_RUN).alias("start"), "s", F.least(F.lit(MOST_RUN), F.col("length") - F.col("part") * MOST_RUN).alias("length"))


def lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of a prefix code by repeated merging of the two rarest; ties by the least symbol within. One symbol
    alone gets one bit."""
    heap = [(n, s, (s,)) for s, n in sorted(counts.items()) if n > 0]
    out = {s: 0 for _, s, _ in heap}
    if len(heap) == 1:
        return {heap[0][1]: 1}
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: (value, length) by symbol, from lengths alone; the first bit is the value's highest."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def escapes(n: int) -> tuple[int, list[int]]:
    """How a run of the common symbol is written: singles, and exponents of escapes (a run of 8 << e each): the longest
    escape that fits while more than SINGLY are left."""
    out = []
    while n > SINGLY:
        e = min(n, MOST_ESCAPE).bit_length() - 4
        out.append(e)
        n -= 8 << e
    return n, out


def escaped(symbols: list[int], common: int, key: int) -> list[tuple[int, int | None]]:
    """(symbol, None), or (key, exponent) for an escape."""
    out: list[tuple[int, int | None]] = []
    at = 0
    while at < len(symbols):
        stop = at
        while stop < len(symbols) and symbols[stop] == symbols[at]:
            stop += 1
        if symbols[at] == common:
            singles, exps = escapes(stop - at)
            out += [(key, e) for e in exps] + [(common, None)] * singles
        else:
            out += [(symbols[at], None)] * (stop - at)
        at = stop
    return out


def to_words(bits: list[int]) -> bytes:
    """Bits into little-endian 32-bit words, the lowest bit first."""
    raw = np.packbits(np.array(bits + [0] * (-len(bits) % 32), dtype=np.uint8), bitorder="little")
    return raw.tobytes()


def from_words(data: bytes) -> list[int]:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").tolist()


def decode_table(book: dict[int, tuple[int, int]]) -> list[int]:
    """The code's tree, breadth first, as pairs: an inner node's children by place (for bit 0 and 1), a leaf's 0 and symbol."""
    by = {(n, value): s for s, (value, n) in book.items()}
    out, todo = [], [(0, 0)]
    deepest = max((n for _, n in book.values()), default=0)
    for n, value in todo:  # grows while it is walked
        if (n, value) in by:
            out += [0, by[n, value]]
        elif n >= deepest:
            out += [0, 0]  # no code leads here: a lone symbol's other bit
        else:
            out += [len(todo), len(todo) + 1]
            todo += [(n + 1, value << 1), (n + 1, value << 1 | 1)]
    return out


def encode_symbols(symbols, book: dict[int, tuple[int, int]], common: int | None = None, key: int | None = None) -> bytes:
    """Codes of the symbols, first bits first, as 32-bit words; runs of the common symbol as escapes with 3 bits each."""
    x = np.asarray(symbols, dtype=np.int64)
    if not len(x):
        return b""
    extra = np.full(len(x), -1)
    if common is not None and key is not None:
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        parts, at = [], 0
        lengths = np.diff(np.append(first, len(x)))
        for k in np.flatnonzero((x[first] == common) & (lengths > SINGLY)).tolist():
            singles, exps = escapes(int(lengths[k]))
            parts += [(x[at : first[k]], None), (np.array([key] * len(exps) + [common] * singles), exps)]
            at = first[k] + lengths[k]
        parts.append((x[at:], None))
        x = np.concatenate([p for p, _ in parts]).astype(np.int64)
        extra = np.concatenate([np.full(len(p), -1) if e is None else np.array(e + [-1] * (len(p) - len(e))) for p, e in parts]).astype(np.int64)
    names = np.array(sorted(book))
    place = np.searchsorted(names, x)
    if (place == len(names)).any() or (names[np.minimum(place, len(names) - 1)] != x).any():
        raise ValueError("a symbol has no code")
    value, length = (np.array([book[s][i] for s in names.tolist()], dtype=np.uint64)[place] for i in (0, 1))
    more = extra >= 0
    e = np.where(more, extra, 0).astype(np.uint64)
    flipped = (e & np.uint64(1)) << np.uint64(2) | e & np.uint64(2) | e >> np.uint64(2)
    value = np.where(more, value << np.uint64(3) | flipped, value)
    length = (length + np.where(more, 3, 0).astype(np.uint64)).astype(np.int64)
    start = np.cumsum(length) - length
    total = int(length.sum())
    bits = np.zeros(total + -total % 32, np.uint8)
    for j in range(int(length.max())):
        some = np.flatnonzero(length > j)
        bits[start[some] + j] = value[some] >> (length[some] - 1 - j).astype(np.uint64) & np.uint64(1)
    return np.packbits(bits, bitorder="little").tobytes()


def decode_symbols(data: bytes, n: int, book, common: int | None = None, key: int | None = None) -> list[int]:
    """n symbols. book: codes by symbol, or a decode_table. What stands at each place of the bits is worked out for all
    places at once; then the codes are followed from place to place. Raises ValueError if the stream ends too early."""
    table = np.array(decode_table(book) if isinstance(book, dict) else book, dtype=np.int64)
    bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"), np.zeros(3, np.uint8)])
    size = len(bits) - 3
    node, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
    live = np.flatnonzero(table[2 * node] != 0) if len(table) else np.zeros(0, np.int64)
    while len(live):
        node[live] = table[2 * node[live] + bits[live + length[live]]]
        length[live] += 1
        live = live[table[2 * node[live]] != 0]
        short = live[live + length[live] >= size]
        node[short], length[short] = -1, size + 1  # runs past the end
        live = live[live + length[live] < size]
    symbol = np.where(node >= 0, table[2 * np.maximum(node, 0) + 1], -1) if len(table) else node
    repeat = np.ones(size, np.int64)
    if key is not None:
        at = np.flatnonzero(symbol == key)
        p = np.minimum(at + length[at], size)
        repeat[at] = 8 << (bits[p].astype(np.int64) | bits[p + 1].astype(np.int64) << 1 | bits[p + 2].astype(np.int64) << 2)
        symbol[at], length[at] = common, length[at] + 3
    after, times, starts, at, left = (np.arange(size) + np.maximum(length, 1)).tolist(), repeat.tolist(), [], 0, n
    while left > 0:
        if at >= size or after[at] > size:
            raise ValueError("the stream ends before its symbols")
        starts.append(at)
        left -= times[at]
        at = after[at]
    return np.repeat(symbol[starts], repeat[starts]).tolist()


def encode_column(symbols: Column, book, common=None, key=None) -> Column:
    @arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else encode_symbols(x, book, common, key) for x in batch.to_pylist()], pa.binary())

    return encoded(symbols)


def decode_column(data: Column, n: int, book, common=None, key=None) -> Column:
    @arrow_udf("array<int>")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else decode_symbols(x, n, book, common, key) for x in batch.to_pylist()], pa.list_(pa.int32()))

    return decoded(data)


def frequencies(symbols: DataFrame, column: str = "s") -> dict[int, int]:
    """Counts by symbol, on the driver: as many rows as the quantizer has bins."""
    return {r[column]: r["n"] for r in symbols.groupBy(column).agg(F.count("*").alias("n")).collect()}


def encoded_bytes(counts: dict[int, int], own: dict[int, int], n_escapes: int = 0) -> int:
    """The size of an encoded stream, in whole 32-bit words."""
    return -(-(sum(n * own[s] for s, n in counts.items()) + 3 * n_escapes) // 32) * 4

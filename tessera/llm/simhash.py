"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits. If thresholds t_1..t_m with sum(t_i + 1) = t + 1 are given to
the partitions, two fingerprints within t bits differ by at most t_i bits in some partition i (t_i = -1: not probed).
Each fingerprint gets its own thresholds by dynamic programming over estimated candidate counts, probes the index of
partition values with every value within its thresholds, and candidates are verified on all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import brought_together, settle, shuffle_partitions
from .components import components

#: A partition value with more fingerprints than this is met in tiles, by spanning forests instead of pairs.
HOT = 32
#: Fingerprints of a tile's side.
TILE = 4096
#: Bits of a histogram that estimates candidate counts.
SUB = 11
#: Each byte as eight counters of one byte.
SPREAD = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprints_of(texts: list[bytes], k: int, seed: int) -> np.ndarray:
    """A 64-bit fingerprint for each text: bit j is set if it is set in over half the XXH64 values of the k-word
    shingles (A-Z lower-cased; repeats count; fewer than k words: one shingle; no word: 0)."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes, owners, counts = [], [], []
    for d, text in enumerate(texts):
        words = text.lower().split()
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= k:
            own = [digest(joined, seed)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            starts = np.concatenate([[0], ends[: n - k]]).tolist()
            own = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]
        hashes.append(np.array(own, dtype=np.uint64))
        owners.append(d)
        counts.append(len(own))
    if owners:
        out[owners] = majority(np.concatenate(hashes), np.array(counts))
    return out


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] > 0 values of h, the bits that are set in over half of them."""
    first = np.cumsum(counts) - counts
    pieces = -(-counts // 255)  # eight one-byte counters hold at most 255
    piece_first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(piece_first, pieces)
    starts = np.repeat(first, pieces) + 255 * within
    lanes = h.view(np.uint8).reshape(-1, 8)
    bits = np.zeros(len(counts), np.uint64)
    for lane in range(8):
        sums = np.add.reduceat(SPREAD[lanes[:, lane]], starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(sums, piece_first, axis=0)
        for j in range(8):
            bits |= (2 * ones[:, j] > counts).astype(np.uint64) << np.uint64(8 * lane + j)
    return bits


def fingerprint_column(text, k: int = 4, seed: int = 42):
    """The fingerprint of a text column as a signed long, unsigned bits kept."""

    @arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [x or b"" for x in batch.to_pylist()]
            at, parts = 0, []
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 1_500_000):
                    size += len(texts[stop])
                    stop += 1
                parts.append(fingerprints_of(texts[at:stop], k, seed))
                at = stop
            yield pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64))

    return fingerprint(F.coalesce(text.cast("binary"), F.lit(b"")))


def balls(width: int, most: int) -> list[np.ndarray]:
    """For each distance up to `most`, the masks of so many bits of a width."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], dtype=np.uint64) for d in range(min(most, width) + 1)]


def partition_count(n: int, t: int) -> int:
    """The number of partitions with the least expected probes and candidates for n fingerprints."""

    def cost(m: int) -> float:
        width, total = 64 // m, t + 1
        radii = [total // m + (i < total % m) - 1 for i in range(m)]
        return sum(sum(math.comb(width, e) for e in range(r + 1)) * (1 + n / 2**width) for r in radii)

    return min(range(2, min(t + 1, 8) + 1), key=cost) if t else 2


class Plan:
    """Bit groups, histograms of their parts, and the thresholds chosen from them."""

    def __init__(self, n: int, t: int, together: np.ndarray, tables: int = 1):
        """together[i, j]: fingerprints that have bits i and j set, n in all, of `tables` kinds that never meet."""
        self.n, self.t, self.m = n, t, partition_count(n // tables, t)
        p = together.diagonal() / max(n, 1)
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        like = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
        np.fill_diagonal(like, 0)
        sizes, free, order = [64 // self.m + (i < 64 % self.m) for i in range(self.m)], list(range(64)), []
        for size in sizes:  # the most correlated pair that is free, then the bit nearest to the group, until it is full
            own: list[int] = []
            while len(own) < size:
                if not own and size > 1:
                    sub = like[np.ix_(free, free)]
                    i, j = divmod(int(sub.argmax()), len(free))
                    take = [free[i], free[j]] if i != j else free[:2]
                else:
                    take = [max(free, key=lambda b: (sum(like[b, o] for o in own), -b))]
                own += take
                free = [b for b in free if b not in take]
            order += own
        self.order, self.sizes = order, sizes
        self.starts = [sum(sizes[:i]) for i in range(self.m)]
        self.parts = []  # (partition, first bit, width) of each histogram
        for i, size in enumerate(sizes):
            k = -(-size // SUB)
            cuts = [self.starts[i] + size * j // k for j in range(k + 1)]
            self.parts += [(i, a, b - a) for a, b in zip(cuts, cuts[1:])]

    def arranged(self, x: np.ndarray) -> np.ndarray:
        """The fingerprints with their bits in the order of the partitions."""
        out = np.zeros(len(x), np.uint64)
        for to, bit in enumerate(self.order):
            out |= ((x >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
        return out

    def restored(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), np.uint64)
        for to, bit in enumerate(self.order):
            out |= ((y >> np.uint64(to)) & np.uint64(1)) << np.uint64(bit)
        return out

    @staticmethod
    def cut(y: np.ndarray, first: int, width: int) -> np.ndarray:
        return (y >> np.uint64(first)) & np.uint64((1 << width) - 1)

    def learn(self, counts: list[np.ndarray]) -> None:
        """counts: of each part, how often each of its values occurs. Keeps, for each value and distance, the share
        of fingerprints at that distance within the part."""
        self.near = []
        for (_, _, width), count in zip(self.parts, counts):
            values = np.arange(1 << width, dtype=np.uint64)
            table = np.zeros((1 << width, self.t + 1))
            for d, masks in enumerate(balls(width, self.t)):
                for mask in masks:
                    table[:, d] += count[(values ^ mask).astype(np.int64)]
            self.near.append(table / max(self.n, 1))

    def thresholds(self, y: np.ndarray) -> np.ndarray:
        """For each fingerprint and partition, the distances probed (0: none, u: up to u - 1): their sum is t + 1, their
        estimated cost (values probed plus candidates met) the least."""
        total = self.t + 1
        best = np.full((len(y), total + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((self.m, len(y), total + 1), np.int8)
        for i in range(self.m):
            share = np.zeros((len(y), total))
            share[:, 0] = 1
            for (owner, first, width), near in zip(self.parts, self.near):
                if owner == i:
                    own, new = near[self.cut(y, first, width).astype(np.int64)], np.zeros_like(share)
                    for d in range(total):
                        for e in range(total - d):
                            new[:, d + e] += share[:, d] * own[:, e]
                    share = new
            met = np.cumsum(share, axis=1) * self.n
            probes = np.cumsum([math.comb(self.sizes[i], d) for d in range(total)])
            cost = np.concatenate([np.zeros((len(y), 1)), probes + met], axis=1)
            after = np.full_like(best, np.inf)
            for s in range(total + 1):
                for u in range(s + 1):
                    c = best[:, s - u] + cost[:, u]
                    better = c < after[:, s]
                    after[better, s] = c[better]
                    choice[i, better, s] = u
            best = after
        out, left, rows = np.zeros((self.m, len(y)), np.int8), np.full(len(y), total), np.arange(len(y))
        for i in reversed(range(self.m)):
            out[i] = choice[i, rows, left]
            left = left - out[i]
        return out

    def key(self, i: int, value: np.ndarray) -> np.ndarray:
        return (value | np.uint64(i << 40)).astype(np.int64)

    def index(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys, and the places in y that they are of."""
        for i in range(self.m):
            yield self.key(i, self.cut(y, self.starts[i], self.sizes[i])), np.arange(len(y))

    def probes(self, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        u = self.thresholds(y)
        for i in range(self.m):
            masks = balls(self.sizes[i], self.t)
            for most in range(1, self.t + 2):
                own = np.flatnonzero(u[i] == most)
                around = np.concatenate(masks[:most])
                step = max(1, 200_000 // len(around))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    yield self.key(i, (self.cut(y[part], self.starts[i], self.sizes[i])[:, None] ^ around[None, :]).reshape(-1)), np.repeat(part, len(around))


def _each(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            yield batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)


def _sums(distinct: DataFrame, of, schema: str = "k long, n long") -> dict[int, int]:
    """Sums by key over all fingerprints; of(y) gives an array of counts, whose places are the keys."""

    def partial(batches):
        total = None
        for y in _each(batches):
            own = of(y)
            total = own if total is None else total + own
        if total is not None:
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(total[there].astype(np.int64))], ["k", "n"])

    rows = distinct.mapInArrow(partial, schema).groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {r["k"]: r["n"] for r in rows}


def plan_for(distinct: DataFrame, t: int, tables: int = 1) -> Plan:
    """distinct(x): each fingerprint once. What comes to the driver are 64 x 64 counts and histograms of a few
    thousand places, whatever the number of fingerprints."""

    def together(y: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(y.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        return np.concatenate([[len(y)], (bits.T @ bits).astype(np.int64).reshape(-1)])

    sums = _sums(distinct, together)
    plan = Plan(sums.get(0, 0), t, np.array([sums.get(k + 1, 0) for k in range(4096)], dtype=np.float64).reshape(64, 64), tables)
    offsets = np.concatenate([[0], np.cumsum([1 << w for _, _, w in plan.parts])])

    def histograms(x: np.ndarray) -> np.ndarray:
        y = plan.arranged(x)
        return np.concatenate([np.bincount(plan.cut(y, first, width).astype(np.int64), minlength=1 << width) for _, first, width in plan.parts])

    sums = _sums(distinct, histograms)
    flat = np.zeros(offsets[-1])
    flat[list(sums)] = list(sums.values())
    plan.learn([flat[a:b] for a, b in zip(offsets, offsets[1:])])
    return plan


def forest(values: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all values which chains of steps within t bits connect: at most one for each value."""
    left, a, b = np.unique(values), [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= t
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                frontier += list(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def in_tiles(members: DataFrame, who: str, side: int = TILE) -> DataFrame:
    """members(key, ...), in tiles for each pair of shares (of about `side` rows) of a key, so that each two meet: column tile."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / side).cast("int").alias("tiles"))
    placed = members.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64(who), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("tile")
    return dealt.select(tile, *(c for c in members.columns if c != "key"))


def links(distinct: DataFrame, t: int, spent: list[DataFrame] | None = None) -> DataFrame:
    """distinct(x): each fingerprint once. Returns (a, b): links within t bits, enough to connect all that any such
    links connect. Partition values that few fingerprints share give every verified pair; a crowded value gives a
    spanning forest of each pair of its tiles, so that a dense group costs no more rows than tiles hold.
    spent: takes the tables that go when the result has been read."""
    plan = plan_for(distinct, t)

    def rows(of):
        def run(batches):
            for x in _each(batches):
                y = plan.arranged(x)
                for key, place in of(y):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(y[place].view(np.int64))], ["key", "y"])

        return run

    index = distinct.mapInArrow(rows(plan.index), "key long, y long")
    probes = distinct.mapInArrow(rows(plan.probes), "key long, y long")
    hot = settle(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    crowded = not hot.isEmpty()
    cold = index.join(hot, "key", "left_anti") if crowded else index
    a, b = probes.withColumnRenamed("y", "a"), cold.withColumnRenamed("y", "b")
    found = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= t)).select("a", "b")
    if crowded:
        members = index.union(probes).join(hot, "key", "left_semi").distinct()
        members = settle(members)
        dealt = in_tiles(members, "y")

        def connect(batches):
            held: list[np.ndarray] = []
            now = None

            def done():
                x, z = forest(np.concatenate(held), t)
                return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(z.view(np.int64))], ["a", "b"])

            for batch in batches:
                tiles, y = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                cuts = np.flatnonzero(np.diff(tiles)) + 1
                for start, stop in zip([0, *cuts], [*cuts, len(tiles)]):
                    if held and tiles[start] != now:
                        yield done()
                        held = []
                    now = tiles[start]
                    held.append(y[start:stop])
            if held:
                yield done()

        found = found.union(brought_together(dealt, "tile").mapInArrow(connect, "a long, b long"))

    def back(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plan.restored(batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)) for i in (0, 1)], ["a", "b"])

    found = settle(found)
    if spent is not None:
        spent += [hot, members, found] if crowded else [hot, found]
    return found.mapInArrow(back, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, t: int = 4, seed: int = 42) -> DataFrame:
    """Every row of docs(doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id: the least doc_id among
    the documents that links of at most t differing bits reach, itself included.

    Null or wordless text: fingerprint zero, linked like any other. Rows with a null doc_id take part; they get the
    component's least id, null if it has none. Repeated rows each come out. Other columns are ignored."""
    marked = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), k, seed).alias("x")))
    distinct = settle(marked.groupBy("x").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("x").repartition(shuffle_partitions(docs.sparkSession)), t))
    named = settle(distinct.join(roots.withColumnRenamed("node", "x"), "x", "left").select("x", "least", F.coalesce("root", "x").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return (
        marked.join(named.join(least, "root").select("x", "component_id"), "x")
        .select("doc_id", F.lpad(F.lower(F.hex("x")), 16, "0").alias("fingerprint"), "component_id")
    )

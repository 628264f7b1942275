"""Near-duplicates by similarity: SimHash, and an exact set similarity join over distinct word shingles for what it misses.

First the fingerprints of `simhash.py` link what differs in few bits, by its partitions and thresholds; an exact check of
the shingles follows. What these links connect isn't looked at again; 64 bits miss most pairs near the threshold, so that
all others meet by their shingles.

All shingles are ordered, the rarer first (by counts of hash buckets, then by hash). Two sets of a Jaccard similarity of
`least` or more share one of the first n - ceil(least n) + 1 shingles of each, whatever the number of texts: these are the
keys that a text is met by. Pairs that meet are compared by their whole sets, so that none is lost and none is guessed.
To keep rows in proportion to the texts, each text is first compared with the least one of each of its keys; then only
pairs that these links don't connect, in keys of few texts as rows, in crowded ones inside of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import as_bytes, blocks, brought_together, discard, pack, questions, seen_again, settle, shuffle_partitions, unpack
from .components import components
from .simhash import HOT, in_tiles

#: Texts of a tile's side (a task holds the shingles of a tile's texts).
TILE = 1024
#: Bits of the bucket of a shingle's hash by which its frequency is counted, and buckets that travel as one value.
BUCKETS, CHUNK = 18, 4096
#: Bits of a set's bitmap.
BITS = 1024
#: Candidates whose shingles are gathered at once; shingles that texts are met by for each shard.
STEP, KEYS = 256, 1_000_000


def shingles(text: bytes, k: int, seed: int) -> np.ndarray:
    """XXH64 of the distinct k-word shingles (A-Z lower-cased; fewer than k words: one shingle; no word: none)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    starts = [0, *ends[: len(last) - 1].tolist()]
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, last)), np.uint64, len(last)))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _chunks(total: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in total.reshape(-1, CHUNK)]


def frequencies(counted: DataFrame) -> np.ndarray:
    """counted(chunk, n) of each task, summed: how often the shingles of each bucket of hashes occur. 2 MB, whatever the
    number of texts."""

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "n"])

    out = np.zeros(((1 << BUCKETS) // CHUNK, CHUNK), np.int64)
    for r in brought_together(counted, "chunk").mapInArrow(summed, "chunk long, n binary").collect():
        out[r["chunk"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(-1)


def _prefixes(counts: np.ndarray, k: int, least: float, seed: int, shards: int):
    """For each block of texts: the shingles by which each is met, in the order of its set (shard -1), and for each shard
    48 bits of the distinct ones that belong there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                keys, sizes = [], []
                for text in part.column("text").to_pylist():
                    h = shingles(text, k, seed)
                    most = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1
                    keys.append(h[np.lexsort((h, counts[_buckets(h)]))[:most]])
                    sizes.append(len(h))
                # of values that are equal in 48 bits one stands for all: pairs that meet are compared whole
                asked, which = np.unique(np.concatenate(keys) >> np.uint64(16), return_inverse=True)
                here = np.bincount(which) > 1
                home = pack(part.column("node").to_numpy(), np.array(sizes, dtype=np.int32), np.array([len(x) for x in keys], dtype=np.int32), which.astype(np.int32), here, asked[here])
                rows = [(task << 32 | number, -1, home), *((task << 32 | number, s, q) for s, q in questions(asked << np.uint64(16), shards))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "payload"])
                number += 1

    return run


def _met(kept: pa.Table, answered: pa.Table) -> pa.Table:
    """A block's rows (key, node, n, pos) of the shingles that another text is met by, too."""
    out = [MET.empty_table()]
    for payload in kept.column("payload").to_pylist():
        node, n, taken, which, here, own = unpack(payload)
        bits = [unpack(x) for x in answered.sort_by("shard").column("payload").to_pylist()]
        again = np.concatenate([np.unpackbits(b, count=int(m[0])) for b, m, _ in bits]).astype(bool)
        value = np.zeros(len(again), np.uint64)
        value[here] = own
        value[again] = np.concatenate([x for _, _, x in bits])
        some = np.flatnonzero((again | here)[which])
        owner = np.repeat(np.arange(len(node)), taken)
        pos = np.arange(len(which)) - np.repeat(np.cumsum(taken) - taken, taken)
        out.append(pa.Table.from_arrays([pa.array(value[which[some]].astype(np.int64)), pa.array(node[owner[some]]), pa.array(n[owner[some]]), pa.array(pos[some].astype(np.int32))], schema=MET))
    return pa.concat_tables(out)


MET = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def prefixes(texts: DataFrame, counts: np.ndarray, k: int, least: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(key, node, n, pos): the shingles by which a set of n is met and their places in its order, but for those that meet
    no other text (nearly all); and the table that may go when they have been read."""
    shards = max(2 * shuffle_partitions(texts.sparkSession), int(counts.sum() * (1 - least)) // KEYS)
    sent = "block long, shard int, payload binary"
    kept = settle(texts.select("node", "text").mapInArrow(_prefixes(counts, k, least, seed, shards), sent), payload=True, by="block")
    again = brought_together(kept.where("shard >= 0"), "shard", keys=shards).mapInArrow(seen_again, sent)
    met = kept.where("shard < 0").groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_met, "key long, node long, n int, pos int")
    return met, kept


def alike(shared, n, m, least: float):
    return (shared > 0) & (shared >= least * (n + m - shared))


def bitmap(h: np.ndarray) -> bytes:
    """A set's bitmap: the bit of each member's hash."""
    out = np.zeros(BITS, bool)
    out[(h >> np.uint64(64 - int(BITS).bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def could_share(x: np.ndarray, n, y: np.ndarray, m) -> np.ndarray:
    """How many members two sets can share at most, by their bitmaps (rows of 64-bit words) and sizes: each bit that only
    one has is of a member that the other lacks."""
    only_x, only_y = np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64)
    return np.minimum(n - only_x, m - only_y)


def _words(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)


def compared(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, k: int, least: float, seed: int) -> DataFrame:
    """Those of pairs(a, b) whose shingles have a similarity of `least` or more. Texts travel only for pairs that their
    sketches (bitmaps and sizes) don't rule out."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("size").alias(f"size_{side}")), side)

    def possible(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("size_a", "size_b"))
            most = could_share(_words(batch.column("bits_a").to_pylist()), n, _words(batch.column("bits_b").to_pylist()), m) if batch.num_rows else n
            yield batch.select(["a", "b"]).filter(pa.array(alike(most, n, m, least)))

    pairs = pairs.mapInArrow(possible, "a long, b long")
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)

    def exact(batches):
        last, y = None, None
        for batch in batches:
            good = []
            for b, one, two in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b"))):
                if b != last:  # rows of a text mostly follow each other
                    last, y = b, shingles(two, k, seed)
                x = shingles(one, k, seed)
                good.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), least)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(exact, "a long, b long")


def _hopeful(least: float):
    """Of the rows of a tile (texts that share a key, by their sketches): those that may be alike to another of them that
    they aren't connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tile", "node", "root", "pos", "size"]
        now, held = None, []

        def done() -> pa.RecordBatch:
            node, root, pos, n = (np.array(c) for c in list(zip(*held))[:4])
            bits, left, some = _words([h[4] for h in held]), n - pos, np.zeros(len(held), bool)
            for i in range(len(held) - 1):
                could = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                could = could[np.minimum(left[i], left[could]) >= least / (1 + least) * (n[i] + n[could]) - 1e-6]
                could = could[alike(could_share(bits[i], n[i], bits[could], n[could]), n[i], n[could], least)]
                if len(could):
                    some[i] = some[could] = True
            return pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), now)), *(pa.array(c[some]) for c in (node, root, pos.astype(np.int32), n.astype(np.int32)))], names)

        for batch in batches:
            for tile, *row in zip(*(batch.column(c).to_pylist() for c in (*names, "bits"))):
                if held and tile != now:
                    yield done()
                    held = []
                now = tile
                held.append(row)
        if held:
            yield done()

    return run


def forest(nodes: np.ndarray, roots: np.ndarray, pos: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Texts that share a key, at place pos of their orders: links that connect all that pairs of a similarity of `least`
    or more connect, beyond what equal roots do already; at most one for each text."""
    n = np.array([len(h) for h in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first, top, a, b = np.cumsum(n) - n, np.unique(roots, return_inverse=True)[1], [], []
    own, left = np.zeros(codes.max() + 1, bool), n - pos
    for i in range(len(n) - 1):
        could = i + 1 + np.flatnonzero(top[i + 1 :] != top[i])
        could = could[np.minimum(left[i], left[could]) >= least / (1 + least) * (n[i] + n[could]) - 1e-6]
        own[codes[first[i] : first[i] + n[i]]] = True
        for at in range(0, len(could), STEP):
            some = could[at : at + STEP]
            some = some[top[some] != top[i]]
            if not len(some):
                continue
            before = np.cumsum(n[some]) - n[some]
            shared = np.add.reduceat(own[codes[np.repeat(first[some] - before, n[some]) + np.arange(n[some].sum())]].astype(np.int64), before)
            for j in some[alike(shared, n[i], n[some], least)]:
                if top[j] != top[i]:
                    a.append(int(nodes[i]))
                    b.append(int(nodes[j]))
                    top[top == top[j]] = top[i]
        own[codes[first[i] : first[i] + n[i]]] = False
    return a, b


def fingerprint_links(texts: DataFrame, sketches: DataFrame, t: int, k: int, least: float, seed: int) -> DataFrame:
    """texts(node, text) and sketches(node, x, bits, size), each node once -> (a, b): of the links of fingerprints x within
    t bits (enough to connect all that any such links connect; texts of a fingerprint: each with the least one) those of a
    shingle similarity of `least` or more."""
    spent: list[DataFrame] = []
    prints = settle(sketches.groupBy("x").agg(F.min("node").alias("lead")))
    found = simhash.links(prints.select("x").repartition(shuffle_partitions(texts.sparkSession)), t, spent)
    for side in "ab":
        found = found.join(prints.select(F.col("x").alias(side), F.col("lead").alias(f"node_{side}")), side)
    same = sketches.join(prints, "x").where("node <> lead").select("lead", "node")
    pairs = settle(found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).union(same).distinct())
    discard(prints, *spent)
    out = settle(compared(texts, sketches, pairs, k, least, seed))
    discard(pairs)
    return out


def links(texts: DataFrame, sketches: DataFrame, known: DataFrame, counts: np.ndarray, k: int, least: float, seed: int, spent: list[DataFrame]) -> DataFrame:
    """texts(node, text) and sketches(node, bits, size), each node once, known(a, b): links found already -> (a, b): known ones
    and pairs of a similarity of `least` or more that connect all that any such pairs connect. spent: takes the tables that go
    when the result has been read."""
    met, kept = prefixes(texts, counts, k, least, seed)
    met = settle(met.join(components(known), "node", "left").select("key", "node", "n", "pos", "root"))
    discard(kept)
    root = F.coalesce("root", "node")
    keys = met.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("lead"), F.min(root).alias("low"), F.max(root).alias("high"))
    members = settle(met.withColumn("root", root).join(keys.where("low <> high").drop("low", "high"), "key"))
    discard(met)
    share = least / (1 + least)

    def near(*sides):
        """The shingles from the shared one on suffice for the similarity."""
        return F.least(*(F.expr(f"n_{s} - pos_{s}") for s in sides)) >= share * sum(F.col(f"n_{s}") for s in sides) - 1e-6

    def side(df, s, *more):
        return df.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", *more)))

    lead = side(members.where("node = lead"), "a", "root")
    star = side(members.where("node <> lead"), "b", "root").join(lead, "key").where((F.col("root_a") != F.col("root_b")) & near("a", "b"))
    stars = settle(compared(texts, sketches, settle(star.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()), k, least, seed))
    stars = stars.union(known)
    rooted = settle(members.drop("root").join(components(stars), "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(members)
    open_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = settle(rooted.join(open_, "key", "left_semi"))
    discard(rooted)
    cold = rest.where((F.col("rows") <= HOT) & (F.col("node") != F.col("lead")))
    pairs = side(cold, "a", "root").join(side(cold, "b", "root"), "key").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near("a", "b"))
    pairs = settle(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    found = stars.union(compared(texts, sketches, pairs, k, least, seed))
    spent += [stars, rest, pairs]
    crowded = rest.where(F.col("rows") > HOT)
    if crowded.isEmpty():
        return found
    members = settle(crowded.select("key", "node", "root", "pos"))
    dealt = brought_together(in_tiles(members, "node", TILE).join(sketches, "node").select("tile", "node", "root", "pos", "size", "bits"), "tile")
    hopeful = settle(dealt.mapInArrow(_hopeful(least), "tile long, node long, root long, pos int, size int"))
    spent += [members, hopeful]
    dealt = hopeful.join(texts, "node")

    def connect(batches):
        now, held = None, []

        def done():
            own = forest(*(np.array(c) for c in list(zip(*held))[:3]), [shingles(h[3], k, seed) for h in held], least)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in own], ["a", "b"])

        for batch in batches:
            for tile, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "node", "root", "pos", "text"))):
                if held and tile != now:
                    yield done()
                    held = []
                now = tile
                held.append(row)
        if held:
            yield done()

    return found.union(brought_together(dealt.select("tile", "node", "root", "pos", "text"), "tile").mapInArrow(connect, "a long, b long"))


def similar_groups(docs: DataFrame, k: int = 5, least: float = 0.8, seed: int = 42, words: int = 4, t: int = 4) -> DataFrame:
    """docs(doc_id, text, ...): a row (doc_id, component_id) for each document with an id and a word; component_id is the
    least doc_id that chains of documents of a shingle similarity of `least` or more reach. words, t: the shingles of the
    fingerprints that are asked first, and the bits in which they may differ.

    Exact, but for collisions of 64-bit hashes. Rows with a null doc_id, null texts and texts without a word take no
    part; repeated rows count once; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        total = np.zeros(1 << BUCKETS, np.int64)
        for block in blocks(batches, 1_500_000):
            ids, nodes, kept, bits, sizes, new = [], [], [], [], [], []
            for doc_id, text in zip(block["doc_id"], block["text"]):
                own = shingles(text, k, seed)
                if len(own):
                    node = xxhash.xxh64_intdigest(own.tobytes(), seed) - (1 << 63)
                    ids.append(doc_id)
                    nodes.append(node)
                    kept.append(None if node in seen else text)
                    bits.append(None if node in seen else bitmap(own))
                    sizes.append(None if node in seen else len(own))
                    new.append(node not in seen)
                    if node not in seen:
                        seen.add(node)
                        total[_buckets(own)] += 1
            prints = np.zeros(len(ids), np.int64)
            prints[np.array(new, dtype=bool)] = simhash.fingerprints_of([x for x in kept if x is not None], words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(kept, pa.binary()), pa.nulls(len(ids), pa.binary()), pa.array(bits, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, mask=~np.array(new, dtype=bool))], names)
        if seen:
            parts = _chunks(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.nulls(len(parts), pa.binary()), pa.array(parts, pa.binary()), pa.nulls(len(parts), pa.binary()), pa.nulls(len(parts), pa.int32()), pa.nulls(len(parts), pa.int64())], names)

    def once(batches):
        """Of rows in order of the node, the first text of each; other texts become null."""
        last = None
        for batch in batches:
            node, text = batch.column("node").to_numpy(), batch.column("text")
            there = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
            keep = np.zeros(batch.num_rows, bool)
            if len(there):
                own = node[there]
                keep[there] = np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])
                last = own[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pc.if_else(pa.array(keep), text, pa.scalar(None, pa.binary())), *(batch.column(c) for c in ("n", "bits", "size", "x", "place"))], [*names, "place"])

    names, schema = ["doc_id", "node", "text", "n", "bits", "size", "x"], "doc_id long, node long, text binary, n binary, bits binary, size int, x long"
    read = as_bytes(docs.where(F.col("doc_id").isNotNull())).mapInArrow(run, schema)
    # texts go where their copies go; what has no text (a third of all rows may be one text's copies) goes anywhere
    read = read.withColumn("place", F.when(F.col("text").isNull() & F.col("n").isNull(), F.xxhash64("doc_id")).otherwise(F.col("node")))
    held = settle(brought_together(read, "place").mapInArrow(once, f"{schema}, place long"), by="place")
    counts = frequencies(held.where("n is not null").select(F.col("node").alias("chunk"), "n"))
    texts, sketches = (held.where("text is not null").select(F.col("place").alias("node"), *c) for c in (["text"], ["bits", "size", "x"]))
    marked = settle(held.where("doc_id is not null").select("doc_id", "node"))
    known = fingerprint_links(texts, sketches, t, k, least, seed)
    spent = [held, known]
    roots = components(links(texts, sketches, known, counts, k, least, seed, spent))
    named = settle(marked.groupBy("node").agg(F.min("doc_id").alias("id")).join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")))
    discard(*spent)
    least_of = named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "component_id")
    return marked.join(least_of, "node").select("doc_id", "component_id").distinct()

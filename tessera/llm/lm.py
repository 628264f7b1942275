"""Language-model scores from a trigram trie in Elias-Fano levels.

p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); p2(w | v) = c(vw) / (c(v) + K2) + K2 / (c(v) + K2) p1(w); p3(w | uv) = c(uvw) /
(c(uv) + K3) + K3 / (c(uv) + K3) p2(w | v): counts of the training texts, each order smoothed towards the shorter one
(Dirichlet priors of weight K2 and K3). The trie holds the first terms of p2 and p3 for the bigrams and trigrams seen, and
for each context uv the weight K3 / (c(uv) + K3), each quantised to a byte in even steps of its logarithm.

Training counts words by shards of their hash, which gives each word a number (small for frequent words), and trigrams by
shards of their middle word v. A word with more than its share of all tokens is spread over several shards by the word
before it, a pair of such words by the word that follows, too. A shard's trie is one file of the shared folder; the model
stays there and scores any texts. A block of texts asks the shards once for each distinct bigram and trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, brought_together, discard, groups, mixed, pack, settle, shard_of, shards_for, shared_folder, unpack, word_hashes
from .eliasfano import Trie

#: Bytes of text in a block and for each shard; the weights of shorter contexts; the least probability with a code.
BLOCK, SHARD, WEIGHTS, LEAST = 4_000_000, 12_000_000, (8.0, 4.0), 1e-10
#: Numbers of a text's start (as a context) and of words that training texts lack; others begin at 1. The end's hash.
START, UNKNOWN, END = 0, (1 << 40) - 1, word_hashes([b""])[0]
#: Code 0: none; codes 1..255: probabilities in even steps of their logarithm.
CODEBOOK = np.concatenate([[0.0], np.exp(np.log(LEAST) * (1 - np.arange(255) / 254))])
#: Trigrams that are looked up at once; shards over which a pair of frequent words is spread at most (its trigrams,
#: distinct in each block, are read by so many tasks).
TOGETHER, PAIR = 200_000, 16
SENT = "block long, shard int, payload binary"


def quantised(p: np.ndarray) -> np.ndarray:
    code = np.rint(254 * (1 - np.log(np.maximum(p, LEAST)) / np.log(LEAST))).astype(np.int64) + 1
    return np.where(p > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "payload"])


def _tokens(shards: int):
    """For each block of texts: its tokens (shard -1), and for each shard of hashes its distinct words with their counts
    in all texts and in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd  # in the executors only

        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, BLOCK)):
            words = [t.lower().split() for t in block["text"]]
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(lengths)
            h = np.full(int(ends[-1]), END, np.uint64)
            inside = np.ones(len(h), bool)
            inside[ends - 1] = False
            h[inside] = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, len(h) - len(words))
            del words, inside
            codes, hashes = pd.factorize(h)
            size = len(hashes)
            train = np.array(block["train"], dtype=bool)
            counts = np.bincount(codes, minlength=size)
            learned = np.bincount(codes, np.repeat(train, lengths), size).astype(np.int64)
            often = np.argsort(-counts, kind="stable")  # frequent words get small codes
            rank = np.empty(size, np.int32)
            rank[often] = np.arange(size)
            shard = shard_of(hashes, shards)
            order = np.lexsort((hashes, shard))
            ids = np.array([x or 0 for x in block["doc_id"]], dtype=np.int64)
            none = np.array([x is None for x in block["doc_id"]])
            number = part << 32 | k
            rows = [(number, -1, pack(ids, none, train, lengths.astype(np.int32), rank[codes], rank[order], rank[codes[-1:]], level=3))]
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)):
                own = order[edges[s] : edges[s + 1]]
                rows.append((number, int(s), pack(hashes[own], counts[own].astype(np.uint32), learned[own].astype(np.uint32))))
            yield _sent(rows)

    return run


def tokenised(docs: DataFrame, train: Column, shards: int) -> DataFrame:
    texts = as_bytes(docs, F.coalesce(train, F.lit(False)).alias("train"))
    return settle(texts.mapInArrow(_tokens(shards), SENT), payload=True, by="block")


def _vocabulary(shards: int):
    """For each shard of hashes: the words of training texts in the order of their hashes, with numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groups(batches, "shard"):
            hashes, all_, learned = (np.concatenate(x) for x in zip(*(unpack(row["payload"]) for row in rows)))
            known, place = np.unique(hashes, return_inverse=True)
            all_, learned = (np.bincount(place, x, len(known)).astype(np.int64) for x in (all_, learned))
            keep = learned > 0
            known, all_, learned = known[keep], all_[keep], learned[keep]
            rank = np.empty(len(known), np.int64)
            rank[np.argsort(-learned, kind="stable")] = np.arange(len(known))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack(known, rank * shards + shard + 1, learned, all_)], pa.binary()), pa.array([len(known)]), pa.array([int(learned.sum())])], ["shard", "payload", "words", "tokens"])

    return run


@dataclass
class Vocabulary:
    table: DataFrame  #: (shard, payload, words, tokens)
    shards: int
    words: int
    tokens: int  #: of the training texts

    @classmethod
    def of(cls, tokens: DataFrame, shards: int) -> Vocabulary:
        asked = brought_together(tokens.where("shard >= 0").select("shard", "payload"), "shard", keys=shards)
        table = settle(asked.mapInArrow(_vocabulary(shards), "shard int, payload binary, words long, tokens long"), payload=True)
        words, total = table.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        return cls(table, shards, words, total)


def _numbers(shards: int, total: int):
    """A shard's words, and each block's question: numbers, counts and how many shards a word is spread over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for batch in batches:
            out = []
            for block, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "shard", "payload"))):
                if shard != now:
                    now, known = shard, [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
                if block < 0:  # the vocabulary's row comes first
                    known = unpack(payload)
                    continue
                hashes = unpack(payload)[0]
                at = np.minimum(np.searchsorted(known[0], hashes), max(len(known[0]) - 1, 0))
                there = known[0][at] == hashes if len(known[0]) else np.zeros(len(hashes), bool)
                number, count, spread = np.full(len(hashes), UNKNOWN, np.int64), np.zeros(len(hashes), np.int64), np.ones(len(hashes), np.int64)
                number[there], count[there] = known[1][at[there]], known[2][at[there]]
                spread[there] = np.clip(np.ceil(2 * shards * known[3][at[there]] / max(total, 1)), 1, shards)
                out.append((block, shard, pack(number, count, spread.astype(np.int32))))
            if out:
                yield _sent(out)

    return run


def _numbered(kept: pa.Table, answered: pa.Table) -> pa.Table:
    rows = []
    for block, payload in zip(kept.column("block").to_pylist(), kept.column("payload").to_pylist()):
        ids, none, train, lengths, codes, order, end = unpack(payload)
        answers = [unpack(x) for x in answered.sort_by("shard").column("payload").to_pylist()]
        number, count, spread = (np.empty(len(order), np.int64) for _ in range(3))
        for to, i in ((number, 0), (count, 1), (spread, 2)):
            to[order] = np.concatenate([a[i] for a in answers])
        rows.append((block, -1, pack(ids, none, train, lengths, codes, end, number, count, spread.astype(np.int32), level=3)))
    return pa.Table.from_batches([_sent(rows)] if rows else [], schema=pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())]))


def numbered(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The texts of `tokenised` with the vocabulary's numbers, counts and spreads of their words."""
    words = vocabulary.table.select(F.lit(-1).cast("long").alias("block"), "shard", "payload")
    met = brought_together(tokens.where("shard >= 0").union(words), "shard", "block", keys=vocabulary.shards)
    answers = met.mapInArrow(_numbers(vocabulary.shards, vocabulary.tokens), SENT)
    return settle(tokens.where("shard < 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_numbered, SENT), payload=True, by="block")


class Grams:
    """The distinct contexts (v, u) and trigrams (u, v, w) of a block, in the order of the shards and, within, of their
    numbers. Bigrams u v are asked as contexts: that of a text's end has no trigrams. What holds a word that training
    texts lack isn't asked."""

    def __init__(self, payload: bytes, shards: int):
        self.ids, self.none, self.train, lengths, codes, end, number, count, spread = unpack(payload)
        self.lengths, n_texts = lengths.astype(np.int64), len(lengths)
        codes, end, size = codes.astype(np.int64), int(end[0]), len(number)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        number, spread = np.append(number, START), np.append(spread, spread[end]).astype(np.int64)
        # words by ascending number; those unknown are one. A text's start is as frequent as its end
        self.numbers, first, own = np.unique(number, return_index=True, return_inverse=True)
        self.counts, spread = np.append(count, count[end])[first], spread[first]
        # each text with two starts before it: place i of its tokens is place i + 2 here
        n = len(self.numbers)
        shift = np.repeat(2 * np.arange(1, n_texts + 1), self.lengths)
        x = np.full(len(codes) + 2 * n_texts, own[size])
        self.at = np.arange(len(codes)) + shift
        x[self.at] = own[codes]
        self.x, known = x, self.counts[x] > 0
        learned = np.repeat(self.train, self.lengths + 2)
        # contexts: at each place the word there and the one before, but not across texts (the first start has none)
        there = known.copy()
        there[1:] &= known[:-1]
        firsts = self.offsets[:-1] + 2 * np.arange(n_texts)
        there[firsts] = False
        self.node_at = np.flatnonzero(there)
        node, self.node_inverse = np.unique(x[self.node_at] * n + x[self.node_at - 1], return_inverse=True)
        self.node_v, self.node_u = node // n, node % n
        node_count = np.bincount(self.node_inverse, learned[self.node_at], len(node)).astype(np.int64)
        # trigrams: a context and the token after it
        of = np.full(len(x), -1)
        of[self.node_at] = self.node_inverse
        parent = np.concatenate([[-1], of[:-1]])
        parent[firsts] = -1
        asked = known & (parent >= 0)
        asked[firsts + 1] = False
        self.gram_at = np.flatnonzero(asked)
        gram, self.gram_inverse = np.unique(parent[self.gram_at] * n + x[self.gram_at], return_inverse=True)
        gram_count = np.bincount(self.gram_inverse, learned[self.gram_at], len(gram)).astype(np.int64)
        self.parent = parent
        gram_node, gram_w = gram // n, gram % n
        # a context's shards: of v, by u if v is frequent; its trigrams over several if u is frequent as well
        h = mixed(self.numbers.astype(np.uint64))
        home = shard_of(self.numbers.astype(np.uint64), shards)
        wide = spread[self.node_v]
        first_shard = home[self.node_v] + (h[self.node_u] % wide.astype(np.uint64)).astype(np.int64)
        copies = np.minimum(np.minimum(wide, spread[self.node_u]), PAIR)
        which = np.repeat(np.arange(len(node)), copies)
        step = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
        shard = (first_shard[which] + step) % shards
        order = np.argsort(shard, kind="stable")
        self.node, self.node_shard, self.node_count = which[order], shard[order], node_count[which[order]]
        shard = (first_shard[gram_node] + (h[gram_w] % copies[gram_node].astype(np.uint64)).astype(np.int64)) % shards
        self.order = np.argsort(shard, kind="stable")
        self.gram_shard, self.gram_node, self.gram_w, self.gram_count = shard[self.order], gram_node[self.order], gram_w[self.order], gram_count[self.order]

    def payloads(self, shards: int, learn: bool) -> Iterator[tuple[int, bytes]]:
        node_edges = np.searchsorted(self.node_shard, np.arange(shards + 1))
        gram_edges = np.searchsorted(self.gram_shard, np.arange(shards + 1))
        place = np.empty(max(len(self.node_v), 1), np.int64)
        for s in np.flatnonzero(np.diff(node_edges)):
            nodes = self.node[node_edges[s] : node_edges[s + 1]]
            grams = slice(gram_edges[s], gram_edges[s + 1])
            place[nodes] = np.arange(len(nodes))
            children = np.bincount(place[self.gram_node[grams]], minlength=len(nodes))
            v, u = self.node_v[nodes], self.node_u[nodes]
            new = np.flatnonzero(np.diff(v, prepend=-1))
            parts = [np.diff(self.numbers[v[new]], prepend=0), np.diff(np.append(new, len(v))).astype(np.uint32), self.numbers[u], children.astype(np.uint32), self.numbers[self.gram_w[grams]]]
            if learn:
                parts += [self.node_count[node_edges[s] : node_edges[s + 1]].astype(np.uint32), self.counts[u].astype(np.uint32), self.gram_count[grams].astype(np.uint32)]
            yield int(s), pack(*parts)


def _ask(shards: int, learn: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                own, rows = Grams(payload.as_py(), shards), []
                for s, p in own.payloads(shards, learn):
                    rows.append((number, s, p))
                    if len(rows) == 64:
                        yield _sent(rows)
                        rows = []
                if rows:
                    yield _sent(rows)

    return run


def _opened(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Payloads as one: numbers v and u of each context, the context and number w of each trigram."""
    v = np.concatenate([np.repeat(np.cumsum(p[0]), p[1]) for p in parts])
    u = np.concatenate([p[2] for p in parts])
    node = np.repeat(np.arange(len(u)), np.concatenate([p[3] for p in parts]))
    return v, u, node, np.concatenate([p[4] for p in parts])


def _build(folder: str, shard: int, parts: list[list[np.ndarray]], weights: tuple[float, float]) -> list[int]:
    """A shard's trie, as a file of the folder; its head."""
    v, u, node, w = _opened(parts)
    node_count, u_count, gram_count = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (5, 6, 7))
    contexts, vi = np.unique(v, return_inverse=True)
    us, first, ui = np.unique(u, return_index=True, return_inverse=True)
    key, place = np.unique(vi * len(us) + ui, return_inverse=True)
    of_node = np.bincount(place, node_count, len(key))
    ws, wi = np.unique(w, return_inverse=True)
    gram, at = np.unique(place[node] * max(len(ws), 1) + wi, return_inverse=True)
    of_gram = np.bincount(at, gram_count, len(gram))
    # what only texts hold that weren't learned from is not in the trie
    keep = of_node > 0
    to = np.cumsum(keep) - 1
    key, of_node = key[keep], of_node[keep]
    node_v, node_u = key // max(len(us), 1), key % max(len(us), 1)
    learned = of_gram > 0
    gram, of_gram = gram[learned], of_gram[learned]
    gram_node, gram_w = to[gram // max(len(ws), 1)], gram % max(len(ws), 1)
    a2 = of_node / (u_count[first][node_u] + weights[0])
    a3 = of_gram / (of_node[gram_node] + weights[1])
    return Trie.write(folder, f"{shard}.trie", contexts, (node_v, us[node_u]), (gram_node, ws[gram_w]), quantised(weights[1] / (of_node + weights[1])), quantised(a2), quantised(a3))


def _answered(trie: Trie | None, parts: list[list[np.ndarray]]) -> Iterator[bytes]:
    """For each payload: the codes of its contexts' weights and bigrams, and of its trigrams."""
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and size < TOGETHER:
            size += len(parts[stop][4])
            stop += 1
        some = parts[at:stop]
        v, u, node, w = _opened(some)
        if trie:
            place = trie.child("nodes", trie.context(v), u)
            codes = trie.code(trie.backoff, place), trie.code(trie.node_codes, place), trie.code(trie.word_codes, trie.child("words", place[node], w))
        else:
            codes = np.zeros(len(u), np.uint8), np.zeros(len(u), np.uint8), np.zeros(len(w), np.uint8)
        cuts, gram_cuts = np.cumsum([len(p[2]) for p in some])[:-1], np.cumsum([len(p[4]) for p in some])[:-1]
        for own in zip(np.split(codes[0], cuts), np.split(codes[1], cuts), np.split(codes[2], gram_cuts)):
            yield pack(*own)
        at = stop


def _learn(folder: str, weights: tuple[float, float], answer: bool):
    """For each shard: builds its trie, and gives its head, or asks the trie what the same blocks' texts ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groups(batches, "shard"):
            numbers = [row["block"] for row in rows]
            parts = [unpack(row["payload"]) for row in rows]
            del rows
            head = _build(folder, shard, parts, weights)
            if not answer:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([head], pa.list_(pa.int64()))], ["shard", "head"])
                continue
            out = []
            for number, payload in zip(numbers, _answered(Trie(folder, f"{shard}.trie", head), [p[:5] for p in parts])):
                out.append((number, shard, payload))
                if len(out) == 64:
                    yield _sent(out)
                    out = []
            if out:
                yield _sent(out)

    return run


@dataclass
class Model:
    vocabulary: Vocabulary
    folder: str  #: of the tries' files
    tries: DataFrame  #: (shard, head)
    weights: tuple[float, float]


def fit(texts: DataFrame, vocabulary: Vocabulary, weights: tuple[float, float] = WEIGHTS) -> Model:
    """texts: as `numbered` gives them; their training texts are learned from."""
    folder = shared_folder(texts.sparkSession)
    asked = brought_together(texts.select("block", "payload").mapInArrow(_ask(vocabulary.shards, True), SENT), "shard", keys=vocabulary.shards)
    return Model(vocabulary, folder, settle(asked.mapInArrow(_learn(folder, weights, False), "shard int, head array<long>")), weights)


def _look_up(folder: str):
    """A shard's trie, and each block's question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie, held, size = None, None, [], 0

        def done() -> pa.RecordBatch:
            return _sent([(block, now, payload) for (block, _), payload in zip(held, _answered(trie, [p for _, p in held]))])

        for batch in batches:
            for block, shard, payload, head in zip(*(batch.column(c).to_pylist() for c in ("block", "shard", "payload", "head"))):
                if held and (shard != now or size > TOGETHER):
                    yield done()
                    held, size = [], 0
                if shard != now:
                    now, trie = shard, None
                if head is not None:  # the trie's row comes first
                    trie = Trie(folder, f"{shard}.trie", head)
                    continue
                held.append((block, unpack(payload)))
                size += len(held[-1][1][4])
        if held:
            yield done()

    return run


def _score(shards: int, words: int, tokens: int, weights: tuple[float, float]):
    def run(kept: pa.Table, answered: pa.Table) -> pa.Table:
        out = [SCORED.empty_table()]
        for payload in kept.column("payload").to_pylist():
            own = Grams(payload, shards)
            backoff, bigram, trigram = np.zeros(len(own.node_v), np.uint8), np.zeros(len(own.node_v), np.uint8), np.zeros(len(own.order), np.uint8)
            answers = [unpack(x) for x in answered.sort_by("shard").column("payload").to_pylist()]
            if answers:
                backoff[own.node], bigram[own.node], trigram[own.order] = (np.concatenate([a[i] for a in answers]) for i in range(3))
            x, at = own.x, own.at
            base = (own.counts + 0.5) / (tokens + 0.5 * (words + 1))
            before = own.counts[x[at - 1]]
            p1 = base[x[at]]
            a2, a3, weight = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(backoff) + 1)
            a2[own.node_at] = CODEBOOK[bigram][own.node_inverse]
            a3[own.gram_at] = CODEBOOK[trigram][own.gram_inverse]
            weight[:-1] = np.where(backoff > 0, CODEBOOK[backoff], 1.0)
            weight[-1] = 1.0  # of contexts that weren't asked: parent -1
            p = a3[at] + weight[own.parent[at]] * (a2[at] + weights[0] / (before + weights[0]) * p1)
            starts = own.offsets[:-1]
            columns = [
                pa.array(own.ids, mask=own.none), pa.array(own.train), pa.array(own.lengths),
                pa.array(np.add.reduceat((own.counts[x[at]] > 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(np.log10(p1), starts)), pa.array(np.add.reduceat(np.log10(p), starts)),
            ]
            out.append(pa.Table.from_arrays(columns, schema=SCORED))
        return pa.concat_tables(out)

    return run


SCORED = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(texts: DataFrame, answers: DataFrame, known: Vocabulary, weights: tuple[float, float]) -> DataFrame:
    met = texts.groupBy("block").cogroup(answers.groupBy("block"))
    out = met.applyInArrow(_score(known.shards, known.words, known.tokens, weights), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(known.tokens).cast("long"))


def train(docs: DataFrame, weights: tuple[float, float] = WEIGHTS) -> Model:
    """A model of docs(text, ...), kept in the shared folder until the application ends."""
    shards = shards_for(docs, SHARD)
    tokens = tokenised(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), F.lit(True), shards)
    vocabulary = Vocabulary.of(tokens, shards)
    texts = numbered(tokens, vocabulary)
    model = fit(texts, vocabulary, weights)
    discard(tokens, texts)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs(doc_id, text, ...), which need not be what the model learned from: as `score`, train false."""
    known = model.vocabulary
    texts = numbered(tokenised(docs, F.lit(False), known.shards), known)
    asked = texts.select("block", "payload").mapInArrow(_ask(known.shards, False), SENT).withColumn("head", F.lit(None).cast("array<long>"))
    tries = model.tries.select(F.lit(-1).cast("long").alias("block"), "shard", F.lit(None).cast("binary").alias("payload"), "head")
    return _scored(texts, brought_together(tries.union(asked), "shard", "block", keys=known.shards).mapInArrow(_look_up(model.folder), SENT), known, model.weights)


def score(docs: DataFrame, train: Column, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """Every row of docs(doc_id, text, ...): doc_id, train, n_tokens, n_known (tokens that the training texts hold),
    train_tokens, base_score (of the unigrams) and score (of the model): log10 probabilities. As `train` on some rows and
    `score_texts` on all, but what blocks ask travels once: the shard that builds a trie looks up at once.

    Tokens: words `[^\x20\x09-\x0D]+` with A-Z lower-cased, then one end. train: which rows are learned from (null: not).
    A null or empty text is one end. Rows with equal or null doc_id each count and come out. Without training texts
    every probability is that of an unseen word. Words are known by 64-bit hashes. Other columns are ignored."""
    shards = shards_for(docs, SHARD)
    tokens = tokenised(docs, train, shards)
    vocabulary = Vocabulary.of(tokens, shards)
    texts = numbered(tokens, vocabulary)
    discard(tokens, vocabulary.table)
    asked = brought_together(texts.select("block", "payload").mapInArrow(_ask(shards, True), SENT), "shard", "block", keys=shards)
    return _scored(texts, asked.mapInArrow(_learn(shared_folder(docs.sparkSession), weights, True), SENT), vocabulary, weights)

"""Byte-level BPE: every distinct pre-token is encoded once, and its ids go back to the places where it stands.

1. Texts are cut into pre-tokens. A block of documents keeps the positions as codes of its own list of distinct
   pre-tokens; the list itself is dealt out by a hash of the pre-token.
2. A shard of the hash holds all blocks' copies of its pre-tokens (a frequent one comes once from each block, however
   often it stands there), encodes each distinct one once and sends each block the ids of those it asked for.
3. A block's ids and positions meet, and the ids are put together by position.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_bytes, blocks, brought_together, deltas, groups, pack, ragged, settle, shard_of, shuffle_partitions, unpack, word_hashes

#: Spaces at which a text may not be cut: those with white space before and after them, and white space at the end.
UNSAFE = re.compile(r"\s \s| \s* |\s\Z")
#: A pattern that takes a pre-token whole.
WHOLE = r"(?s:.+)"
#: Bytes of text in a block: the larger, the fewer blocks ask for the same pre-token. Units put together at once.
BLOCK, TOGETHER = 8_000_000, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class _Units(dict):
    """Codes of the pieces between spaces; a new one is cut by the pattern, the space before it included."""

    def __init__(self, find, tokens: dict[str, int], units: list[list[int]]):
        super().__init__()
        self.find, self.tokens, self.units = find, tokens, units

    def __missing__(self, piece: str) -> int:
        tokens = self.tokens
        self.units.append([tokens.setdefault(x, len(tokens)) for x in self.find(" " + piece)])
        self[piece] = len(self.units) - 1
        return self[piece]


def cut(texts: list[bytes], pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Positions of pre-tokens: codes of units and offsets of the texts; the units' pre-token codes and offsets; the
    pre-tokens. A unit is one pre-token, or those between two single spaces with the first of these: no match of
    the pattern crosses the place before a single space, so that each distinct unit is cut once."""
    tokens: dict[str, int] = {}
    units: list[list[int]] = []
    inner, alone = _Units(pattern.findall, tokens, units), {}

    def single(token: str) -> int:
        if token not in alone:
            alone[token] = len(units)
            units.append([tokens.setdefault(token, len(tokens))])
        return alone[token]

    codes, counts = [np.zeros(0, np.int32)], []
    for text in texts:
        string = text.decode("utf-8", "replace")
        if UNSAFE.search(string):
            own = [single(x) for x in pattern.findall(string)]
        else:
            first, *rest = string.split(" ")
            own = [single(x) for x in pattern.findall(first)]
            own += map(inner.__getitem__, rest)
        codes.append(np.array(own, dtype=np.int32))
        counts.append(len(own))
    flat = np.array([x for u in units for x in u], dtype=np.int32)
    return np.concatenate(codes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), flat, np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64), list(tokens)


def _positions(pattern: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, find = TaskContext.get().partitionId(), regex.compile(pattern)
        for k, block in enumerate(blocks(batches, BLOCK)):
            number = part << 32 | k
            codes, offsets, flat, unit_offsets, tokens = cut(block["text"], find)
            words = [t.encode("utf-8", "replace") for t in tokens]
            del tokens
            by_word = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)  # neighbours are alike, which packs well
            shard = shard_of(word_hashes(words), shards)[by_word]
            order = by_word[np.argsort(shard, kind="stable")]
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))  # a pre-token's code is its place among all that the block asks for
            often = np.argsort(-np.bincount(codes, minlength=len(unit_offsets) - 1), kind="stable")  # frequent units get small codes
            rank = np.empty(len(often), np.int32)
            rank[often] = np.arange(len(often))
            flat, unit_offsets = ragged(place[flat], unit_offsets, often)
            ids = np.array([x or 0 for x in block["doc_id"]], dtype=np.int64)
            none = np.array([x is None for x in block["doc_id"]])
            rows = [(number, -1, pack(deltas(ids), none, np.diff(offsets), rank[codes], flat, np.diff(unit_offsets).astype(np.int32), level=3))]
            edges = np.searchsorted(np.sort(shard, kind="stable"), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)):
                own = [words[i] for i in order[edges[s] : edges[s + 1]]]
                rows.append((number, int(s), pack(np.array([len(w) for w in own], dtype=np.uint32), np.frombuffer(b"".join(own), np.uint8), level=9)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "payload"])

    return run


def _encode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("own", pat_str=WHOLE, mergeable_ranks=ranks.value, special_tokens={})
        for shard, rows in groups(batches, "shard"):
            known: dict[bytes, int] = {}
            asked = []
            for row in rows:
                lengths, raw = unpack(row["payload"])
                ends, raw = np.cumsum(lengths).tolist(), raw.tobytes()
                asked.append([known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *ends], ends)])
            ids = [encoder.encode_ordinary(word.decode()) for word in known]
            flat, offsets = np.array([i for own in ids for i in own], dtype=np.int32), np.concatenate([[0], np.cumsum([len(own) for own in ids])])
            for row, own in zip(rows, asked):
                values, cuts = ragged(flat, offsets, np.array(own))
                payload = pack(values, np.diff(cuts).astype(np.int32), level=9)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([shard], pa.int32()), pa.array([payload], pa.binary())], ["block", "shard", "payload"])

    return run


def _reassemble(kept: pa.Table, answered: pa.Table) -> pa.Table:
    """A block's positions (one row) and the answers of the shards."""
    out = [OUTPUT.empty_table()]
    for payload in kept.column("payload").to_pylist():
        ids, none, counts, codes, flat, unit_lengths = unpack(payload)
        rows = answered.sort_by("shard").column("payload").to_pylist()
        ids = np.cumsum(ids)
        answers = [unpack(row) for row in rows]  # in the order of the shards, as the codes are
        values = np.concatenate([np.zeros(0, np.int32), *(a[0] for a in answers)])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(a[1] for a in answers)]))]).astype(np.int64)
        by_unit, by_unit_offsets = ragged(values, offsets, flat)
        unit_cuts = by_unit_offsets[np.concatenate([[0], np.cumsum(unit_lengths)])]
        text_cuts = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(text_cuts, text_cuts[at] + TOGETHER, side="right")) - 1)
            tokens, token_offsets = ragged(by_unit, unit_cuts, codes[text_cuts[at] : text_cuts[stop]])
            cuts = token_offsets[text_cuts[at : stop + 1] - text_cuts[at]]
            out.append(pa.Table.from_arrays([pa.array(ids[at:stop], mask=none[at:stop]), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tokens.astype(np.int32)))], schema=OUTPUT))
            at = stop
    return pa.concat_tables(out)


OUTPUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Every row of docs(doc_id, text, ...): doc_id and ids (array<int>), as the rank file's vocabulary encodes each
    match of the pattern separately, without special tokens. Null or empty text: no ids. Rows with equal or null
    doc_id each come out. The ranks (a vocabulary, of fixed size) are broadcast."""
    spark = docs.sparkSession
    shards = 2 * shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast(ranks)
    kept = settle(as_bytes(docs).mapInArrow(_positions(pattern, shards), "block long, shard int, payload binary"), payload=True, by="block")
    asked = brought_together(kept.where("shard >= 0"), "shard")
    answered = asked.mapInArrow(_encode(shared), "block long, shard int, payload binary")
    # the positions stay where they were written: only the answers move
    met = kept.where("shard < 0").groupBy("block").cogroup(answered.groupBy("block"))
    return met.applyInArrow(_reassemble, "doc_id long, ids array<int>")


def decode_column(spark, ranks: dict[bytes, int], ids: Column) -> Column:
    """The bytes (binary) of a column of ids: the distinct ids of a batch of rows are joined with the table (id, token
    bytes), a vocabulary of fixed size that every task holds, and each place takes its id's bytes; null: null. An id
    without a token raises."""
    shared = spark.sparkContext.broadcast(ranks)

    @arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.table({"id": pa.array(list(shared.value.values()), pa.int32()), "token": pa.array(list(shared.value), pa.binary())})
        size = max(shared.value.values(), default=-1) + 1
        for batch in batches:
            lengths = np.array(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at, flat, valid, out = np.concatenate([[0], np.cumsum(lengths)]), batch.flatten().to_numpy(), batch.is_valid().to_pylist(), []
            start = 0
            while start < len(valid):  # some rows at a time
                stop = max(start + 1, int(np.searchsorted(at, at[start] + TOGETHER, side="right")) - 1)
                own = flat[at[start] : at[stop]]
                there = np.zeros(size, bool)
                if len(own) and not 0 <= own.min() <= own.max() < size:
                    raise ValueError("an id is not in the vocabulary")
                there[own] = True
                distinct = np.flatnonzero(there)
                joined = pa.table({"id": pa.array(distinct, pa.int32())}).join(table, "id", join_type="inner").sort_by("id")
                if len(joined) != len(distinct):
                    raise ValueError("an id is not in the vocabulary, or is there twice")
                tokens = joined["token"].to_pylist()
                raw, offsets = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
                place = np.cumsum(there, dtype=np.int32)[own] - 1
                out += [ragged(raw, offsets, place[at[i] - at[start] : at[i + 1] - at[start]])[0].tobytes() if valid[i] else None for i in range(start, stop)]
                start = stop
            yield pa.array(out, pa.binary())

    return decoded(ids)

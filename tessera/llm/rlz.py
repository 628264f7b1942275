"""Substring dedup by relative Lempel-Ziv parsing against a reference that is indexed in blocks.

The reference is the corpus itself. Its index is cut into reference blocks by minimisers: a text is cut into *segments*,
runs of windows (W consecutive words) with the same minimiser, the least hash of a window's K-word sequences; a segment
belongs to the block that this hash decides. Equal windows have equal minimisers, so that a window of the corpus stands in
that one block or nowhere, and asking this block is asking all.

1. A batch of texts sends each distinct minimiser once and learns which of them other batches hold too: what has none in
   common with another document can't repeat, and its words needn't travel.
2. Of the other segments, each distinct one is sent once with all its words, the least document that holds it and its place
   there. What a third of all documents share comes once from each batch, however often it stands there; all places stay
   at home.
3. A reference block indexes its windows by hash, and compares words wherever hashes are equal. It parses every segment
   greedily: a factor begins at the first window that a document with a smaller id holds too (of several the least),
   and is as long as the text and the reference go on alike. At the border of a factor the parse goes on with the window
   after its last one, not with the word after its last word, so that windows across the border are looked up as well.
4. At home, factors go to all places of their segment, are joined where they continue each other across segments, and
   their words are the duplicate spans. A factor is at least one window long: shorter ones are never made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import as_bytes, blocks, brought_together, gram_hashes, groups, mixed, pack, questions, ragged, seen_again, settle, shards_for, unpack, word_codes, word_hashes

#: Words of a window, and of the sequences among which its minimiser is the least; windows of a segment at most.
WINDOW, GRAM, MOST = 13, 8, 64
#: Bytes of text in a batch, and bytes of text for each reference block.
BATCH, SHARD = 6_000_000, 16_000_000
#: Stands for a null id in comparisons: larger than every other.
LAST = np.iinfo(np.int64).max
ANSWER = "block long, shard int, payload binary"
SENT = f"{ANSWER}, text binary, rows binary"


def segments(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """First word (of all texts' words), number of windows, text and minimiser of each segment. h: the words' hashes."""
    gram = min(GRAM, window)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    n = max(0, len(h) - window + 1)
    at = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    if not len(at):
        return at, at, at, at.astype(np.uint64)
    least = mixed(gram_hashes(h, gram))
    low = least[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(low, least[j : j + n], out=low)
    low, owner = low[at], doc[at]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(new | (within % MOST == 0))
    return at[first], np.diff(np.append(first, len(at))), owner[first].astype(np.int64), mixed(low[first])


def _batch(shards: int, window: int, row: str | None):
    """For each batch of texts: what stays at home (shard -1), and for each reference block 48 bits of the distinct
    minimisers that belong there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, BATCH)):
            number = part << 32 | k
            words = [text.split() for text in block["text"]]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(offsets[-1]))
            del words
            first, count, owner, low = segments(h, offsets, window)
            ids = np.array([LAST if x is None else x for x in block["doc_id"]], dtype=np.int64)
            asked, which = np.unique(low, return_inverse=True)
            # minimisers that two documents of this batch hold repeat, whatever others hold
            pairs = np.unique(which.astype(np.int64) * len(ids) + np.unique(ids, return_inverse=True)[1][owner])
            here = np.bincount(pairs // max(len(ids), 1), minlength=len(asked)) > 1
            home = pack(ids, lengths.astype(np.int32), np.bincount(owner, minlength=len(ids)).astype(np.int32), np.diff(first, prepend=0).astype(np.int32), count.astype(np.uint8), which.astype(np.int32), here)
            text = pack(np.array([len(t) for t in block["text"]], dtype=np.int64), np.frombuffer(b"".join(block["text"]), np.uint8), level=3)
            rows = [(number, -1, home, text, "\0".join(block[row]).encode() if row else b"")]
            rows += [(number, s, question, None, None) for s, question in questions(asked, shards)]
            yield _rows(rows)

    return run


class Home:
    """A batch's segments, as it keeps them."""

    def __init__(self, payload: bytes):
        self.ids, n_words, n_segments, first, count, self.which, self.here = unpack(payload)
        self.n_words, self.count = n_words.astype(np.int64), count.astype(np.int64)
        self.first, self.owner = np.cumsum(first.astype(np.int64)), np.repeat(np.arange(len(self.ids)), n_segments)
        self.offsets = np.concatenate([[0], np.cumsum(self.n_words)])


def _ask(shards: int, window: int):
    """For each batch and reference block: the distinct segments whose minimiser repeats, with their words, their least
    documents and places; and (for the answer, which takes them home again) the places of all segments that are one of them."""

    def run(kept: pa.Table, answered: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for block, payload, packed in zip(*(kept.column(c).to_pylist() for c in ("block", "payload", "text"))):
            home = Home(payload)
            bits = [unpack(x) for x in answered.sort_by("shard").column("payload").to_pylist()]
            repeats = home.here | (np.concatenate([np.unpackbits(b, count=int(n[0])) for b, n, _ in bits]).astype(bool) if bits else False)
            some = np.flatnonzero(repeats[home.which]) if len(home.which) else np.zeros(0, np.int64)
            if not len(some):
                continue
            sizes, raw = unpack(packed)
            raw, ends = raw.tobytes(), np.cumsum(sizes)
            docs = np.unique(home.owner[some])
            codes, offsets, vocabulary = word_codes([raw[ends[d] - sizes[d] : ends[d]] for d in docs.tolist()])
            start = np.zeros(len(home.ids), np.int64)
            start[docs] = offsets[:-1]
            owner, count, which = home.owner[some], home.count[some], home.which[some]
            place = home.first[some] - home.offsets[owner]
            first = start[owner] + place
            own = distinct(codes, first, count + window - 1)
            by = np.lexsort((place, home.ids[owner], own, which))  # equal segments have equal minimisers
            new = np.concatenate([[True], np.diff(own[by]) != 0])
            lead = by[new]  # of each distinct segment, in the order of the shards, the least document and place
            to = np.cumsum(new) - 1
            # the shards' borders among the batch's minimisers are where its questions were cut
            cuts = np.cumsum([int(n[0]) for _, n, _ in bits])
            numbers = sorted(answered.column("shard").to_pylist())
            edges = np.concatenate([[0], np.searchsorted(which[lead], cuts)])
            for s, a, b in zip(numbers, edges[:-1], edges[1:]):
                if a < b:
                    part = lead[a:b]
                    length = count[part] + window - 1
                    used, inverse = np.unique(codes[np.repeat(first[part] - (np.cumsum(length) - length), length) + np.arange(length.sum())], return_inverse=True)
                    named = b" ".join([vocabulary[w] for w in used.tolist()])
                    c, d = np.searchsorted(to, (a, b))
                    rows.append((block, s, pack(home.ids[owner[part]], place[part].astype(np.int32), count[part].astype(np.uint8), inverse.astype(np.uint16 if len(used) < 65536 else np.uint32), np.frombuffer(named, np.uint8), (to[c:d] - a).astype(np.int32), some[by[c:d]].astype(np.int32), level=3)))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 3, ASKED)], schema=ASKED)

    return run


def distinct(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each distinct sequence of words codes[first : first + length], by the words themselves: sequences of
    one length are rows of a matrix."""
    out, n = np.zeros(len(first), np.int64), 0
    for k in np.unique(length):
        at = np.flatnonzero(length == k)
        matrix = np.ascontiguousarray(codes[first[at][:, None] + np.arange(k)])
        _, inverse = np.unique(matrix.view(np.dtype((np.void, matrix.itemsize * int(k)))).reshape(-1), return_inverse=True)
        out[at] = inverse + n
        n += inverse.max() + 1
    return out


ROWS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary()), ("text", pa.binary()), ("rows", pa.binary())])


ASKED = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ROWS)], schema=ROWS)


def reference(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """The segments of all batches as one text: words (numbers, equal for equal words), their hashes, and of each
    segment the document, place, number of windows."""
    numbers: dict[bytes, int] = {}
    words = [np.zeros(0, np.int32)]
    for _, _, _, inverse, named in parts:
        own = np.array([numbers.setdefault(w, len(numbers)) for w in named.tobytes().split(b" ")], dtype=np.int32)
        words.append(own[inverse])
    doc, place, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    text = np.concatenate(words)
    return text, word_hashes(list(numbers))[text], doc, place, count.astype(np.int64)


def alike(text: np.ndarray, at: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """A number for each window text[at : at + window], equal only for equal words: by its hash, words compared."""
    _, head, out = np.unique(key, return_index=True, return_inverse=True)
    same = np.ones(len(at), bool)
    for j in range(window):
        same &= text[at + j] == text[at[head[out]] + j]
    other: dict[tuple, int] = {}
    for i in np.flatnonzero(~same).tolist():  # equal hashes of different words
        out[i] = other.setdefault(tuple(text[at[i] : at[i] + window].tolist()), len(head) + len(other))
    return out


def parse(text: np.ndarray, h: np.ndarray, doc: np.ndarray, place: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The factors of each segment: segment, first window in it, number of windows, and document and place of the
    reference. A factor begins at a window that also starts in a document with a smaller id."""
    length = count + window - 1
    first = np.cumsum(length) - length
    segment = np.repeat(np.arange(len(count), dtype=np.int32), count)
    at = np.arange(len(segment)) + np.repeat(first - (np.cumsum(count) - count), count)
    key = gram_hashes(h, window)[at]
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    some = np.sort(order[np.concatenate([again, [False]]) | np.concatenate([[False], again])])  # in the order of the text
    none = np.zeros(0, np.int64)
    if not len(some):
        return none, none, none, none, none
    owner, begin = segment[some].astype(np.int64), at[some]
    inside = begin - first[owner]
    kind = alike(text, begin, key[some], window)
    by = np.lexsort((place[owner] + inside, doc[owner], kind))
    head = np.concatenate([[True], np.diff(kind[by]) != 0])
    source = np.empty(len(some), np.int64)
    source[by] = by[np.flatnonzero(head)[np.cumsum(head) - 1]]  # the window's first place in the least document
    older = doc[owner[source]] < doc[owner]
    # windows some[i] and some[i] + 1 stand side by side if they do in the text
    beside = np.concatenate([(np.diff(begin) == 1) & (np.diff(owner) == 0), [False]])
    out: list[tuple[np.ndarray, ...]] = []
    start = np.flatnonzero(older & ~np.concatenate([[False], (beside & older)[:-1]]))  # where chains of such windows begin
    last = np.flatnonzero(older & ~(beside & np.append(older[1:], False)))
    end = last + 1  # of each chain
    now = start.copy()
    while len(now):
        src, size, live = source[now], np.ones(len(now), np.int64), np.arange(len(now))
        while len(live):
            a, b = now[live] + size[live] - 1, src[live] + size[live] - 1
            inside_chain = a + 1 < end[live]
            live, a, b = live[inside_chain], a[inside_chain], b[inside_chain]
            on = beside[b]
            on &= kind[a + 1] == kind[np.minimum(b + 1, len(kind) - 1)]
            live = live[on]
            size[live] += 1
        out.append((owner[now], inside[now], size, doc[owner[src]], place[owner[src]] + inside[src]))
        now = now + size
        more = now < end
        now, end = now[more], end[more]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (none,) * 5


def _parse(window: int):
    """For each reference block: the factors of the segments that each batch sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groups(batches, "shard"):
            numbers = [row["block"] for row in rows]
            parts = [unpack(row["payload"]) for row in rows]
            del rows
            starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
            text, h, doc, place, count = reference([p[:5] for p in parts])
            home = [(p[0], p[1], p[2], p[5], p[6]) for p in parts]
            del parts
            found = parse(text, h, doc, place, count, window)
            by = np.lexsort((found[1], found[0]))
            found = [x[by] for x in found]
            cuts = np.searchsorted(found[0], starts)
            out = []
            for k, number in enumerate(numbers):
                own = [x[cuts[k] : cuts[k + 1]] for x in found]
                out.append((number, shard, pack(*home[k], (own[0] - starts[k]).astype(np.int32), own[1].astype(np.uint8), own[2].astype(np.uint8), own[3], own[4].astype(np.int32))))
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[a : a + 64]), ASKED)], schema=ASKED)

    return run


def factors(start, count, ref_doc, ref_at) -> tuple[np.ndarray, ...]:
    """Factors of one text, by place: parts that continue each other in the text and in the reference are joined."""
    sort = np.argsort(start, kind="stable")
    start, count, ref_doc, ref_at = start[sort], count[sort], ref_doc[sort], ref_at[sort]
    new = np.concatenate([[True], (start[1:] != start[:-1] + count[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_at[1:] != ref_at[:-1] + count[:-1])])
    first = np.flatnonzero(new)
    return start[first], np.add.reduceat(count, first), ref_doc[first], ref_at[first]


def without(text: bytes, words: list[bytes], gone: np.ndarray, layout: bool) -> bytes:
    """The text without some of its words: joined by single spaces, or with the white space after each kept word."""
    if not layout:
        return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
    out, at = [], 0
    for word, g in zip(words, gone.tolist()):
        start = text.index(word, at)
        if g:
            out.append(text[at:start] if not out else b"")
        else:
            out.append(text[at : start + len(word)])
        at = start + len(word)
    return b"".join([*out, text[at:]]) if not gone.all() else b""


def _remove(window: int, layout: bool, row: str | None):
    """A batch's texts and the factors of its segments: the texts without duplicate words."""

    def run(kept: pa.Table, answered: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        for payload, packed, names in zip(*(kept.column(c).to_pylist() for c in ("payload", "text", "rows"))):
            home = Home(payload)
            ids, n_words = home.ids, home.n_words
            sizes, raw = unpack(packed)
            raw, ends = raw.tobytes(), np.cumsum(sizes).tolist()
            carried = names.decode().split("\0") if row else []
            parts, n = [[np.zeros(0, np.int64)] * 10], 0  # segments and factors of all reference blocks
            for value in answered.column("payload").to_pylist():
                own = [x.astype(np.int64) for x in unpack(value)]
                own[3] += n
                own[5] += n
                n += len(own[0])
                parts.append(own)
            lead_doc, lead_place, lead_count, which, some, seg, first, size, doc, ref = (np.concatenate([p[i] for p in parts]) for i in range(10))
            cuts = np.searchsorted(seg, np.arange(n + 1))
            # all places of all segments: those of a document after the segment's least are duplicates of that one, whole
            owner = home.owner[some]
            place = home.first[some] - home.offsets[owner]
            whole = np.flatnonzero(lead_doc[which] < ids[owner])
            asked = np.flatnonzero((lead_doc[which] == ids[owner]) & (cuts[which + 1] > cuts[which]))
            rows_of, lists = ragged(np.arange(len(seg)), cuts, which[asked])
            by = np.repeat(asked, np.diff(lists))
            spans = [
                np.concatenate([owner[whole], owner[by]]),
                np.concatenate([place[whole], place[by] + first[rows_of]]),
                np.concatenate([lead_count[which[whole]], size[rows_of]]),
                np.concatenate([lead_doc[which[whole]], doc[rows_of]]),
                np.concatenate([lead_place[which[whole]], ref[rows_of]]),
            ]
            sort = np.lexsort((spans[1], spans[0]))
            spans = [x[sort] for x in spans]
            edges = np.searchsorted(spans[0], np.arange(len(ids) + 1))
            columns: list[list] = [[], [], [], [], []]
            for d, (a, b) in enumerate(zip([0, *ends], ends)):
                text, n = raw[a:b], int(n_words[d])
                own = [x[edges[d] : edges[d + 1]] for x in spans[1:]]
                found: list = []
                gone = 0
                if len(own[0]):
                    start, count, ref_doc, ref_at = factors(*own)
                    length = count + window - 1
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    text = without(text, text.split(), covered, layout)
                    found = [{"start": a, "length": b, "ref_doc": c, "ref_start": e} for a, b, c, e in zip(start.tolist(), length.tolist(), ref_doc.tolist(), ref_at.tolist())]
                elif not layout:
                    text = b" ".join(text.split())
                for column, x in zip(columns, (None if ids[d] == LAST else int(ids[d]), text.decode("utf-8", "replace"), n, gone, found)):
                    column.append(x)
            if len(ids):
                out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *([carried] if row else [])], schema)], schema=schema))
        return pa.concat_tables(out)

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("factors", FACTORS), *([(row, pa.string())] if row else [])])
    return run


FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
SCHEMA = "doc_id long, text string, n_words long, n_removed long, factors array<struct<start: int, length: int, ref_doc: long, ref_start: int>>"


def dedupe(docs: DataFrame, window: int = WINDOW, layout: bool = False, row: str | None = None, spent: list[DataFrame] | None = None) -> DataFrame:
    """Every row of docs(doc_id, text, ...): doc_id, the text without its duplicate words, n_words (before), n_removed and
    the factors: places (in words) and lengths of the duplicate spans, with a reference document and place of each.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id, as judged
    on the input. layout: keep the white space of the kept words (else they are joined by single spaces). Null
    text: no words. A null doc_id counts as larger than every other, and rows of equal doc_id aren't duplicates
    of each other. Windows are compared by their words. row: a string column (without null characters and nulls) to
    carry along; other columns are ignored. spent: takes the table that may go when the result has been read."""
    own, shards = [row] if row else [], shards_for(docs, SHARD)
    kept = settle(as_bytes(docs, *own).mapInArrow(_batch(shards, window, row), SENT), payload=True, by="block")
    home = kept.where("shard < 0")
    repeated = brought_together(kept.where("shard >= 0").select("block", "shard", "payload"), "shard", keys=shards).mapInArrow(seen_again, ANSWER)
    asked = home.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_ask(shards, window), ANSWER)
    found = brought_together(asked, "shard", keys=shards).mapInArrow(_parse(window), ANSWER)
    if spent is not None:
        spent.append(kept)
    # the texts stay where they were written: only minimisers, segments and factors move
    return home.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(window, layout, row), SCHEMA + (f", {row} string" if row else ""))

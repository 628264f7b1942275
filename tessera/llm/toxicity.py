"""Toxicity: a convolutional text classifier over hashed word embeddings, with several filter widths, max pooling and
a logistic output, trained in numpy; thresholds are calibrated for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import word_codes, word_hashes
from .quality import labelled

#: Hash buckets, embedding size, filter widths, filters of each width, labelled rows used at most, passes.
BUCKETS, SIZE, WIDTHS, FILTERS, MOST_LABELLED, EPOCHS = 1 << 20, 4, (1, 2, 3), 4, 8000, 4
PAD = max(WIDTHS) - 1
STRIP = ".,;:!?\"'()[]{}*_-"
#: Characters of a word's stem.
PREFIX = 4


def word_buckets(vocabulary: list[bytes]) -> np.ndarray:
    """Two buckets (from 1; 0 is the padding) for each word, lower-cased and without punctuation around it: the word's own
    and that of its first PREFIX characters. A word's embedding is the sum of both rows, so that a rare form of a known
    stem isn't unknown."""
    strings = [w.decode("utf-8", "replace").lower().strip(STRIP) for w in vocabulary]
    own = word_hashes([x.encode() for x in strings]) % np.uint64(BUCKETS - 1)
    stem = word_hashes([x[:PREFIX].encode() for x in strings], seed=1) % np.uint64(BUCKETS - 1)
    return np.stack([own, stem], axis=1).astype(np.int64).reshape(-1, 2) + 1


def padded(codes: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes with PAD padding codes after each text, and the texts' offsets."""
    n = len(offsets) - 1
    out = np.full(len(codes) + PAD * n, pad, codes.dtype)
    out[np.arange(len(codes)) + PAD * np.repeat(np.arange(n), np.diff(offsets))] = codes
    return out, offsets + PAD * np.arange(n + 1)


@dataclass
class Network:
    embedding: np.ndarray  #: buckets by size; row 0 (padding) is zero
    taps: list[np.ndarray]  #: for each width: (width, size, filters)
    shift: np.ndarray  #: of each filter of each width
    output: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """rows: the embeddings of the codes. The largest value of each filter in each text, and all values."""
        out, each = [], []
        for width, tap in zip(WIDTHS, self.taps):
            n = len(codes)
            act = (rows @ tap[0])[codes]
            for j in range(1, width):
                act[: n - j] += (rows @ tap[j])[codes[j:]]
            each.append(act)
            out.append(np.maximum.reduceat(act, offsets[:-1], axis=0))
        return np.concatenate(out, axis=1), each

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < 1_500_000):
                size += len(texts[stop])
                stop += 1
            codes, offsets, vocabulary = word_codes(texts[at:stop])
            rows = self.embedding[np.concatenate([word_buckets(vocabulary), [[0, 0]]])].sum(axis=1)
            top, _ = self.pooled(rows, *padded(codes, offsets, len(vocabulary)))
            raw = np.maximum(top + self.shift, 0) @ self.output + self.bias
            out[at:stop] = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
            at = stop
        return out

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("", 0.5))


def log_odds(codes: np.ndarray, offsets: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """For each bucket in use, the smoothed log-odds that a text which holds it is toxic; shrunk, so that a word which
    few texts hold starts near zero."""
    owner = np.repeat(np.arange(len(label)), np.diff(offsets))
    pairs = np.unique(codes * np.int64(len(label)) + owner)
    bucket, text = pairs // len(label), pairs % len(label)
    share = label.mean()
    toxic, all_ = np.bincount(bucket, label[text], n), np.bincount(bucket, minlength=n)
    p = (toxic + 6 * share) / (all_ + 6)
    return np.log(p / (1 - p)) - np.log(share / (1 - share))


def fit(texts: list[bytes], label: np.ndarray, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    held, counts, known = [np.zeros(0, np.int32)], [0], {}
    for at in range(0, len(texts), 100):  # words are held for a few texts at a time
        codes, offsets, vocabulary = word_codes(texts[at : at + 100])
        held.append(np.array([known.setdefault(w, len(known)) for w in vocabulary], dtype=np.int32)[codes])
        counts += np.diff(offsets).tolist()
    codes, offsets = np.concatenate(held), np.cumsum(counts)
    used, rows_of = np.unique(word_buckets(list(known)), return_inverse=True)  # training keeps only buckets in use
    rows_of = np.concatenate([rows_of.reshape(-1, 2), [[len(used)] * 2]])
    known.clear()
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    E = rng.normal(0, 0.02, (len(used) + 1, SIZE)).astype(np.float32)
    for column in (0, 1):
        E[:-1, 0] += log_odds(rows_of[codes, column], offsets, label, len(used)) / 4
    E[-1] = 0
    net = Network(E, [rng.normal(0, 0.05, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.5, np.float32), float(np.log(share / (1 - share))))
    for tap in net.taps:
        tap[0, 0] += 1.0
    seen = [np.full_like(x, 1e-3) for x in (E, net.shift, net.output, *net.taps)]
    seen_b = 1e-3
    weight = np.sqrt(np.where(label > 0, 0.5 / share, 0.5 / (1 - share)))  # between rows alike and labels alike
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            lengths = offsets[rows + 1] - offsets[rows]
            own = np.concatenate([[0], np.cumsum(lengths)])
            batch, off = padded(codes[np.repeat(offsets[rows] - own[:-1], lengths) + np.arange(own[-1])].astype(np.int64), own, len(rows_of) - 1)
            local, inverse = np.unique(batch, return_inverse=True)
            embedded = E[rows_of[local]].sum(axis=1)
            top, each = net.pooled(embedded, inverse, off)
            live = top + net.shift
            hidden = np.maximum(live, 0)
            raw = hidden @ net.output + net.bias
            slope = (weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[rows]) / len(rows)).astype(np.float32)
            back = slope[:, None] * net.output * (live > 0)
            g_out, g_shift = hidden.T @ slope + 1e-4 * net.output, back.sum(axis=0)
            gE, g_taps = np.zeros((len(local), SIZE), np.float32), []
            for k, (width, act) in enumerate(zip(WIDTHS, each)):
                g = np.zeros_like(net.taps[k])
                peak = np.repeat(top[:, k * FILTERS : (k + 1) * FILTERS], np.diff(off), axis=0)
                doc = np.repeat(np.arange(len(rows)), np.diff(off))
                for f in range(FILTERS):
                    hits = np.flatnonzero(act[:, f] >= peak[:, f])
                    _, first = np.unique(doc[hits], return_index=True)  # the first place of the largest value
                    places, b = hits[first], back[:, k * FILTERS + f]
                    for j in range(width):
                        inside = places + j < len(batch)
                        c = inverse[np.minimum(places + j, len(batch) - 1)]
                        g[j, :, f] += (embedded[c] * (b * inside)[:, None]).sum(axis=0)
                        np.add.at(gE, c, (b * inside)[:, None] * net.taps[k][j, :, f])
                g_taps.append(g)
            live = np.flatnonzero((gE != 0).any(axis=1) & (local < len(rows_of) - 1))  # the padding stays zero
            touched, to = np.unique(rows_of[local[live]], return_inverse=True)
            g_rows = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(g_rows, to.reshape(-1, 2), gE[live][:, None, :])
            seen[0][touched] += g_rows**2
            E[touched] -= 0.05 * g_rows / np.sqrt(seen[0][touched])
            for x, g, s in zip((net.shift, net.output, *net.taps), (g_shift, g_out, *g_taps), seen[1:]):
                s += g**2
                x -= 0.05 * g / np.sqrt(s)
            seen_b += slope.sum() ** 2
            net.bias -= 0.05 * slope.sum() / np.sqrt(seen_b)
    whole = np.zeros((BUCKETS, SIZE), np.float32)
    whole[used] = E[:-1]
    net.embedding = whole
    return net


def calibrate(net: Network, score: np.ndarray, label: np.ndarray, lang: list[str | None], least: int = 20) -> None:
    """For each language with at least `least` toxic rows (and "" for the rest): the threshold of the best F1."""
    by: dict[str, list[int]] = {"": list(range(len(label)))}
    for k, name in enumerate(lang):
        by.setdefault(name or "", []).append(k) if name else None
    for name, rows in by.items():
        s, y = score[rows], label[rows]
        if name and y.sum() < least or not y.sum():
            continue
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(rows) + 1) + y.sum())
        f1[:-1][s[order][:-1] == s[order][1:]] = 0  # a threshold can't part ties
        best = int(f1.argmax())
        below = s[order][best + 1] if best + 1 < len(rows) else 0.0
        net.thresholds[name] = float((s[order][best] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> Network:
    """Fitted on the whole texts of at most `most` labelled documents, of at most quality.MOST_BYTES in all; every fifth
    calibrates and isn't fitted on. docs needs doc_id and text; a column lang, if there, is used for calibration only
    (of several rows of an id the largest name counts)."""
    rows = labelled(docs, labels, label, most)
    if "lang" in docs.columns:
        langs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("lang").alias("lang"))
    table = rows.toArrow().sort_by("doc_id")
    texts, y = table["text"].to_pylist(), table["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
        return Network(np.zeros((BUCKETS, SIZE), np.float32), [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 5 == 4
    net = fit([t for t, h in zip(texts, held) if not h], y[~held])
    names = {r["doc_id"]: r["lang"] for r in langs.collect()} if "lang" in docs.columns else {}
    calibrate(net, net.score([t for t, h in zip(texts, held) if h]), y[held], [names.get(i) for i, h in zip(table["doc_id"].to_pylist(), held) if h])
    return net


def toxicity_column(spark, net: Network, text: Column) -> Column:
    """The probability (double) that a text is toxic; a null text counts as an empty one."""
    shared = spark.sparkContext.broadcast(net)  # BUCKETS * SIZE floats: 16 MB, whatever the input

    @arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score([x or b"" for x in batch.to_pylist()]), pa.float64())

    return toxicity(F.coalesce(text.cast("binary"), F.lit(b"")))


def threshold_column(net: Network, lang: Column) -> Column:
    """The calibrated threshold of a language column, the general one for the rest."""
    out = F.lit(net.threshold(None))
    for name, value in net.thresholds.items():
        if name:
            out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out

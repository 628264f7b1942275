"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata.

y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]: the pairwise interactions of all
features cost time linear in their number by the sum-of-squares identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_bytes, blocks, settle, word_codes, word_hashes
from .features import NAMES, odd_words, structure

#: Buckets of hashed words; factors; passes.
BUCKETS, FACTORS, EPOCHS = 1 << 16, 8, 6
#: Labelled documents used at most, and bytes of their texts at most: those with the least hash of their id.
MOST_LABELLED, MOST_BYTES = 8000, 32_000_000
DENSE = len(NAMES)


def featured(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a list of texts: (place, value, offsets) of sparse features. Places 0..DENSE-1 are the structure
    statistics; the words' values are square roots of counts, scaled to length one."""
    codes, offsets, vocabulary = word_codes(texts)
    odd = odd_words(vocabulary)
    buckets = (word_hashes([w.lower() for w in vocabulary]) % np.uint64(BUCKETS)).astype(np.int64) + DENSE
    places, values, counts = [], [], []
    for d, text in enumerate(texts):
        own = codes[offsets[d] : offsets[d + 1]]
        place, n = np.unique(buckets[own], return_counts=True)
        value = np.sqrt(n)
        places += [np.arange(DENSE), place]
        values += [np.array(structure(text, own, odd)), value / max(np.sqrt((value**2).sum()), 1e-9)]
        counts.append(DENSE + len(place))
    return np.concatenate(places), np.concatenate(values).astype(np.float32), np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, place: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and the sums of each factor."""
        scaled = self.factors[place] * value[:, None]
        sums = np.add.reduceat(scaled, offsets[:-1], axis=0)
        squares = np.add.reduceat((scaled**2).sum(axis=1), offsets[:-1])
        return self.bias + np.add.reduceat(self.linear[place] * value, offsets[:-1]) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < 1_500_000):
                size += len(texts[stop])
                stop += 1
            out[at:stop] = 1 / (1 + np.exp(-np.clip(self.raw(*featured(texts[at:stop]))[0], -40, 40)))
            at = stop
        return out


def fit(place: np.ndarray, value: np.ndarray, offsets: np.ndarray, label: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over small batches; the rarer label's rows count as much as the other's in all."""
    rng = np.random.default_rng(seed)
    size = DENSE + BUCKETS
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.03, (size, FACTORS)).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1e-2
    share = np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3)
    weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            lengths = offsets[rows + 1] - offsets[rows]
            own = np.concatenate([[0], np.cumsum(lengths)])
            take = np.repeat(offsets[rows] - own[:-1], lengths) + np.arange(own[-1])
            p, x = place[take], value[take]
            raw, sums = m.raw(p, x, own)
            slope = weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[rows]) / len(rows)
            s = np.repeat(slope, lengths).astype(np.float32)
            unique, inverse = np.unique(p, return_inverse=True)
            gw = np.bincount(inverse, s * x) + 1e-5 * m.linear[unique]
            towards = (s * x)[:, None] * (np.repeat(sums, lengths, axis=0) - m.factors[p] * x[:, None])
            gv = np.stack([np.bincount(inverse, towards[:, f]) for f in range(FACTORS)], axis=1) + 1e-4 * m.factors[unique]
            seen_w[unique] += gw**2
            seen_v[unique] += gv**2
            seen_b += slope.sum() ** 2
            m.linear[unique] -= 0.3 * gw / np.sqrt(seen_w[unique])
            m.factors[unique] -= 0.05 * gv / np.sqrt(seen_v[unique])
            m.bias -= 0.3 * slope.sum() / np.sqrt(seen_b)
    return m


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text (bytes, whole) and y of at most `most` labelled documents with at most `most_bytes` of text in all:
    in the order of a hash of the id, as many as fit (a document that doesn't is passed over). Labels are 0 or 1 (others
    and nulls are left out). Of repeated labels of an id the largest counts, of several rows of an id the one whose
    text has the largest hash, so that repeats change nothing."""
    spark = docs.sparkSession
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # bounded by `most`
    small = spark.createDataFrame([(r["doc_id"], r["y"], k) for k, r in enumerate(chosen)], "doc_id long, y int, place int")
    there = as_bytes(docs).join(F.broadcast(small), "doc_id")
    one = settle(there.groupBy("doc_id", "y", "place").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "place", "t.text"))
    fits, total = [], 0
    for r in one.select("doc_id", "place", F.octet_length("text").alias("n")).orderBy("place").collect():  # as many rows
        if total + r["n"] <= most_bytes:
            total += r["n"]
            fits.append((r["doc_id"],))
    return one.join(F.broadcast(spark.createDataFrame(fits, "doc_id long")), "doc_id", "left_semi").select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Machine:
    """Features are made in the executors; the driver gets those of at most `most` documents."""

    def run(batches):
        for block in blocks(batches, 1_500_000):
            place, value, offsets = featured(block["text"])
            cut = offsets[1:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["doc_id"], pa.int64()), pa.array(block["y"], pa.int32()), pa.array([x.astype(np.int32) for x in np.split(place, cut)], pa.list_(pa.int32())), pa.array(np.split(value, cut), pa.list_(pa.float32()))],
                ["doc_id", "y", "place", "value"],
            )

    rows = labelled(docs, labels, label, most).mapInArrow(run, "doc_id long, y int, place array<int>, value array<float>").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return Machine(0.0, np.zeros(DENSE + BUCKETS, np.float32), np.zeros((DENSE + BUCKETS, FACTORS), np.float32))
    lists = rows["place"].combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    machine = fit(lists.flatten().to_numpy().astype(np.int64), rows["value"].combine_chunks().flatten().to_numpy(), offsets, rows["y"].to_numpy())
    del lists, rows
    pa.default_memory_pool().release_unused()
    return machine


def quality_column(spark, machine: Machine, text: Column) -> Column:
    """The probability (double) that a text has label 1; a null text counts as an empty one."""
    shared = spark.sparkContext.broadcast(machine)  # (DENSE + BUCKETS) * (FACTORS + 1) floats, about 2.4 MB

    @arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score([x or b"" for x in batch.to_pylist()]), pa.float64())

    return quality(F.coalesce(text.cast("binary"), F.lit(b"")))

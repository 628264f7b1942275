"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import blocks, brought_together, pack, unpack

#: Hash buckets of n-grams, orders of n-grams, the smoothing count, and characters worked on at once.
BUCKETS, ORDERS, ALPHA, CHARS = 1 << 15, (1, 2, 3), 0.5, 1_000_000
#: The largest matrix that is broadcast, in values (buckets times languages).
MOST_VALUES = 1 << 24
UNKNOWN = "und"


def characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a line end after each, and the offsets."""
    strings = [t.decode("utf-8", "replace").lower() + "\n" for t in texts]
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


def ngrams(points: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place; BUCKETS (none) where it would run past the end of its text."""
    n = max(len(points) - order + 1, 0)
    h = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        h = (h ^ points[j : j + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    out = np.full(len(points), BUCKETS, np.int64)
    out[:n] = h & np.uint32(BUCKETS - 1)
    for j in range(1, order):
        out[np.maximum(offsets[1:] - j, offsets[:-1])] = BUCKETS
    return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  #: log-probabilities of the languages
    logs: np.ndarray  #: log-probabilities by language and bucket; zero in the last place, which stands for no n-gram

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The log-posterior (without its constant) of each text and language, from sparse bucket look-ups."""
        points, offsets = characters(texts)
        out = np.tile(self.prior, (len(texts), 1))
        for order in ORDERS:
            buckets = ngrams(points, offsets, order)
            for k in range(len(self.languages)):
                out[:, k] += np.add.reduceat(self.logs[k][buckets], offsets[:-1], dtype=np.float64)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, sure = [], np.zeros(len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), sure
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < CHARS):
                size += len(texts[stop])
                stop += 1
            log = self.scores(texts[at:stop])
            best = log.argmax(axis=1)
            sure[at:stop] = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.languages[b] for b in best]
            at = stop
        for d, text in enumerate(texts):
            if not has_letter(text):
                names[d], sure[d] = UNKNOWN, 0.0
        return names, sure


def train(docs: DataFrame) -> Model:
    """docs(text, lang): every row with a text and a language counts, whole. Counts are summed by language in the
    executors; the driver gets one packed array for each language. Raises ValueError if the languages are too many for
    the matrix to be broadcast (MOST_VALUES)."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}  # by bucket; the last place counts texts
        for block in blocks(batches, CHARS):
            by: dict[str, list[bytes]] = {}
            for text, lang in zip(block["text"], block["lang"]):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                points, offsets = characters(texts)
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for order in ORDERS:
                    own[:BUCKETS] += np.bincount(ngrams(points, offsets, order), minlength=BUCKETS + 1)[:BUCKETS]
                own[BUCKETS] += len(texts)
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([pack(own)], pa.binary())], ["lang", "counts"])

    def summed(batches):
        now, total = None, None
        for batch in batches:
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
                if lang != now and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([pack(total)], pa.binary())], ["lang", "counts"])
                    total = None
                own = unpack(value)[0]
                now, total = lang, own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([pack(total)], pa.binary())], ["lang", "counts"])

    given = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    given = given.select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = brought_together(given.mapInArrow(count, "lang string, counts binary"), "lang")
    most = MOST_VALUES // BUCKETS
    rows = counted.mapInArrow(summed, "lang string, counts binary").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages need a larger matrix than MOST_VALUES allows")
    if not rows:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS + 1), np.float32))
    rows = sorted(rows, key=lambda r: r["lang"])
    table = np.stack([unpack(r["counts"])[0] for r in rows])
    seen, table = table[:, BUCKETS], table[:, :BUCKETS] + ALPHA
    logs = np.zeros((len(rows), BUCKETS + 1), np.float32)
    logs[:, :BUCKETS] = np.log(table / table.sum(axis=1, keepdims=True))
    return Model([r["lang"] for r in rows], np.log(seen / seen.sum()), logs)


def language_column(spark, model: Model, text: Column) -> Column:
    """struct(lang string, score double): the likeliest language and its posterior probability; `und` and 0 if the
    text is null or has no letter. Ties go to the name that sorts first."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<lang: string, score: double>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, sure = shared.value.predict([x or b"" for x in batch.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["lang", "score"])

    return language(text.cast("binary"))

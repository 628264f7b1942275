"""Nearest neighbours by a block matrix join: products of int8 tiles with error bounds, survivors in double precision,
and a heap for each query.

Vectors are put into blocks, which tasks write into a folder of the shared one: int8 codes with what bounds their error,
and the original vectors. A tile (a block of queries, a block of candidates) is two names, so that no vector is shuffled:
its task maps the codes, multiplies them, and touches the original vectors of those rows only that the bounds leave.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brought_together, mapped_file, put_file, settle, shared_folder, shuffle_partitions

#: Vectors of a block of candidates and of queries; queries multiplied at once.
CANDIDATES, QUERIES, STEP = 8192, 4096, 256
#: What is kept of each code: scale, length of the quantised vector, length of what quantising took away, a norm.
BOUNDS = 4


def in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as an SQL engine's list functions add."""
    return np.add.accumulate(x, axis=-1)[..., -1]


def evened(x: np.ndarray) -> np.ndarray:
    """The rows scaled by powers of two, their largest components to 0.5..1: squares neither overflow nor vanish, and
    cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, and by row: their scales, the lengths of the quantised vectors and of what
    quantising took away, and the norms of the rows as they are. x: rows that evened() gave."""
    squares = in_order(x**2)
    unit = x / np.sqrt(squares)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, np.stack([scale, np.sqrt((back**2).sum(axis=1)), np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt(squares)], axis=1)


class Block:
    """A block as its files hold it."""

    def __init__(self, folder: str, name: str, n: int, dim: int):
        self.ids = mapped_file(folder, f"{name}.ids", np.int64)
        self.codes = mapped_file(folder, f"{name}.codes", np.int8).reshape(n, dim)
        self.bounds = mapped_file(folder, f"{name}.bounds", np.float64).reshape(n, BOUNDS)
        self.vectors = mapped_file(folder, f"{name}.vectors", np.float64).reshape(n, dim)

    @staticmethod
    def write(folder: str, name: str, ids: np.ndarray, vectors: np.ndarray) -> None:
        x = evened(vectors)
        codes, bounds = quantise(x)
        for kind, value in (("ids", ids), ("codes", codes), ("bounds", bounds), ("vectors", x)):
            put_file(folder, f"{name}.{kind}", value)


def nearest_in_tile(queries: Block, candidates: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, its k nearest of the candidates (fewer if there are fewer), as ids and cosines. Products of int8
    codes are exact in float32 up to 1,040 dimensions (sums under 2^24); beyond, the slack covers their rounding."""
    ids, (scale, length, off, norm) = np.asarray(candidates.ids), candidates.bounds.T
    codes = candidates.codes.astype(np.float32).T
    slack = 1e-6 * (1 + codes.shape[0] / 1024)
    for at in range(0, len(queries.ids), STEP):
        q_ids, (q_scale, _, q_off, q_norm) = np.asarray(queries.ids[at : at + STEP]), queries.bounds[at : at + STEP].T
        near = (queries.codes[at : at + STEP].astype(np.float32) @ codes).astype(np.float64) * (q_scale[:, None] * scale)
        bound = q_off[:, None] * length + off + slack
        own = q_ids[:, None] == ids
        least = np.where(own, -np.inf, near - bound)
        keep = min(k, len(ids))
        kth = np.partition(least, len(ids) - keep, axis=1)[:, len(ids) - keep]
        survives = (near + bound >= kth[:, None]) & ~own
        for row in range(len(near)):
            some = np.flatnonzero(survives[row])
            cosine = in_order(candidates.vectors[some] * queries.vectors[at + row]) / (norm[some] * q_norm[row])
            best = np.lexsort((ids[some], -cosine))[:k]
            yield int(q_ids[row]), ids[some][best], cosine[best]


def _write(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dim: int, rows: list) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            Block.write(folder, name, np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([name]), pa.array([len(rows)], pa.int32())], ["dim", "name", "n"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
                own = v.values.to_numpy(zero_copy_only=False)
                if not len(own) or not np.isfinite(own).all() or not own.any():
                    continue
                rows = held.setdefault(len(own), [])
                rows.append((i, own))
                if len(rows) == size:
                    yield row(len(own), held.pop(len(own)))
        for dim, rows in held.items():
            yield row(dim, rows)

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of vectors for which `queries` holds: its k nearest other rows by cosine, in double precision: query_id,
    rank (from 1), vec_id, score; ties go to the smaller id. Exact: the int8 products only rule out rows that their
    error bounds rule out.

    Rows whose id or vector is null, or whose vector is empty, zero or has null or non-finite components, take no part.
    Vectors of different lengths aren't compared; very large and very small components are. Of repeated ids among the
    queries one counts (any, if their vectors differ); rows with the query's own id are not its neighbours; repeated
    candidates each count. Other columns are ignored."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    whole = F.col(vector).cast("array<double>")
    there = vectors.where(F.col(id).isNotNull() & whole.isNotNull() & ~F.exists(whole, lambda x: x.isNull()))
    rows = there.select(F.col(id).cast("long").alias("vec_id"), whole.alias("v"))
    asked = there.where(queries).select(F.col(id).cast("long").alias("vec_id"), whole.alias("v")).dropDuplicates(["vec_id"])
    # lists of blocks, written once: a row for each file set, not for each vector
    packed = settle(rows.mapInArrow(_write(folder, CANDIDATES), "dim int, name string, n int"))
    wanted = settle(asked.mapInArrow(_write(folder, QUERIES), "dim int, name string, n int"))

    def placed(df: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
        """Each block in one of about as many slots as its dimension has blocks; the slots by dimension."""
        slots = df.groupBy("dim").agg(F.count("*").alias(f"{prefix}slots"))
        own = df.join(slots, "dim").withColumn("slot", F.pmod(F.xxhash64("name"), F.col(f"{prefix}slots")))
        return own.select("dim", "slot", F.col("name").alias(f"{prefix}name"), F.col("n").alias(f"{prefix}n")), slots

    (c, c_slots), (q, q_slots) = placed(packed, "c_"), placed(wanted, "q_")
    # every block meets every slot of the other side: tiles are dealt by both slots, none by the dimension alone
    c = c.join(q_slots, "dim").select("dim", F.col("slot").alias("c_slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_slots") - 1)).alias("q_slot"), "c_name", "c_n")
    q = q.join(c_slots, "dim").select("dim", F.col("slot").alias("q_slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_slots") - 1)).alias("c_slot"), "q_name", "q_n")
    tiles = c.join(q, ["dim", "c_slot", "q_slot"]).repartition(shuffle_partitions(spark), "q_name", "c_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = Block(folder, r["q_name"], r["q_n"], r["dim"]), Block(folder, r["c_name"], r["c_n"], r["dim"])
                found = list(nearest_in_tile(x, y, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in found]).astype(np.int64)), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"]
                )

    near = tiles.select("dim", "q_name", "q_n", "c_name", "c_n").mapInArrow(run, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []

        def done() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-i for _, i in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, i, s in zip(*(c.to_pylist() for c in batch.columns)):
                if q != now:
                    if heap:
                        yield done()
                    now, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
        if heap:
            yield done()

    return brought_together(near, "query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")

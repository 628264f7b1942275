"""Shared pieces: word codes of a block of texts, settled tables, streamed groups, packed arrays.

Conventions of every operator here: a null text counts as an empty one, a text is always read whole, columns of the
input other than those named are ignored (or carried through untouched), an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents holds (a longer text is a block of its own).
BLOCK_BYTES = 6_000_000
#: Spark's setting that deletes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The polynomial's odd multiplier for hashes of word sequences.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's, else, where all run in one process, one of our own."""
    there = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, for files that tasks write and map; it goes when the application ends."""
    path = f"{shared_dir(spark)}/tessera_{uuid.uuid4().hex}"
    _gone_at_exit(spark, path)
    return path


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"(?!file:)\w+:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def put_file(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays, one after another, as a file of a shared folder. It shows up whole or not at all, and a task that
    runs again puts the same in its place."""
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    fs.move(part, f"{base}/{name}")


def mapped_file(folder: str, name: str, kind) -> np.ndarray:
    """A file of a shared folder as an array: mapped into memory where the folder is mounted, else read."""
    fs, base = _file_system(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        path = os.path.join(base, name)
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def settle(df: DataFrame, payload: bool = False, by: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there, so that a lost executor costs
    no recomputation of what lies before. The files go when the application ends. payload: rows are large. by: the
    files are bucketed by a column, so that meeting another table on it moves only that table."""
    spark = df.sparkSession
    name = f"tessera_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    out = df.write.option("compression", "none" if payload else "zstd")
    if payload:  # few rows to a row group, since a reader holds whole batches of rows
        out = out.option("parquet.block.size", 8 << 20).option("parquet.block.size.row.check.min", 1)
    _gone_at_exit(spark, path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what the writing shuffled is needed no more when it has been written
    try:
        if by is None:
            out.parquet(path)
        else:
            out.format("parquet").bucketBy(shuffle_partitions(spark), by).option("path", path).saveAsTable(name)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path) if by is None else spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more, and lets Spark drop shuffles no longer in use."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    if tables:
        jvm.System.gc()  # what is out of reach on the driver is what its cleaner deletes


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards_for(docs: DataFrame, size: int) -> int:
    """Shards of about `size` bytes of text each, and at least two for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * shuffle_partitions(docs.sparkSession), -(-total // size))


def brought_together(df: DataFrame, key: str, *then: str, keys: int = 0) -> DataFrame:
    """Rows of a key in one partition, in order of the key and of what follows it. keys: how many large keys there are;
    a partition has about two of them at most."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), keys // 2), key).sortWithinPartitions(key, *then)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """(key, rows) for each run of equal keys in batches ordered by that key."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def as_bytes(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as UTF-8 bytes (null: empty) and other columns, fit for mapInArrow."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *more)


def blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[dict[str, list]]:
    """Columns (as lists) of consecutive rows that hold `size` bytes of text or, for the last of them, just pass it."""
    held: dict[str, list] = {}
    n = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            sums = np.cumsum(sizes[at:])
            stop = min(batch.num_rows, at + int(np.searchsorted(sums, size - n)) + 1)
            for name, column in zip(batch.schema.names, batch.slice(at, stop - at).columns):
                held.setdefault(name, []).extend(column.to_pylist())
            n += int(sums[stop - at - 1])
            at = stop
            if n >= size:
                yield held
                held, n = {}, 0
    if held:
        yield held


def word_codes(texts: list[bytes], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text as codes of a vocabulary; offsets of the texts; the vocabulary.
    (bytes.split() parts at exactly those six characters.) end: a token put after the words of each text."""
    words: list[bytes] = []
    counts = []
    for text in texts:
        own = text.split()
        if end is not None:
            own.append(end)
        counts.append(len(own))
        words += own
    vocabulary = list(dict.fromkeys(words))
    place = dict(zip(vocabulary, range(len(vocabulary))))
    codes = np.fromiter(map(place.__getitem__, words), np.int32, len(words))
    return codes, np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))]).astype(np.int64), vocabulary


def word_hashes(vocabulary: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of k consecutive word hashes, at each place where k words follow."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, k):
        out *= MULTIPLIER
        out += h[j : j + n]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shard_of(x: np.ndarray, n: int) -> np.ndarray:
    """A shard in 0..n-1 for each 64-bit value."""
    return ((mixed(x) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def questions(x: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Ascending 64-bit values, cut by shards of their high bits: 48 bits of each, packed."""
    edges = np.searchsorted(((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), pack(np.diff(x[edges[s] : edges[s + 1]] >> np.uint64(16), prepend=np.uint64(0)))


def seen_again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard: which of the values that a block asks for (its `questions`, each value once) come from another
    block too, as bits, and these values."""
    for shard, rows in groups(batches, "shard"):
        own = [np.cumsum(unpack(row["payload"])[0]) for row in rows]
        every = np.sort(np.concatenate(own))
        repeated = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for row, x in zip(rows, own):
            at = np.minimum(np.searchsorted(repeated, x), max(len(repeated) - 1, 0))
            again = repeated[at] == x if len(repeated) else np.zeros(len(x), bool)
            out.append((row["block"], shard, pack(np.packbits(again), np.array([len(x)]), x[again])))
        for a in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[a : a + 256]), (pa.int64(), pa.int32(), pa.binary()))], ["block", "shard", "payload"])


def crc_of_id(doc_id: int | None) -> int:
    """crc32 of the id as text, as Spark's crc32(cast(doc_id as string)); null: 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode())


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists offsets[r]..offsets[r + 1] of values, for each r of rows: all values, and the new offsets."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(offsets[rows] - out[:-1], lengths) + np.arange(out[-1])], out


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; the bytes of a wide element are stored plane by plane, which packs better."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        name = a.dtype.str.encode()
        raw = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.size and a.dtype.itemsize > 1 else a.tobytes()
        parts += [struct.pack("<BQ", len(name), a.size), name, raw]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    out, at = [], 1
    for _ in range(raw[0]):
        k, n = struct.unpack_from("<BQ", raw, at)
        at += 9
        kind = np.dtype(raw[at : at + k].decode())
        at += k
        own = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        out.append(np.ascontiguousarray(own.reshape(kind.itemsize, -1).T).reshape(-1).view(kind) if n and kind.itemsize > 1 else own.view(kind))
    return out

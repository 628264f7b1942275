"""Streams of plain numbers, frames, number texts and random matrices.

    spark.read.format("rawnumbers").option("kind", "u2").load(path)      # (file, pos, value)
    df.select("value").write.format("rawnumbers").option("kind", "u1").mode("append").save(folder)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.functions import arrow_udf

from .paths import Parts, abort, commit, listed, located

KINDS = {"u1": "u1", "u2": "<u2", "i4": "<i4", "f4": "<f4", "f8": "<f8"}
#: Numbers of an Arrow batch.
BATCH = 1 << 16


class NumberReader(DataSourceReader):
    """Files are cut into ranges of at most `split` bytes. An odd byte at a file's end is no number."""

    def __init__(self, path: str, kind: str, split: int, names: list[str]):
        self.path, self.kind, self.names = path, KINDS[kind], names
        size = np.dtype(self.kind).itemsize
        self.step = max(split // size, 1)

    def partitions(self):
        size = np.dtype(self.kind).itemsize
        return [InputPartition((file, at, min(self.step, n // size - at))) for file, n in listed(self.path) for at in range(0, n // size, self.step)]

    def read(self, partition):
        file, at, n = partition.value
        kind, types = np.dtype(self.kind), {"file": pa.string(), "pos": pa.int64(), "value": pa.float64()}
        fs, base = located(file)
        with fs.open_input_file(base) as f:
            f.seek(at * kind.itemsize)
            for start in range(at, at + n, BATCH):
                x = np.frombuffer(f.read(min(BATCH, at + n - start) * kind.itemsize), kind)
                columns = {"file": lambda: [file] * len(x), "pos": lambda: np.arange(start, start + len(x)), "value": lambda: x.astype(float)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c](), types[c]) for c in self.names], self.names)


class NumberWriter(DataSourceArrowWriter):
    """A file for each partition, in the order of its rows; with a column `file`, one for each of its names, whose rows must
    lie side by side in one partition. Integers keep their low bits; a null is an error."""

    def __init__(self, folder: str, kind: str, overwrite: bool):
        self.folder, self.kind, self.overwrite = folder, KINDS[kind], overwrite

    def pack(self, values: pa.Array) -> bytes:
        if values.null_count:
            raise ValueError("a null is no number of a raw file")
        x = values.to_numpy(zero_copy_only=False)
        return (x if self.kind[1] == "f" else x.astype(np.int64)).astype(self.kind).tobytes()

    def write(self, iterator):
        from pyspark import TaskContext

        parts, out, name = Parts(self.folder), None, None
        for batch in iterator:
            values = batch.column("value")
            if "file" in batch.schema.names:
                runs = pc.run_end_encode(batch.column("file"))
                names, ends = runs.values.to_pylist(), runs.run_ends.to_pylist()
            else:
                names, ends = [f"part-{TaskContext.get().partitionId():05d}"], [len(values)]
            start = 0
            for now, end in zip(names, ends):
                if now != name:
                    if out:
                        out.close()
                    out, name = parts.open(now), now
                out.write(self.pack(values[start:end]))
                start = end
        if out:
            out.close()
        message = WriterCommitMessage()
        message.parts = parts.names
        return message

    def commit(self, messages):
        commit(self.folder, [m.parts for m in messages if m], self.overwrite)

    def abort(self, messages):
        abort(self.folder, [m.parts for m in messages if m])


class RawNumbers(DataSource):
    """Options: path; kind (u1, u2, i4, f4, f8: little-endian); split (bytes of a partition when reading)."""

    @classmethod
    def name(cls):
        return "rawnumbers"

    def schema(self):
        return "file string, pos long, value double"

    def reader(self, schema):
        return NumberReader(self.options["path"], self.options.get("kind", "u1"), int(self.options.get("split", 1 << 26)), schema.names)

    def writer(self, schema, overwrite):
        return NumberWriter(self.options["path"], self.options.get("kind", "u1"), overwrite)


def unpacked(content: Column, kind: str, n: int, shift: int = 0) -> Column:
    """The first n numbers of a binary column, each shifted right; what is missing is zero."""

    @arrow_udf(ST.ArrayType(ST.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                x, size = np.zeros(n, KINDS[kind]), np.dtype(KINDS[kind]).itemsize
                got = np.frombuffer(value.as_buffer() or b"", KINDS[kind], min(n, len(value.as_buffer() or b"") // size))
                x[: len(got)] = got
                out.append((x >> shift if shift else x).astype(float))
            yield pa.array(out, pa.list_(pa.float64()))

    return run(content)


def frames(spark: SparkSession, path: str, width: int, height: int, kind: str = "u2", shift: int = 4, most: int = 4095) -> DataFrame:
    """Files of a number for each pixel as one-layer cubelets, in the order of their paths (z_off). Short files are filled up
    with zeros. Bytes (kind u1) give UINT8 cubelets, others INT32. Only the paths, which the driver has listed, are ordered;
    the frames stay where they are read."""
    files = spark.read.format("binaryFile").load(path)
    order = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("int").alias("z_off"))
    rows = files.select("path", unpacked(F.col("content"), kind, width * height, shift).alias("payload")).join(order, "path")
    zero, one = F.lit(0), F.lit(1)
    return rows.select(
        F.col("path").alias("file"), F.col("z_off").cast("long").alias("cube_id"), zero.alias("x_off"), zero.alias("y_off"), "z_off",
        F.lit(width).alias("width"), F.lit(height).alias("height"), one.alias("depth"),
        F.lit("UINT8" if kind == "u1" else "INT32").alias("data_type"), F.lit(most).alias("max_value"), "payload",
    )


def byte_cubelet(spark: SparkSession, path: str, width: int, height: int, depth: int) -> DataFrame:
    """A file of bytes as one cubelet; a short file is filled up with zeros."""
    rows = frames(spark, path, width, height * depth, "u1", 0, 255)
    return rows.withColumn("height", F.lit(height)).withColumn("depth", F.lit(depth)).withColumn("z_off", F.lit(0))


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of texts, apart by white space; a word that isn't a number gives null."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where("w != ''")
    return words.select(F.expr("try_cast(w as double)").alias("value"))


def write_lines(df: DataFrame, line: Column, order: list[str], path: str) -> None:
    """A text line for each row, in order: files follow each other by name."""
    df.orderBy(*order).select(line.cast("string").alias("value")).write.text(path)


def random_matrix(spark: SparkSession, width: int, height: int, seed: int) -> DataFrame:
    """(row, col, value): uniform in [0, 1), five decimals."""
    cell = spark.range(width * height)
    return cell.select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"), (F.floor(F.rand(seed) * 100000) / 100000).alias("value"))


def with_random(df: DataFrame, seed: int, name: str = "random") -> DataFrame:
    return df.withColumn(name, F.rand(seed))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawNumbers)

"""File formats as Python data sources: cubelet streams and `.data` matrices.

    register(spark)
    spark.read.format("cubelets").load(path)          # a row for each cubelet
    df.write.format("cubelets").mode("append").save(folder)
    spark.read.format("datamatrix").load(path)        # (file, row, col, value), text or binary

Cubelet file: a 64-byte header whose first line names the format, then for each cubelet a length, a metadata message and
its bytes; 0xFFFFFFFF ends the list, and an index of all metadata may follow (the message, its length, "cube"). Each file
is one partition. Without payloads (the option metadata, or a schema without columns of them) only the index is read,
or, where there is none, the list is scanned and payloads are skipped.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .paths import Parts, abort, commit, listed, located

HEADER = 64
#: What ends the list of cubelets, and what ends a file that has an index.
END, INDEXED = b"\xff" * 4, b"cube"
#: Fields of the index: overall sizes, cubelets; and of a cubelet in it, the place of its bytes.
OVERALL, ENTRIES, OFFSET = ("width", "height", "depth"), 5, 13
TITLE = re.compile(rb"\A[ -~]* ?cubelets 1\.0\n")
#: Fields of the metadata message by number.
FIELDS = {1: "width", 2: "height", 3: "depth", 4: "x_off", 5: "y_off", 6: "z_off", 7: "data_type", 8: "byte_count", 9: "compression", 14: "params", 15: "max_value"}
TYPES, COMPRESSIONS = {1: "UINT8", 2: "INT32", 3: "FLOAT32"}, {0: "NONE", 1: "ZLIB", 2: "WAVELET"}
KINDS = {"UINT8": "u1", "INT32": "<i4", "FLOAT32": "<f4"}
SCHEMA = "file string, cube_id long, x_off int, y_off int, z_off int, width int, height int, depth int, data_type string, max_value int, compression string, byte_count long, file_offset long, params binary, payload array<double>, raw binary"


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return out, at


def put_varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(data: bytes) -> dict[int, object]:
    """Fields of a message: numbers, or bytes."""
    out: dict[int, object] = {}
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            out[key >> 3], at = varint(data, at)
        elif key & 7 == 2:
            n, at = varint(data, at)
            out[key >> 3], at = data[at : at + n], at + n
        elif key & 7 in (1, 5):
            n = 8 if key & 7 == 1 else 4
            out[key >> 3], at = data[at : at + n], at + n
        else:
            raise ValueError("not a message")
    return out


def entries(data: bytes, number: int) -> list[bytes]:
    """The messages in a repeated field of a message."""
    out, at = [], 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            _, at = varint(data, at)
        elif key & 7 == 2:
            n, at = varint(data, at)
            if key >> 3 == number:
                out.append(data[at : at + n])
            at += n
        else:
            at += 8 if key & 7 == 1 else 4
    return out


def opened(path: str):
    fs, base = located(path)
    return fs.open_input_file(base)


def is_cubelets(path: str) -> bool:
    with opened(path) as f:
        return bool(TITLE.match(f.read(HEADER)))


def described(data: bytes, path: str, number: int, at: int) -> dict:
    """A row of metadata from a message; at: the place of the bytes."""
    got = message(data)
    row = {name: got.get(k, 0) for k, name in FIELDS.items()}
    row |= {"data_type": TYPES[row["data_type"]], "compression": COMPRESSIONS[row["compression"]], "params": row["params"] or None, "file": path, "cube_id": number}
    return row | {"file_offset": got.get(OFFSET) or at, "payload": None, "raw": None}


def read_index(path: str) -> list[dict] | None:
    """Metadata from the index at a file's end, with the places of the bytes; None if the file has none."""
    with opened(path) as f:
        size = f.size()
        if size < HEADER + 12:
            return None
        f.seek(size - 8)
        length, tag = struct.unpack("<i4s", f.read(8))
        if tag != INDEXED or not 0 <= length <= size - HEADER - 12:
            return None
        f.seek(size - 12 - length)
        marker, data = f.read(4), f.read(length)
        if marker != END:
            return None
    return [described(x, path, k, 0) for k, x in enumerate(entries(data, ENTRIES))]


def values_of(row: dict, raw: bytes) -> dict:
    if row["compression"] == "NONE":
        return row | {"payload": np.frombuffer(raw, KINDS[row["data_type"]]).astype(float).tolist()}
    return row | {"raw": raw}


def read_cubelets(path: str, payload: bool = True) -> Iterator[dict]:
    """The cubelets of a file, in order; without payloads the index, if there is one, else a scan that skips the bytes."""
    with opened(path) as f:
        if not TITLE.match(f.read(HEADER)):
            raise ValueError(f"not a cubelet file: {path}")
        if not payload and (index := read_index(path)) is not None:
            yield from index
            return
        number = 0
        while len(size := f.read(4)) == 4 and size != END:
            data = f.read(struct.unpack("<I", size)[0])
            row = described(data, path, number, f.tell())
            if payload:
                yield values_of(row, f.read(row["byte_count"]))
            else:
                f.seek(row["byte_count"] + f.tell())
                yield row
            number += 1


def payload_at(row: dict) -> dict:
    """A row of metadata with its values, read at their place."""
    with opened(row["file"]) as f:
        f.seek(row["file_offset"])
        return values_of(row, f.read(row["byte_count"]))


def message_bytes(row: dict, further: dict[int, int] | None = None) -> bytes:
    types, compressions = {v: k for k, v in TYPES.items()}, {v: k for k, v in COMPRESSIONS.items()}
    values = row | {"data_type": types[row.get("data_type") or "FLOAT32"], "compression": compressions[row.get("compression") or "NONE"]}
    out = b""
    for k, name in FIELDS.items():
        value = values.get(name)
        if name == "params":
            out += put_varint(k << 3 | 2) + put_varint(len(value)) + value if value else b""
        elif value is not None:
            out += put_varint(k << 3) + put_varint(int(value))
    return out + b"".join(put_varint(k << 3) + put_varint(v) for k, v in (further or {}).items())


def raw_bytes(row: dict) -> bytes:
    kind = row.get("data_type") or "FLOAT32"
    if row.get("raw") is not None:
        return row["raw"]
    values = np.array(row["payload"], dtype=np.float64)
    return (np.clip(values, 0, 255) if kind == "UINT8" else values).astype(KINDS[kind]).tobytes()


def put_cubelets(f, rows: Iterable[dict], at: int, index: bool, before: Iterable[dict] = ()) -> None:
    """Cubelets from place `at` on, and the file's end. before: metadata of cubelets that the file holds already."""
    known = [message_bytes(r, {OFFSET: r["file_offset"]}) for r in before]
    most = [max((r[o] + r[s] for r in before), default=0) for o, s in zip(("x_off", "y_off", "z_off"), OVERALL)]
    for row in rows:
        raw = raw_bytes(row)
        row = row | {"byte_count": len(raw)}
        data = message_bytes(row)
        f.write(struct.pack("<I", len(data)) + data + raw)
        if index:
            known.append(message_bytes(row, {OFFSET: at + 4 + len(data)}))
            most = [max(m, (row.get(o) or 0) + row[s]) for m, o, s in zip(most, ("x_off", "y_off", "z_off"), OVERALL)]
        at += 4 + len(data) + len(raw)
    if index:
        data = b"".join(put_varint(k << 3) + put_varint(m) for k, m in enumerate(most, 1))
        data += b"".join(put_varint(ENTRIES << 3 | 2) + put_varint(len(x)) + x for x in known)
        f.write(END + data + struct.pack("<i", len(data)) + INDEXED)


def append_cubelets(path: str, rows: Iterable[dict], index: bool = True) -> None:
    """Cubelets put after the last one of a local or mounted file, whose index is written anew. For few rows on the driver:
    a table is appended as files of its own."""
    before = list(read_cubelets(path, payload=False))
    at = max((r["file_offset"] + r["byte_count"] for r in before), default=HEADER)
    with open(located(path)[1], "r+b") as f:
        f.truncate(at)
        f.seek(at)
        put_cubelets(f, rows, at, index, before)


class CubeletWriter(DataSourceWriter):
    def __init__(self, schema, folder: str, title: str, overwrite: bool, index: bool):
        self.names, self.folder, self.title, self.overwrite, self.index = schema.names, folder, title, overwrite, index

    def write(self, rows) -> WriterCommitMessage:
        parts = Parts(self.folder)
        with parts.open(f"{uuid.uuid4().hex}.cube") as f:
            f.write(f"{self.title}\n".encode().ljust(HEADER, b"\0"))
            put_cubelets(f, (dict(zip(self.names, row)) for row in rows), HEADER, self.index)
        out = WriterCommitMessage()
        out.parts = parts.names
        return out

    def commit(self, messages) -> None:
        commit(self.folder, [m.parts for m in messages if m], self.overwrite, "*.cube")

    def abort(self, messages) -> None:
        abort(self.folder, [m.parts for m in messages if m])


class FileReader(DataSourceReader):
    def __init__(self, path: str, read):
        self.path, self.read_file = path, read

    def partitions(self):
        return [InputPartition(path) for path, _ in listed(self.path)]

    def read(self, partition):
        yield from self.read_file(partition.value)


class Cubelets(DataSource):
    """Options: path; metadata ("true": skip payloads); when writing, title (the header's first line) and index ("false":
    none)."""

    @classmethod
    def name(cls):
        return "cubelets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        names = schema.names
        payload = self.options.get("metadata", "false") != "true" and not {"payload", "raw"}.isdisjoint(names)
        return FileReader(self.options["path"], lambda path: (tuple(row[n] for n in names) for row in read_cubelets(path, payload)))

    def writer(self, schema, overwrite):
        return CubeletWriter(schema, self.options["path"], self.options.get("title", "cubelets 1.0"), overwrite, self.options.get("index", "true") != "false")


def read_matrix(path: str) -> np.ndarray:
    """`binary \\n`, columns, rows (int32) and float32s; or text: columns, "cols", rows, "rows" and the numbers."""
    with opened(path) as f:
        head = f.read(8)
        if head == b"binary \n":
            cols, rows = struct.unpack("<2i", f.read(8))
            return np.frombuffer(f.read(4 * cols * rows), "<f4").reshape(rows, cols).astype(float)
        words = (head + f.read()).split()
    numbers = [w for w in words if not w.isalpha()]
    cols, rows = int(numbers[0]), int(numbers[1])
    return np.array(numbers[2 : 2 + cols * rows], dtype=float).reshape(rows, cols)


def write_matrix(path: str, values: np.ndarray, binary: bool = True) -> None:
    rows, cols = values.shape
    with open(path, "wb") as f:
        if binary:
            f.write(b"binary \n" + struct.pack("<2i", cols, rows) + values.astype("<f4").tobytes())
        else:
            f.write(f"{cols} cols {rows} rows\n".encode())
            f.writelines((" ".join(f"{v:7.5f}" for v in line) + "\n").encode() for line in values)


class DataMatrix(DataSource):
    @classmethod
    def name(cls):
        return "datamatrix"

    def schema(self):
        return "file string, row int, col int, value double"

    def reader(self, schema):
        def rows(path):
            for r, line in enumerate(read_matrix(path).tolist()):
                yield from ((path, r, c, v) for c, v in enumerate(line))

        return FileReader(self.options["path"], rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Cubelets)
    spark.dataSource.register(DataMatrix)

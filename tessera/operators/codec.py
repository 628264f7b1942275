"""Cubelets to compressed cubelets and back: pad, transform, threshold, quantise, encode; everything that decoding needs
goes with the cubelet. A cubelet is one row's work: nothing is shuffled, and cubelets of any shapes stand in one table."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, hof
from ..sources.files import COMPRESSIONS, KINDS, TYPES, message, put_varint, varint
from . import entropy, search

#: Fields of the parameters message by number, and its enumerations.
FIELDS = {
    "steps_x": 1, "steps_y": 2, "steps_z": 3, "wavelet": 4, "fraction": 6, "threshold": 7, "bins": 8, "quantizer": 9, "most": 10, "bounds": 11, "values": 12,
    "table": 13, "width": 14, "height": 15, "depth": 16, "data_type": 17, "layers": 18, "run_key": 19, "run_value": 20,
}
FLOATS, LISTS, WAVELETS, QUANTIZERS = ("fraction", "threshold", "most"), ("bounds", "values", "table"), {"haar": 1, "cdf97": 2}, {"log": 1, "uniform": 2, "lloyd": 3}


@dataclass(frozen=True)
class Settings:
    """steps: of each axis (-1: all, 0: none). layers: two-dimensional transforms of each layer. fraction: of the values
    that become zero."""

    steps: tuple[int, int, int] = (-1, -1, -1)
    wavelet: str = "cdf97"
    layers: bool = False
    fraction: float = 0.5
    bins: int = 256
    quantizer: str = "log"


def pack_parameters(p: dict) -> bytes:
    out = b""
    for name, k in FIELDS.items():
        x = p.get(name)
        if x is None:
            continue
        if name in FLOATS:
            out += put_varint(k << 3 | 5) + struct.pack("<f", x)
        elif name in LISTS:
            body = b"".join(map(put_varint, x)) if name == "table" else struct.pack(f"<{len(x)}f", *x)
            out += put_varint(k << 3 | 2) + put_varint(len(body)) + body
        else:
            out += put_varint(k << 3) + put_varint(int(x))
    return out


def unpack_parameters(data: bytes) -> dict:
    got, out = message(data), {}
    for name, k in FIELDS.items():
        if k not in got:
            continue
        x = got[k]
        if name in FLOATS:
            x = struct.unpack("<f", x)[0]
        elif name == "table":
            values, at = [], 0
            while at < len(x):
                v, at = varint(x, at)
                values.append(v)
            x = values
        elif name in LISTS:
            x = list(struct.unpack(f"<{len(x) // 4}f", x))
        elif x >= 1 << 63:
            x -= 1 << 64
        out[name] = x
    return out


def padded(x: np.ndarray, steps: tuple[int, int, int]) -> np.ndarray:
    """x: (z, y, x). Each axis made a multiple of two to its steps by repeating its last values."""
    sizes = [hof.padded_length(n, hof.steps_of(n, k), power=k < 0) if k else n for n, k in zip(x.shape[::-1], steps)][::-1]
    return np.pad(x, [(0, m - n) for m, n in zip(sizes, x.shape)], mode="edge")


def lloyd_book(x: np.ndarray, t: float, bins: int, rounds: int = 50) -> tuple[list[float], list[float]]:
    """(boundaries, values): codewords fitted to the sizes over the threshold, mirrored about a zero bin."""
    sizes = np.sort(np.abs(x[np.abs(x) > t]))
    book = np.exp(np.linspace(np.log(max(t, sizes[0] if len(sizes) else 1.0)), np.log(sizes[-1]) if len(sizes) else 0.0, max((bins - 1) // 2, 1), endpoint=False))
    for _ in range(rounds):
        edges = np.searchsorted(sizes, (book[1:] + book[:-1]) / 2, side="right")
        parts = np.split(sizes, edges)
        new = np.array([p.mean() if len(p) else b for p, b in zip(parts, book)])
        if np.allclose(new, book, rtol=1e-6):
            break
        book = new
    middle = ((book[1:] + book[:-1]) / 2).tolist()
    return [-m for m in reversed(middle)] + [-t, t] + middle, [-b for b in reversed(book.tolist())] + [0.0] + book.tolist()


def quantised_cube(values: np.ndarray, data_type: str, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, dict]:
    """values: (z, y, x). Coefficients (z, y, x, padded), bins of them in this shape and as the stream holds them, the zero bin,
    the parameters."""
    if s.wavelet not in WAVELETS:
        raise ValueError(f"no compression with {s.wavelet}")
    steps = tuple(hof.steps_of(n, k) for n, k in zip(values.shape[::-1], (*s.steps[:2], 0) if s.layers else s.steps))
    c = blocks.cube(padded(values, tuple(k if n > 1 else 0 for n, k in zip(values.shape[::-1], (*s.steps[:2], 0) if s.layers else s.steps))), steps, s.wavelet)
    turned = not s.layers and c.shape[0] > 1  # z fastest, as the original scans it
    flat = c.transpose(2, 1, 0).reshape(-1) if turned else c.reshape(-1)
    sizes = np.sort(np.abs(flat))
    t = float(np.float32(sizes[min(max(int(s.fraction * len(sizes)), 0), len(sizes) - 1)])) or 1e-16
    most = float(np.float32(sizes[-1]))
    p = {"steps_x": steps[0], "steps_y": steps[1], "steps_z": steps[2], "wavelet": WAVELETS[s.wavelet], "fraction": s.fraction, "threshold": t, "bins": s.bins, "quantizer": QUANTIZERS[s.quantizer], "most": most}
    p |= {"width": values.shape[2], "height": values.shape[1], "depth": values.shape[0], "data_type": {v: k for k, v in TYPES.items()}[data_type], "layers": int(s.layers)}
    if s.quantizer == "lloyd":
        bounds, book = lloyd_book(flat, t, s.bins)
        p |= {"bounds": bounds, "values": book, "bins": len(book)}
        q, zero = np.searchsorted(np.array(bounds), flat, side="left"), len(book) // 2
    else:
        q, zero = search.numbered(flat, s.bins, t, most, s.quantizer), (s.bins - 1) // 2
    return c, q.reshape(c.shape[::-1]).transpose(2, 1, 0) if turned else q.reshape(c.shape), q, zero, p


def compress_cube(values: np.ndarray, data_type: str, s: Settings) -> tuple[bytes, dict]:
    """values: (z, y, x). The encoded words, and the parameters."""
    _, _, q, zero, p = quantised_cube(values, data_type, s)
    key = p["bins"]
    # how often the stream holds each symbol, once the zero bin's runs are escapes
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    lengths = np.diff(np.append(first, len(q)))
    counts = Counter({int(v): int(n) for v, n in zip(*np.unique(q, return_counts=True)) if v != zero})
    for n in lengths[q[first] == zero].tolist():
        singles, exps = entropy.escapes(n)
        counts[zero] += singles
        counts[key] += len(exps)
    book = entropy.codes(entropy.lengths({k: n for k, n in counts.items() if n}))
    p |= {"table": entropy.decode_table(book), "run_key": key, "run_value": zero}
    return entropy.encode_symbols(q, book, zero, key), p


def restore_cube(raw: bytes, p: dict) -> np.ndarray:
    """Values (z, y, x) in the original size."""
    w, h, d, steps = p["width"], p["height"], p["depth"], (p["steps_x"], p["steps_y"], p["steps_z"])
    shape = [hof.padded_length(n, k) for n, k in ((d, steps[2]), (h, steps[1]), (w, steps[0]))]
    q = np.array(entropy.decode_symbols(raw, int(np.prod(shape)), p["table"], p["run_value"], p["run_key"]), dtype=np.int64)
    name = {v: k for k, v in QUANTIZERS.items()}[p.get("quantizer", 1)]
    values = np.array(p["values"]) if name == "lloyd" else search.middles(p["bins"], p["threshold"], p["most"], name)
    c = values[q]
    c = c.reshape(shape[::-1]).transpose(2, 1, 0) if not p.get("layers") and shape[0] > 1 else c.reshape(shape)
    return blocks.cube(c, steps, {v: k for k, v in WAVELETS.items()}[p["wavelet"]], back=True)[:d, :h, :w]


META = ("cube_id", "x_off", "y_off", "z_off", "width", "height", "depth", "data_type", "max_value")
SCHEMA = "cube_id long, x_off int, y_off int, z_off int, width int, height int, depth int, data_type string, max_value int, compression string, byte_count long"


def _rows(cubelets: DataFrame, f, schema: str) -> DataFrame:
    """f(row) -> (further columns) on each row, batch by batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = [f(r) for r in batch.slice(start, 256).to_pylist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, _types(schema))], names)

    return cubelets.mapInArrow(run, schema)


def _types(schema: str) -> list[pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return [known[x.split()[1]] for x in schema.split(", ")]


def compressed(cubelets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cubelets (the columns of META and payload) with their parameters (a message) and encoded words (raw) instead of the
    payload. Rows that are compressed already (a column compression says so) or have no payload are left out."""
    rows = cubelets.where(F.col("payload").isNotNull())
    if "compression" in cubelets.columns:
        rows = rows.where(F.col("compression") == "NONE")

    def one(r: dict) -> dict:
        raw, p = compress_cube(np.array(r["payload"], dtype=np.float64).reshape(r["depth"], r["height"], r["width"]), r["data_type"], settings)
        return r | {"compression": COMPRESSIONS[2], "byte_count": len(raw), "params": pack_parameters(p), "raw": raw}

    return _rows(rows.select(*META, "payload"), one, f"{SCHEMA}, params binary, raw binary")


def dumped(cubelets: DataFrame, settings: Settings = Settings(), bins: bool = False) -> DataFrame:
    """What compression would quantise (coefficients: FLOAT32 cubelets) or encode (bins: INT32), padded, axes as in the
    original. Rows without a payload are left out."""
    kind = "INT32" if bins else "FLOAT32"

    def one(r: dict) -> dict:
        c, q, *_ = quantised_cube(np.array(r["payload"], dtype=np.float64).reshape(r["depth"], r["height"], r["width"]), r["data_type"], settings)
        x = q if bins else c
        sizes = dict(zip(("depth", "height", "width"), x.shape))
        return r | sizes | {"data_type": kind, "compression": COMPRESSIONS[0], "byte_count": x.size * 4, "payload": x.reshape(-1).astype(float).tolist()}

    return _rows(cubelets.where(F.col("payload").isNotNull()).select(*META, "payload"), one, f"{SCHEMA}, payload array<double>")


def restored(cubelets: DataFrame) -> DataFrame:
    """Compressed cubelets as cubelets with payloads in their own type (bytes cut off at 0..255, integers rounded by
    adding a half); others are left out. The largest possible value is kept."""

    def one(r: dict) -> dict:
        p = unpack_parameters(r["params"])
        x = restore_cube(r["raw"], p).reshape(-1)
        kind = TYPES[p.get("data_type", 3)]
        x = np.trunc(np.clip(x, 0, 255)) if kind == "UINT8" else np.trunc(x + 0.5) if kind == "INT32" else x
        return r | {"compression": COMPRESSIONS[0], "data_type": kind, "byte_count": len(x) * np.dtype(KINDS[kind]).itemsize, "payload": x.tolist()}

    return _rows(cubelets.where("compression = 'WAVELET'").select(*META, "params", "raw"), one, f"{SCHEMA}, payload array<double>")

"""Transforms of array payloads on blocks of rows: each Arrow batch is one numpy array (rows by places), steps are slices
and weighted sums of it. The column kernels of `hof` compute the same row by row and are what tests hold these against.

A null payload stays null, a null element counts as NaN; payloads of different lengths are worked on by length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from . import hof

Bank = tuple[dict[int, float], dict[int, float], dict[int, float], dict[int, float]]
_R3 = 3.0**0.5
#: Daubechies' four taps.
D4 = tuple((1 + s * _R3) / (4 * 2.0**0.5) if e == 0 else (3 + s * _R3) / (4 * 2.0**0.5) for s, e in ((1, 0), (1, 1), (-1, 1), (-1, 0)))


def bank(wavelet: str | Bank) -> Bank:
    """Taps by distance: low and high of analysis, even and odd of synthesis; of a name, or as the caller gives them."""
    if not isinstance(wavelet, str):
        return wavelet
    if wavelet == "cdf97":
        return tuple(map(hof.symmetric, (hof.LOW_ANALYSIS, hof.HIGH_ANALYSIS, hof.LOW_SYNTHESIS, hof.HIGH_SYNTHESIS)))
    if wavelet not in hof.PAIRS:
        raise ValueError(f"no such wavelet: {wavelet}")
    return hof.pair_taps(wavelet)


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(i)
    k = np.mod(i, 2 * (n - 1))
    return np.minimum(k, 2 * (n - 1) - k)


def _sum(x: np.ndarray, places: np.ndarray, taps: dict[int, float]) -> np.ndarray:
    out = 0.0
    for k, c in taps.items():
        if c:
            out = out + c * x[..., mirrored(places + k, x.shape[-1])]
    return out + np.zeros(x.shape[:-1] + (len(places),))


def step(x: np.ndarray, wavelet: str | Bank) -> np.ndarray:
    """One step along the last axis, whose length is even: lows, then highs."""
    n = x.shape[-1]
    if n % 2:
        raise ValueError(f"a length of {n} can't be halved: pad first")
    if wavelet == "haar":
        even, odd = x[..., ::2], x[..., 1::2]
        return np.concatenate([(even + odd) * hof.ROOT, (even - odd) * hof.ROOT], axis=-1)
    if wavelet == "d4":  # ends wrap around
        places = np.arange(0, n, 2)
        around = [x[..., (places + k) % n] for k in range(4)]
        return np.concatenate([sum(c * a for c, a in zip(D4, around)), sum(s * c * a for s, c, a in zip((1, -1, 1, -1), D4[::-1], around))], axis=-1)
    low, high, _, _ = bank(wavelet)
    return np.concatenate([_sum(x, np.arange(0, n, 2), low), _sum(x, np.arange(1, n, 2), high)], axis=-1)


def unstep(x: np.ndarray, wavelet: str | Bank) -> np.ndarray:
    n = x.shape[-1]
    low, high = x[..., : n // 2], x[..., n // 2 :]
    out = np.empty_like(x)
    if wavelet == "haar":
        out[..., ::2], out[..., 1::2] = (low + high) * hof.ROOT, (low - high) * hof.ROOT
        return out
    if wavelet == "d4":
        a, b, c, d = D4
        before_low, before_high = np.roll(low, 1, axis=-1), np.roll(high, 1, axis=-1)
        out[..., ::2] = a * low + d * high + c * before_low + b * before_high
        out[..., 1::2] = b * low - c * high + d * before_low - a * before_high
        return out
    _, _, even, odd = bank(wavelet)
    both = np.empty_like(x)
    both[..., ::2], both[..., 1::2] = low, high
    out[..., ::2], out[..., 1::2] = _sum(both, np.arange(0, n, 2), even), _sum(both, np.arange(1, n, 2), odd)
    return out


def along(x: np.ndarray, steps: int, wavelet: str | Bank, back: bool = False) -> np.ndarray:
    """All steps along the last axis, each on the low half of the one before."""
    n, out = x.shape[-1], np.array(x, dtype=np.float64)
    sizes = [n >> k for k in range(hof.steps_of(n, steps))]
    for m in reversed(sizes) if back else sizes:
        out[..., :m] = (unstep if back else step)(out[..., :m], wavelet)
    return out


def cube(x: np.ndarray, steps: tuple[int, int, int], wavelet: str | Bank, back: bool = False) -> np.ndarray:
    """x: (..., z, y, x). The standard decomposition: all steps of an axis, axis after axis (0: left alone, -1: all)."""
    for axis, k in reversed(list(zip((-1, -2, -3), steps))) if back else zip((-1, -2, -3), steps):
        if x.shape[axis] > 1 and k:
            x = np.moveaxis(along(np.moveaxis(x, axis, -1), k, wavelet, back), -1, axis)
    return x


def alternate(x: np.ndarray, steps: int, back: bool = False) -> np.ndarray:
    """x: (..., side, side). The non-standard decomposition: a Haar step along x, one along y, then on the quarter of the
    lows; and back."""
    side, out = x.shape[-1], np.array(x, dtype=np.float64)
    sizes = [side >> k for k in range(hof.steps_of(side, steps))]
    for m in reversed(sizes) if back else sizes:
        part, f = out[..., :m, :m], unstep if back else step
        for axis in (-2, -1) if back else (-1, -2):
            part = np.moveaxis(f(np.moveaxis(part, axis, -1), "haar"), -1, axis)
        out[..., :m, :m] = part
    return out


def column(a: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """f on payloads of one length at a time: (rows, places) to (rows, places)."""

    @arrow_udf("array<double>")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lengths = batch.value_lengths()
            valid = np.flatnonzero(lengths.is_valid().to_numpy(zero_copy_only=False))
            sizes = lengths.drop_null().to_numpy()
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            rows: list = [None] * len(batch)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                x = flat[starts[own][:, None] + np.arange(n)] if len(np.unique(sizes)) > 1 else flat.reshape(-1, n)
                for i, values in zip(valid[own].tolist(), f(x) if n else x):
                    rows[i] = values
            yield pa.array(rows, pa.list_(pa.float64()))

    return kernel(a)


def forward(a: Column, steps: int, wavelet: str | Bank = "haar") -> Column:
    return column(a, lambda x: along(x, steps, wavelet))


def inverse(a: Column, steps: int, wavelet: str | Bank = "haar") -> Column:
    return column(a, lambda x: along(x, steps, wavelet, back=True))


def transform(a: Column, shape: tuple[int, int, int], steps: tuple[int, int, int], wavelet: str | Bank = "haar", back: bool = False, layers: bool = False) -> Column:
    """Payloads of a shape (x, y, z). layers: in two dimensions, each layer by itself."""
    nx, ny, nz = shape
    own = (*steps[:2], 0) if layers else steps
    return column(a, lambda x: cube(x.reshape(-1, nz, ny, nx), own, wavelet, back).reshape(len(x), -1))


def alternating(a: Column, side: int, steps: int, back: bool = False) -> Column:
    return column(a, lambda x: alternate(x.reshape(-1, side, side), steps, back).reshape(len(x), -1))


def lows_first(a: Column, rows: int, low: dict[int, float], high: dict[int, float]) -> Column:
    """One step of a separable filter with the caller's taps on each of a payload's rows: the lows of all rows, then the
    highs of all rows."""

    def run(x: np.ndarray) -> np.ndarray:
        lines = step(x.reshape(len(x), rows, -1), (low, high, {}, {}))
        half = lines.shape[-1] // 2
        return np.concatenate([lines[..., :half].reshape(len(x), -1), lines[..., half:].reshape(len(x), -1)], axis=1)

    return column(a, run)

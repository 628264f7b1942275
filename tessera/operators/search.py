"""Searches over compression parameters: threshold fraction, bins and quantizer against encoded size and error.

All trials of a search are measured in one pass over the values: a batch is put in order once, and a trial's bins are
places in that order, so that a trial costs time by its bins, not by the values. What is summed is small: counts of bins
for each trial."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import thresholds

#: Values that are put in order at once.
TOGETHER = 1 << 20
#: The ranges of the searches.
GRID_FRACTIONS = [round(0.5 + 0.01 * i, 2) for i in range(50)]
TRIALS = "fraction double, threshold double, bins long, used long, size_bytes long, mse double, psnr double, rel_err double"


def grown(first: int, last: int, factor: float) -> list[int]:
    """first, and each time the whole part of the factor times the last one, up to `last`."""
    out = [first]
    while int(out[-1] * factor) <= last:
        out.append(int(out[-1] * factor))
    return out


def threshold_fractions() -> list[float]:
    """1 - 0.5 * 0.8^k, while what stays is over a hundredth."""
    return [1 - 0.5 * 0.8**k for k in range(18) if 0.5 * 0.8**k > 0.01]


def numbered(x: np.ndarray, bins: int, t: float, most: float, kind: str) -> np.ndarray:
    """Bins of values, as hof.quant_uniform and hof.quant_log give them."""
    z, nb, pb = (bins - 1) // 2, max((bins - 1) // 2 - 1, 0), max(bins // 2 - 1, 0)
    if most <= t or kind == "log" and t <= 0:
        return np.full(len(x), z)
    with np.errstate(divide="ignore"):
        size = np.log(np.abs(x)) if kind == "log" else x
    span = np.log(most / t) if kind == "log" else most - t
    ps, ns = pb / span, nb / span
    start = np.log(t) if kind == "log" else t
    po, no = 1 - start * ps, 1 - start * ns
    with np.errstate(invalid="ignore"):
        if kind == "log":
            up, down = np.trunc(size * ps + (z + po + 0.5)), np.trunc((z - no + 0.5) - size * ns)
        else:
            up, down = np.trunc(size * ps + (po + z)), np.trunc(size * ns - no) + z
    return np.where(x > t, np.minimum(bins - 1, up), np.where(x < -t, np.maximum(0, down), z)).astype(np.int64)


def middles(bins: int, t: float, most: float, kind: str) -> np.ndarray:
    """The value that each bin gives back."""
    q, z, nb, pb = np.arange(bins), (bins - 1) // 2, max((bins - 1) // 2 - 1, 0), max(bins // 2 - 1, 0)
    if most <= t or kind == "log" and t <= 0:
        return np.zeros(bins)
    span = np.log(most / t) if kind == "log" else most - t
    ps, ns = pb / span, nb / span
    start = np.log(t) if kind == "log" else t
    po, no = 1 - start * ps, 1 - start * ns
    if kind == "log":
        up = np.exp((q - z - po) / ps) if ps else np.full(bins, float(t))
        down = -np.exp((z - q - no) / ns) if ns else np.full(bins, -float(t))
    else:
        up = (q + (0.5 - po - z)) / ps if ps else np.zeros(bins)
        down = (q + (no - 0.5 - z)) / ns if ns else np.zeros(bins)
    return np.where(q > z, up, np.where(q < z, down, 0.0))


def cuts(x: np.ndarray, bins: int, t: float, most: float, kind: str) -> np.ndarray:
    """x in ascending order: where each bin begins, and its end. Bins never fall along the order, so that a bisection for
    all bins at once finds them."""
    lo, hi, want = np.zeros(bins, np.int64), np.full(bins, len(x), np.int64), np.arange(bins)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return np.append(lo, len(x))
        mid = (lo[live] + hi[live]) >> 1
        less = numbered(x[mid], bins, t, most, kind) < want[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The values, TOGETHER or some more at a time, each time in order."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= TOGETHER:
            yield np.sort(np.concatenate(held))
            held, n = [], 0
    if n:
        yield np.sort(np.concatenate(held))


def code_bits(counts: np.ndarray) -> int:
    """The length of an optimal prefix code's text: the sum of all inner nodes' weights; a lone symbol has one bit."""
    heap = counts[counts > 0].tolist()
    if len(heap) < 2:
        return sum(heap)
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        own = heapq.heappop(heap) + heapq.heappop(heap)
        total += own
        heapq.heappush(heap, own)
    return total


def trials(df: DataFrame, value: Column, fractions: Sequence[float], bins: Sequence[int], kind: str = "log") -> DataFrame:
    """A row for each fraction and number of bins: threshold, bins used, encoded size in bytes (whole 32-bit words of a
    prefix code over the bins), mean squared error, pSNR against the largest size (0 without error) and relative error.
    bins 0: the threshold alone, nothing quantised; its size is 0. Nulls don't count; without values: no rows."""
    spark = df.sparkSession
    points = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    most = points.agg(F.max(F.abs("v"))).first()[0]
    if most is None:
        return spark.createDataFrame([], TRIALS)
    plan = [(f, t, b) for f, t in zip(fractions, thresholds(points, F.col("v"), fractions)) for b in bins]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each trial: counts, sums and squares by bin (with 0 bins: of what the threshold removes and what it keeps)."""
        sums: list = [0] * len(plan)
        for x in _ordered(batches):
            one, two = (np.concatenate([[0.0], np.cumsum(c)]) for c in (x, x * x))
            for k, (_, t, b) in enumerate(plan):
                if b:
                    edges = cuts(x, b, t, most, kind)
                    sums[k] = sums[k] + np.stack([np.diff(edges), np.diff(one[edges]), np.diff(two[edges])])
                else:
                    a, z = np.searchsorted(x, -t, "left"), np.searchsorted(x, t, "right")
                    gone = two[z] - two[a]
                    sums[k] = sums[k] + np.array([[z - a, len(x) - z + a], [0, 0], [gone, two[-1] - gone]])
        there = [k for k, s in enumerate(sums) if not isinstance(s, int)]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([sums[k].astype(np.float64).tobytes() for k in there], pa.binary())], ["trial", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(k: int, s: np.ndarray) -> tuple:
            f, t, b = plan[k]
            n, x, xx = s.reshape(3, -1)
            d = middles(b, t, most, kind) if b else np.zeros(2)
            sse = float((n * d * d - 2 * d * x + xx).sum()) if b else float(xx[0])
            mse = max(sse, 0.0) / n.sum()
            size = -(-code_bits(n.astype(np.int64)) // 32) * 4 if b else 0
            return (f, t, b, int((n > 0).sum()) if b else 0, size, mse, 10 * np.log10(most * most / mse) if mse > 0 else 0.0, mse * n.sum() / xx.sum() if xx.sum() else 0.0)

        now, held = None, None
        for batch in batches:
            out = []
            for k, value in zip(batch.column("trial").to_pylist(), batch.column("sums").to_pylist()):
                own = np.frombuffer(value, np.float64)
                if k != now and held is not None:
                    out.append(done(now, held))
                    held = None
                now, held = k, own if held is None else held + own
            if out:
                yield _table(out)
        if held is not None:
            yield _table([done(now, held)])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return points.mapInArrow(partial, "trial int, sums binary").repartition(n, "trial").sortWithinPartitions("trial").mapInArrow(total, TRIALS)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in TRIALS.split(", ")])


def threshold_sweep(df: DataFrame, value: Column) -> DataFrame:
    """Thresholds alone, from a half to nearly all of the values."""
    return trials(df, value, threshold_fractions(), [0])


def bin_sweep(df: DataFrame, value: Column, fraction: float = 0.95, last: int = 30_000) -> DataFrame:
    return trials(df, value, [fraction], grown(20, last, 1.5))


def grid(df: DataFrame, value: Column) -> DataFrame:
    """The full grid."""
    return trials(df, value, GRID_FRACTIONS, grown(100, 2000, 1.1))


def fixed_psnr(df: DataFrame, value: Column, target: float, fractions: Sequence[float] | None = None, bins: Sequence[int] | None = None, kind: str = "log") -> DataFrame:
    """For each fraction (default: 0.6 to 0.95 by 0.05) whose threshold alone reaches the target: the fewest bins (default:
    50 to 30,000 by a tenth more) that exceed it, and their size and pSNR."""
    fractions = [round(0.6 + 0.05 * i, 2) for i in range(8)] if fractions is None else fractions
    alone = trials(df, value, fractions, [0]).where(F.col("psnr") >= target).select("fraction")
    good = trials(df, value, fractions, grown(50, 30_000, 1.1) if bins is None else bins, kind).join(F.broadcast(alone), "fraction", "left_semi").where(F.col("psnr") > target)
    return good.groupBy("fraction").agg(F.min("bins").alias("bins"), F.min_by("size_bytes", "bins").alias("size_bytes"), F.min_by("psnr", "bins").alias("psnr"))


def experiment(df: DataFrame, value: Column) -> DataFrame:
    """Bits 4 to 12 by fractions 0.1 to 0.9: log10 of the error, and the reduction of size against a byte a value in percent."""
    n = df.where(value.isNotNull()).count()
    out = trials(df, value, [round(0.1 * i, 1) for i in range(1, 10)], [1 << b for b in range(4, 13)])
    return out.select(F.log2("bins").cast("int").alias("bits"), "fraction", F.log10("mse").alias("log_mse"), (100.0 * (n - F.col("size_bytes")) / n).alias("reduction"))


def fewest_bins(df: DataFrame, value: Column, cut: float, most_error: float, halvings: int = 7, most: int = 1024, kind: str = "log") -> int:
    """The fewest bins whose relative error stays under most_error, by bisection between 0 and `most`; all numbers of bins
    that it can ask are measured in one pass."""
    asked, todo = set(), [(0, most)]
    for _ in range(halvings):
        todo = [pair for a, b in todo for middle in [(a + b) // 2] if a < b and not asked.add(middle) for pair in ((middle, b), (a, middle)) if pair != (a, b)]
    error = {r["bins"]: r["rel_err"] for r in trials(df, value, [cut], sorted(b for b in asked if b > 2), kind).collect()}
    low, high = 0, most
    for _ in range(halvings):
        middle = (low + high) // 2
        low, high = (middle, high) if error.get(middle, float("inf")) >= most_error else (low, middle)
    return (low + high) // 2


def climbed(df: DataFrame, value: Column, cut: float, bins: int, most_error: float, steps: int = 10, kind: str = "log") -> tuple[float, int, float]:
    """(cut in percent, bins, compression ratio): from a start, a percent more cut or a bin fewer, whichever gives the better
    ratio and stays within the error, until neither does. All trials that so many steps can reach are measured in one
    pass."""
    n = df.where(value.isNotNull()).count()
    rows = trials(df, value, [round((cut + i) / 100, 6) for i in range(steps + 1) if cut + i < 100], [bins - i for i in range(steps + 1) if bins - i > 2], kind).collect()
    known = {(round(r["fraction"] * 100, 4), r["bins"]): (r["rel_err"], n / r["size_bytes"] if r["size_bytes"] else 0.0) for r in rows}
    at = (round(float(cut), 4), bins)
    for _ in range(steps):
        ratio = known[at][1]
        ways = [w for w in ((round(at[0] + 1, 4), at[1]), (at[0], at[1] - 1)) if w in known and known[w][0] <= most_error and known[w][1] >= ratio]
        if not ways:
            break
        at = max(ways, key=lambda w: known[w][1])
    return at[0], at[1], known[at][1]

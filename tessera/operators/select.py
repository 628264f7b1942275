"""Exact order statistics without a global sort."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that are few enough to be ordered on the driver, and bins of the first pass and of later ones.
FEW, BINS, LATER = 50_000, 65_536, 1024


def order_statistics(df: DataFrame, value: Column, ks: Sequence[int]) -> list[float | None]:
    """The k-th least (from 0) value for each k; None where there is none. All ranks are narrowed down together: a pass
    counts values in bins of the ranges that hold an answer (a map-side aggregate), and the next goes on with the bins that
    the ranks fall into, until few values are left, which come to the driver. Nulls don't count. No pass sorts the
    table or brings it into one partition, and the number of passes doesn't grow with the number of ranks."""
    points = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    lo, hi, n = points.agg(F.min("v"), F.max("v"), F.count("*")).first()
    out: list[float | None] = [None] * len(ks)
    # ranges that hold answers: (least, most, number of values, [(place in out, rank within)]), disjoint, ascending
    ranges = [(lo, hi, n, [(i, k) for i, k in enumerate(ks) if 0 <= k < n])]
    bins = BINS
    while True:
        for low, high, _, asked in ranges:
            if low == high:
                for i, _ in asked:
                    out[i] = low
        ranges = [r for r in ranges if r[3] and r[0] != r[1]]
        if not ranges or sum(r[2] for r in ranges) <= FEW:
            break
        inside = F.coalesce(*(F.when(F.col("v").between(low, high), F.struct(F.lit(g).alias("g"), F.lit(low).alias("lo"), F.lit(high).alias("hi"))) for g, (low, high, *_) in enumerate(ranges)))
        placed = points.select("v", inside.alias("r")).where(F.col("r").isNotNull())
        bin_ = F.least(F.floor((F.col("v") - F.col("r.lo")) / (F.col("r.hi") - F.col("r.lo")) * bins), F.lit(bins - 1))
        counted = placed.groupBy(F.col("r.g").alias("g"), bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = sorted(counted.collect(), key=lambda r: (r["g"], r["b"]))  # at most bins for each range
        found = []
        for g, (*_, asked) in enumerate(ranges):
            own = [r for r in rows if r["g"] == g]
            ends, total = [], 0
            for r in own:
                ends.append(total)
                total += r["n"]
            by: dict[int, list] = {}
            for i, k in asked:
                at = bisect_right(ends, k) - 1
                by.setdefault(at, []).append((i, k - ends[at]))
            found += [(own[at]["lo"], own[at]["hi"], own[at]["n"], ranks) for at, ranks in sorted(by.items())]
        ranges, bins = found, LATER
    if ranges:
        some = F.lit(False)
        for low, high, *_ in ranges:
            some = some | F.col("v").between(low, high)
        values = sorted(r["v"] for r in points.where(some).collect())  # at most FEW
        at = 0
        for _, _, size, asked in ranges:
            for i, k in asked:
                out[i] = values[at + k]
            at += size
    return out


def order_statistic(df: DataFrame, value: Column, k: int) -> float | None:
    """The k-th least (from 0) value; None where there is none."""
    return order_statistics(df, value, [k])[0]


def thresholds(df: DataFrame, value: Column, fractions: Sequence[float]) -> list[float]:
    """sorted(abs(v))[int(fraction * n)] for each fraction; a zero becomes 1e-16; fractions at or under 0 and over 1 give
    the ends. Without values: 1e-16."""
    n = df.where(value.isNotNull()).count()
    found = order_statistics(df, F.abs(value), [min(max(int(f * n), 0), n - 1) for f in fractions])
    return [x or 1e-16 for x in found]


def threshold(df: DataFrame, value: Column, fraction: float) -> float:
    return thresholds(df, value, [fraction])[0]


def threshold_from_one(df: DataFrame, value: Column, cut: float, up: bool = False) -> float | None:
    """The other rule for a threshold: ranks count from 1, floor(cut * n) (or, up, ceil), and the smallest step of a double
    is added, so that the value itself falls under it."""
    n = df.where(value.isNotNull()).count()
    rank = -int(-cut * n // 1) if up else int(cut * n)
    found = order_statistic(df, F.abs(value), min(max(rank, 1), n) - 1)
    return None if found is None else found + 2.0**-52


def max_cut(df: DataFrame, value: Column, most_error: float, halvings: int = 7) -> float:
    """The largest cut (a fraction of the values, the least of which become zero) whose relative squared error stays at or
    under most_error, by bisection. All cuts that a bisection of so many halvings can ask are ranked in one go, and one
    aggregate gives the squares between them: the bisection itself needs no further pass."""
    parts = 1 << halvings
    fractions = [i / parts for i in range(1, parts)]
    limits = thresholds(df, value, fractions)
    ordered = sorted(set(limits))
    place = F.aggregate(F.array(*map(F.lit, ordered)), F.lit(0), lambda n, b: n + F.when(b < F.abs(value), 1).otherwise(0))
    sums = {r["b"]: r["s"] for r in df.where(value.isNotNull()).groupBy(place.alias("b")).agg(F.sum(value * value).alias("s")).collect()}
    total, under = sum(sums.values()), {}
    running = 0.0
    for i, t in enumerate(ordered):
        running += sums.get(i, 0.0)
        under[t] = running
    low, high = 0, parts
    for _ in range(halvings):
        middle = (low + high) // 2
        low, high = (middle, high) if under[limits[middle - 1]] <= most_error * total else (low, middle)
    return low / parts

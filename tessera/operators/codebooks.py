"""Fitted quantizers: Lloyd iteration, geometric and mirrored codebooks, bins of equal population."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hof
from .select import order_statistics


def geometric(lo: float, hi: float, n: int) -> list[float]:
    return [lo * math.exp(i * math.log(hi / lo) / n) for i in range(n)]


def mirrored(book: list[float], t: float, least: float, most: float, bins: int) -> tuple[list[float], list[float]]:
    """(boundaries, values) on both sides of a zero bin [-t, t], from a codebook of positive values: each value also with
    a minus sign, boundaries half way between neighbours; with an even number of bins one more value at the farther end
    of the data."""
    middle = [(a + b) / 2 for a, b in zip(book, book[1:])]
    values = [-x for x in reversed(book)] + [0.0] + list(book)
    bounds = [-x for x in reversed(middle)] + [-t, t] + middle
    if bins % 2 == 0:
        if abs(least) > most:
            values, bounds = [least, *values], [(least - book[-1]) / 2, *bounds]
        else:
            values, bounds = [*values, most], [*bounds, (most + book[-1]) / 2]
    return bounds, values


def _between(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie at or under x."""
    return F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, b: n + F.when(b <= x, 1).otherwise(0)) if cuts else F.lit(0)


def lloyd(df: DataFrame, value: Column, book: list[float], stop: float = 1e-6, most: int = 100) -> tuple[list[float], list[float], int]:
    """(codebook, partition, iterations). Each pass is one aggregate over the values, a row for each codeword: the nearest
    codeword's sums (ties to the first), and the sums of what lies between codewords, whose means are the partition. The
    iteration ends when the mean signed distortion changes by at most `stop`."""
    points = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull())
    least, top, n = points.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return list(book), [(a + b) / 2 for a, b in zip(book, book[1:])], 0
    book = list(book)
    partition = [(a + b) / 2 for a, b in zip(book, book[1:])]

    def nearest(words: list[float]) -> dict[int, tuple[float, int]]:
        cuts = [(a + b) / 2 for a, b in zip(words, words[1:])]
        place = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda k, b: k + F.when(b < F.col("v"), 1).otherwise(0)) if cuts else F.lit(0)
        return {r["k"]: (r["s"], r["n"]) for r in points.groupBy(place.alias("k")).agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()}

    def distortion(words: list[float], sums: dict) -> float:
        return sum(words[k] * c - s for k, (s, c) in sums.items()) / n

    sums = nearest(book)
    dist = distortion(book, sums)
    change, rounds = abs(dist), 0
    while change > stop and rounds < most:
        rounds += 1
        ends = [least, *partition, top]
        book = [sums[i][0] / sums[i][1] if i in sums else (ends[i] + ends[i + 1]) / 2 for i in range(len(book))]
        inside = {r["k"] - 1: (r["s"], r["n"]) for r in points.groupBy(_between(F.col("v"), book).alias("k")).agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()}
        partition = [inside[i][0] / inside[i][1] if i in inside else (book[i] + book[i + 1]) / 2 for i in range(len(book) - 1)]
        sums = nearest(book)
        before, dist = dist, distortion(book, sums)
        change = abs(before - dist)
    return book, partition, rounds


def equal_population(df: DataFrame, value: Column, bits: int, t: float) -> tuple[list[float], list[float]]:
    """(boundaries, values) of 2**bits bins over absolute values: boundaries are the lower ends of all bins but the first,
    which holds what is at or under t (or its share of all values, if that is more); a bin's value is its middle one by
    rank, the first bin's is zero. The rest is shared out evenly; a value that fills several bins ends one of them, and
    what lies over it is shared out again among the bins that are left.

    The ranks of all bins that are left are looked up at once, and again only behind such a value."""
    size, bins = F.abs(value), 1 << bits
    there = df.where(value.isNotNull())
    n, small = there.agg(F.count("*"), F.coalesce(F.sum((size <= t).cast("long")), F.lit(0))).first()
    if not n:
        return [0.0] * (bins - 1), [0.0] * bins
    known: dict[int, float] = {}

    def look_up(ranks: list[int]) -> list[float]:
        ranks = [min(r, n - 1) for r in ranks]
        new = sorted(set(ranks) - known.keys())
        known.update(zip(new, order_statistics(there, size, new)))
        return [known[r] for r in ranks]

    share = n // bins
    ends = [max(small, share)]  # ranks at which bins begin
    if small >= share:
        share = (n - small) // (bins - 1)
    while len(ends) < bins - 1:
        ahead = [min(ends[-1] + share * (j + 1), n) for j in range(bins - 1 - len(ends))]
        values = look_up([ends[-1], *ahead])
        tied = next((j for j, (a, b) in enumerate(zip(values, values[1:])) if a == b and ahead[j] < n), len(ahead))
        ends += ahead[:tied]
        if tied < len(ahead):
            over = there.where(size <= values[tied]).count()
            share = (n - over) // (bins - len(ends))
            ends.append(over)
    middles = [(a + b) // 2 if b < n else n - 1 for a, b in zip(ends, ends[1:])] + [(ends[-1] + n) // 2]
    return look_up(ends), [0.0, *look_up(middles)]


def equal_population_signed(df: DataFrame, value: Column, bits: int, t: float) -> tuple[list[float], list[float]]:
    """(boundaries, values) of 2**bits bins over signed values, for hof.quant_codebook: bins in proportion to the values
    under -t and over t, one for what lies between, and a bin of its own for the largest value; a bin's value is its
    middle one by rank, the outermost bins' are the extremes. Ranks follow from four counts and are looked up at once."""
    there, bins = df.where(value.isNotNull()), 1 << bits
    n, below, over = there.agg(F.count("*"), F.coalesce(F.sum((value < -t).cast("long")), F.lit(0)), F.coalesce(F.sum((value > t).cast("long")), F.lit(0))).first()
    if not n:
        return [0.0] * (bins - 1), [0.0] * bins
    down = min(int(below / max(below + over, 1) * bins), bins - 2)
    up = bins - down - 1
    step, stride = below / max(down, 1), over / up
    lows = [int(step * (i + 1)) for i in range(max(down - 1, 0))]
    low_middles = [0, *(int(step * i + step / 2) for i in range(1, max(down - 1, 1)))][:down] + ([int((below + step * (down - 1)) / 2)] if down > 1 else [])
    highs = [int(n - over + stride * (i + 1)) for i in range(up - 1)]
    high_middles = [int(n - over + stride * i + stride / 2) for i in range(up - 1)]
    asked = [min(max(r, 0), n - 1) for r in (*lows, *low_middles, *highs, *high_middles, n - 2, n - 1)]
    found = order_statistics(there, value, asked)
    cut = [found[a:b] for a, b in zip(*(lambda e: (e, e[1:]))([0, len(lows), len(lows) + len(low_middles), len(lows) + len(low_middles) + len(highs), len(asked) - 2]))]
    bounds = [*cut[0], *([-t] if down else []), t, *cut[2]]
    bounds[-1] = 0.01 * found[-2] + 0.99 * found[-1]
    return bounds, [*cut[1], 0.0, *cut[3], found[-1]]


def quant_population(x: Column, bounds: list[float]) -> Column:
    """The bin by size, signed: boundaries are the bins' lower ends."""
    return F.signum(x).cast("int") * _between(F.abs(x), bounds)


__all__ = ["equal_population", "equal_population_signed", "geometric", "hof", "lloyd", "mirrored", "quant_population"]

"""Column kernels over array payloads: no shuffle, no Python. Every function takes and gives columns; lengths, step counts
and shapes are plain integers, since they are the same for all rows of a call."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Analysis and synthesis taps of the 9/7 filter bank, from the centre outwards.
LOW_ANALYSIS = (0.85269867900940, 0.377402855612650, -0.110624404418420, -0.02384946501938, 0.037828455506995)
HIGH_ANALYSIS = (-0.788485616405660, 0.418092273222210, 0.040689417609558, -0.064538882628938)
LOW_SYNTHESIS = (0.788485616405660, 0.377402855612650, -0.040689417609558, -0.02384946501938)
HIGH_SYNTHESIS = (-0.85269867900940, 0.418092273222210, 0.110624404418420, -0.064538882628938, -0.037828455506995)
#: Biorthogonal filter pairs (analysis low-pass, synthesis low-pass), whole taps.
PAIRS = {
    "CDF_2.2": (
        (-0.17677669529664, 0.35355339059327, 1.06066017177982, 0.35355339059327, -0.17677669529664),
        (0.35355339059327, 0.70710678118655, 0.35355339059327),
    ),
    "CDF_2.4": (
        (0.03314563036812, -0.06629126073624, -0.17677669529664, 0.41984465132951, 0.99436891104358, 0.41984465132951, -0.17677669529664, -0.06629126073624, 0.03314563036812),
        (0.35355339059327, 0.70710678118655, 0.35355339059327),
    ),
    "CDF_2.6": (
        (-0.00690533966002, 0.01381067932005, 0.04695630968817, -0.10772329869639, -0.16987135563661, 0.44746600996961, 0.96674755240348, 0.44746600996961, -0.16987135563661, -0.10772329869639, 0.04695630968817, 0.01381067932005, -0.00690533966002),
        (0.35355339059327, 0.70710678118655, 0.35355339059327),
    ),
    "CDF_4.4": (
        tuple(math.sqrt(2) * c for c in (0.026748757411, -0.016864118443, -0.078223266529, 0.266864118443, 0.602949018236, 0.266864118443, -0.078223266529, -0.016864118443, 0.026748757411)),
        tuple(math.sqrt(2) * c for c in (-0.045635881557, -0.028771763114, 0.295635881557, 0.557543526229, 0.295635881557, -0.028771763114, -0.045635881557)),
    ),
    "VS_7.9": (
        (0.037828455506995, -0.02384946501938, -0.110624404418420, 0.377402855612650, 0.85269867900940, 0.377402855612650, -0.110624404418420, -0.02384946501938, 0.037828455506995),
        (-0.064538882628938, -0.040689417609558, 0.418092273222210, 0.788485616405660, 0.418092273222210, -0.040689417609558, -0.064538882628938),
    ),
}
ROOT = 0.7071067811865476


def let(value: Column, then) -> Column:
    """then(value), with the value computed once: an outer expression inside a lambda is computed for each element."""
    return F.transform(F.array(value), then)[0]


def index(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")


def mirrored(i: Column, n: int) -> Column:
    """Whole-sample symmetric extension: ..2 1 0 1 2..n-1 n-2.."""
    if n == 1:
        return F.lit(0)
    k = F.pmod(i, F.lit(2 * (n - 1)))
    return F.least(k, F.lit(2 * (n - 1)) - k)


def steps_most(n: int) -> int:
    """Halvings until one element is left (rounded up)."""
    return max(0, (n - 1).bit_length())


def steps_of(n: int, steps: int) -> int:
    """-1: as many as there are; 0: the axis is left alone."""
    return steps_most(n) if steps < 0 else min(steps, steps_most(n))


def padded_length(n: int, steps: int, power: bool = False) -> int:
    m = 1 << (steps_most(n) if power else steps)
    return m * -(-n // m)


def pad(a: Column, n: int, to: int, how: str = "repeat") -> Column:
    """Extend to a length: "zero", "repeat" (the last value) or "reflect" (mirrored without the edge, again and again)."""
    if how == "zero" or n == 0:
        more = F.array_repeat(F.lit(0.0), to - n)
    elif how == "repeat" or n == 1:
        more = F.array_repeat(F.get(a, F.lit(n - 1)), to - n)
    else:
        return let(a, lambda v: F.transform(index(to), lambda i: F.get(v, mirrored(i, n))))
    return F.concat(a, more)


def haar_step(a: Column) -> Column:
    even, odd = F.filter(a, lambda x, i: i % 2 == 0), F.filter(a, lambda x, i: i % 2 == 1)
    return F.concat(F.zip_with(even, odd, lambda x, y: (x + y) * ROOT), F.zip_with(even, odd, lambda x, y: (x - y) * ROOT))


def haar_unstep(a: Column, n: int) -> Column:
    h = n // 2
    return F.flatten(F.zip_with(F.slice(a, 1, h), F.slice(a, h + 1, h), lambda x, y: F.array((x + y) * ROOT, (x - y) * ROOT)))


def tapped(v: Column, centre: Column, taps: dict[int, float], n: int) -> Column:
    out = None
    for k, c in taps.items():
        term = F.get(v, mirrored(centre + k, n)) * c
        out = term if out is None else out + term
    return out


def symmetric(half: tuple) -> dict[int, float]:
    return {k: half[abs(k)] for k in range(-len(half) + 1, len(half))}


def bank_step(a: Column, n: int, low: dict[int, float], high: dict[int, float]) -> Column:
    """Low half: taps around each even place; high half: around each odd one."""
    h = n // 2
    return F.concat(F.transform(index(h), lambda i: tapped(a, i * 2, low, n)), F.transform(index(h), lambda i: tapped(a, i * 2 + 1, high, n)))


def bank_unstep(a: Column, n: int, low: dict[int, float], high: dict[int, float]) -> Column:
    """Interleave the halves, then taps by the parity of the place."""
    h = n // 2
    mixed = F.flatten(F.zip_with(F.slice(a, 1, h), F.slice(a, h + 1, h), lambda x, y: F.array(x, y)))
    return let(mixed, lambda v: F.transform(index(n), lambda i: F.when(i % 2 == 0, tapped(v, i, low, n)).otherwise(tapped(v, i, high, n))))


def pair_taps(name: str) -> tuple[dict, dict, dict, dict]:
    """Analysis low and high, synthesis even and odd, of a biorthogonal pair: each high-pass is the other's low-pass with
    alternating signs."""
    analysis, synthesis = PAIRS[name]
    a = {k - len(analysis) // 2: c for k, c in enumerate(analysis)}
    s = {k - len(synthesis) // 2: c for k, c in enumerate(synthesis)}
    high = {k: (-c if k % 2 == 0 else c) for k, c in s.items()}
    # at an even place the low samples stand at even distances, the high ones at odd distances
    even = {k: (s.get(k, 0.0) if k % 2 == 0 else a.get(k, 0.0)) for k in range(-max(a), max(a) + 1)}
    odd = {k: (s.get(k, 0.0) if k % 2 == 1 else -a.get(k, 0.0)) for k in range(-max(a), max(a) + 1)}
    return a, high, even, odd


def kernels(wavelet: str):
    """(forward, inverse): functions of (array, length) for one step."""
    if wavelet == "haar":
        return lambda a, n: haar_step(a), haar_unstep
    if wavelet == "cdf97":
        la, ha, ls, hs = map(symmetric, (LOW_ANALYSIS, HIGH_ANALYSIS, LOW_SYNTHESIS, HIGH_SYNTHESIS))
    elif wavelet in PAIRS:
        la, ha, ls, hs = pair_taps(wavelet)
    else:
        raise ValueError(f"no such wavelet: {wavelet}")
    return lambda a, n: bank_step(a, n, la, ha), lambda a, n: bank_unstep(a, n, ls, hs)


def _on_head(a: Column, n: int, m: int, f) -> Column:
    """f on the first m of n values; the rest stays."""
    if m == n:
        return let(a, f)
    return let(a, lambda v: F.concat(let(F.slice(v, 1, m), f), F.slice(v, m + 1, n - m)))


def forward(a: Column, n: int, steps: int, wavelet: str = "haar") -> Column:
    """Steps on the low half of the step before; lows first."""
    step, _ = kernels(wavelet)
    for k in range(steps_of(n, steps)):
        if (n >> k) % 2:
            raise ValueError(f"a length of {n >> k} can't be halved: pad first")
        a = _on_head(a, n, n >> k, _fixed(step, n >> k))
    return a


def inverse(a: Column, n: int, steps: int, wavelet: str = "haar") -> Column:
    _, unstep = kernels(wavelet)
    for k in reversed(range(steps_of(n, steps))):
        a = _on_head(a, n, n >> k, _fixed(unstep, n >> k))
    return a


def _fixed(f, n: int):
    """f(., n) as a function of one argument: Spark counts a lambda's arguments, defaults too."""
    return lambda v: f(v, n)


def along(a: Column, shape: tuple[int, int, int], axis: int, f) -> Column:
    """f on every line of an axis (0: x, the fastest) of a payload; f keeps the length."""
    nx, ny, nz = shape
    n, size = shape[axis], nx * ny * nz
    stride = (1, nx, nx * ny)[axis]

    def first(line):  # where a line begins: lines are counted over the other axes, the faster first
        return line * nx if axis == 0 else line % nx + F.floor(line / nx) * (nx * ny) if axis == 1 else line

    def whole(v: Column) -> Column:
        lines = F.transform(index(size // n), lambda k: f(F.transform(index(n), lambda i: F.get(v, (first(k) + i * stride).cast("int")))))
        if axis == 0:
            return F.flatten(lines)

        def place(p: Column) -> Column:
            if axis == 1:
                return (p % nx + F.floor(p / (nx * ny)) * nx) * n + F.floor(p / nx) % ny
            return (p % stride) * n + F.floor(p / stride)

        return let(F.flatten(lines), lambda flat: F.transform(index(size), lambda p: F.get(flat, place(p).cast("int"))))

    return let(a, whole)


def transform(a: Column, shape: tuple[int, int, int], steps: tuple[int, int, int], wavelet: str = "haar", back: bool = False) -> Column:
    """The standard decomposition: all steps of an axis, axis after axis; coordinates stay where they are."""
    one = inverse if back else forward
    for axis in (2, 1, 0) if back else (0, 1, 2):
        n, k = shape[axis], steps[axis]
        if n > 1 and steps_of(n, k):
            a = along(a, shape, axis, _steps(one, n, k, wavelet))
    return a


def _steps(one, n: int, k: int, wavelet: str):
    return lambda line: one(line, n, k, wavelet)


def alternating(a: Column, side: int, steps: int) -> Column:
    """The non-standard decomposition of a square: one Haar step along x, one along y, then on the quarter of the lows."""
    for k in range(steps_of(side, steps)):
        for axis in (0, 1):
            a = _quarter_step(a, side, side >> k, axis)
    return a


def _quarter_step(a: Column, side: int, m: int, axis: int) -> Column:
    """A Haar step of the first m values of a square's first m lines."""
    done = along(a, (side, side, 1), axis, lambda line: _on_head(line, side, m, haar_step))
    if m == side:
        return done
    inside = lambda p: (p % side < m) & (F.floor(p / side) < m)
    return let(F.array(a, done), lambda both: F.transform(index(side * side), lambda p: F.when(inside(p), F.get(both[1], p)).otherwise(F.get(both[0], p))))


def relabelled(a: Column, size: int, source) -> Column:
    """A payload whose place p holds what stood at source(p)."""
    return let(a, lambda v: F.transform(index(size), lambda p: F.get(v, source(p).cast("int"))))


# Scalar functions.


def to_byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)).cast("int")


def to_int(v: Column) -> Column:
    return (v + 0.5).cast("int")


def leading_zeros(n: Column) -> Column:
    """Of a 32-bit value."""
    return F.when(n == 0, 32).otherwise(32 - F.length(F.bin(n.bitwiseAND(F.lit(0xFFFFFFFF)))))


def ceil_log2(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _sides(bins: int) -> tuple[int, int, int]:
    """The zero bin, and how many bins lie under and over it, counting it for each side."""
    return (bins - 1) // 2, (bins - 1) // 2, bins // 2


def _kept(x: Column, bin_: Column) -> Column:
    """A null has no bin."""
    return F.when(x.isNotNull(), bin_)


def quant_uniform(x: Column, bins: int, t: float, most: float) -> Column:
    """The bin of a value: even steps from t to most on either side of the zero bin; null: null. Where there is no step (most
    at or under t) all values are in the zero bin; a side of one bin takes its whole side."""
    z, nb, pb = _sides(bins)
    if most <= t:
        return _kept(x, F.lit(z))
    ps, ns = max(pb - 1, 0) / (most - t), max(nb - 1, 0) / (most - t)
    po, no = 1 - t * ps, 1 - t * ns
    up, down = (x * ps + (po + z)).cast("int"), (x * ns - no).cast("int") + z
    return _kept(x, F.when(x > t, F.least(F.lit(bins - 1), up)).when(x < -t, F.greatest(F.lit(0), down)).otherwise(z))


def dequant_uniform(q: Column, bins: int, t: float, most: float) -> Column:
    """The middle of a bin; of a side of one bin, which has no step, zero (its inverse scale is taken as zero). Null: null."""
    z, nb, pb = _sides(bins)
    if most <= t:
        return _kept(q, F.lit(0.0))
    ps, ns = max(pb - 1, 0) / (most - t), max(nb - 1, 0) / (most - t)
    po, no = 1 - t * ps, 1 - t * ns
    over = (q + (0.5 - po - z)) / ps if ps else F.lit(0.0)
    under = (q + (no - 0.5 - z)) / ns if ns else F.lit(0.0)
    return _kept(q, F.when(q > z, over).when(q < z, under).otherwise(0.0))


def _log(bins: int, t: float, most: float):
    z, nb, pb = _sides(bins)
    ps, ns = max(pb - 1, 0) / math.log(most / t), max(nb - 1, 0) / math.log(most / t)
    return z, ps, ns, 1 - ps * math.log(t), 1 - ns * math.log(t)


def quant_log(x: Column, bins: int, t: float, most: float) -> Column:
    """As quant_uniform, in even steps of the logarithm; a value over most is in the last bin."""
    if most <= t or t <= 0:
        return _kept(x, F.lit((bins - 1) // 2))
    z, ps, ns, po, no = _log(bins, t, most)
    size = F.ln(F.abs(x))
    up, down = (size * ps + (z + po + 0.5)).cast("int"), (F.lit(z - no + 0.5) - size * ns).cast("int")
    return _kept(x, F.when(x > t, F.least(F.lit(bins - 1), up)).when(x < -t, F.greatest(F.lit(0), down)).otherwise(z))


def dequant_log(q: Column, bins: int, t: float, most: float) -> Column:
    """A bin's value; a side of one bin gives the threshold, with its sign. Null: null."""
    if most <= t or t <= 0:
        return _kept(q, F.lit(0.0))
    z, ps, ns, po, no = _log(bins, t, most)
    over = F.exp((q - z - po) / ps) if ps else F.lit(float(t))
    under = -F.exp((F.lit(z) - q - no) / ns) if ns else F.lit(-float(t))
    return _kept(q, F.when(q > z, over).when(q < z, under).otherwise(0.0))


def quant_codebook(x: Column, boundaries: list[float]) -> Column:
    """The bin: how many boundaries lie under the value; at or over the last one, the last bin; null: null."""
    under = F.aggregate(F.array(*map(F.lit, boundaries)), F.lit(0), lambda n, b: n + F.when(b < x, 1).otherwise(0))
    return _kept(x, F.when(x >= boundaries[-1], len(boundaries)).otherwise(under))


def dequant_codebook(q: Column, values: list[float]) -> Column:
    return F.get(F.array(*map(F.lit, values)), q)


def quant_partition(x: Column, partition: list[float]) -> Column:
    """The other form of a codebook's bins, by partition points alone: how many lie under the value, the last one
    included like any other."""
    return _kept(x, F.aggregate(F.array(*map(F.lit, partition)), F.lit(0), lambda n, b: n + F.when(b < x, 1).otherwise(0)))


def quant_bits(x: Column, bits: int, t: float, most: float, log: bool = False) -> Column:
    """The older quantizers, by bits: the sign times the rounded-up step over the threshold; at or under it, zero."""
    base = (1 << (bits - 1)) - 1
    step = F.ln(F.abs(x) / t) / math.log(most / t) if log else (F.abs(x) - t) / (most - t)
    return _kept(x, F.when(F.abs(x) <= t, 0).otherwise(F.signum(x) * F.ceil(step * base)).cast("int"))


def dequant_bits(q: Column, bits: int, t: float, most: float, log: bool = False) -> Column:
    """What those give back: zero, or the step's upper end with its sign."""
    base = (1 << (bits - 1)) - 1
    size = F.exp(F.abs(q) * (math.log(most / t) / base)) * t if log else F.abs(q) * ((most - t) / base) + t
    return _kept(q, F.when(q == 0, 0.0).otherwise(F.signum(q) * size))


# Conversions between stored and worked-on values.


def byte_to_unit(b: Column) -> Column:
    """0..255 to -0.5..0.5."""
    return b / 255.0 - 0.5


def unit_to_byte(v: Column) -> Column:
    return to_byte((v + 0.5) * 255.0)


def int_to_unit(i: Column, most: int) -> Column:
    """0..most to -0.5..0.5."""
    return i / float(most) - 0.5


def unit_to_int(v: Column, most: int) -> Column:
    return to_int((v + 0.5) * float(most))


def share_to_byte(v: Column) -> Column:
    """0..1 to 0..255, rounded."""
    return (v * 255.0 + 0.5).cast("int")


def is_padded(n: Column, steps: int) -> Column:
    """Whether a length can be halved so many times."""
    return n % (1 << steps) == 0


def brightened(v: Column, low: Column, high: Column, gain: float = 1.0) -> Column:
    """Values between low and high as grey levels 0..255, times a gain, cut off at both ends."""
    level = F.when(high > low, (v - low) / (high - low) * 255.0).otherwise(0.0)
    return F.least(F.greatest(level * gain, F.lit(0.0)), F.lit(255.0)).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """The grey level of a colour."""
    return r * 0.299 + g * 0.587 + b * 0.114


def bits_pushed(values: Column, counts: Column) -> Column:
    """A stack of bits as a string: of each value so many of its low bits, the highest first."""
    return F.array_join(F.zip_with(values, counts, lambda v, n: F.right(F.lpad(F.bin(v), 64, "0"), n)), "")

"""The queries of `plans.queries` in DuckDB's SQL, over voxel tables: other forms of the same sums."""

from __future__ import annotations

import math

from ..functions import hof
from .queries import BINS, BOOK, CENTRE, IDS, MOST, T

ROOT = hof.ROOT
LINE = "SELECT vec_id AS cube_id, unnest(range(64)) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings"
SQUARE = f"SELECT cube_id, x % 8 AS x, x // 8 AS y, v FROM ({LINE})"
CUBE = f"SELECT cube_id, x % 4 AS x, (x // 4) % 4 AS y, x // 16 AS z, v FROM ({LINE})"
COEF = f"SELECT l_extendedprice - {CENTRE} AS v FROM lineitem"
STREAM = "SELECT event_id // 4096 AS cube_id, event_id % 4096 AS pos, user_id % {n} AS s FROM events"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def chain(first: str, steps: list, last: str) -> str:
    """first: a query; steps: functions from a relation's name to a query; last: a query over `done`."""
    parts, name = [f"r0 AS MATERIALIZED ({first})"], "r0"
    for k, step in enumerate(steps, 1):
        parts.append(f"r{k} AS MATERIALIZED ({step(name)})")
        name = f"r{k}"
    return f"WITH {', '.join(parts)}, done AS (SELECT * FROM {name}) {last}"


def haar(axis: str, others: str, m: int, inside: str = "true"):
    def step(r: str) -> str:
        pair = f"FROM {r} WHERE {axis} < {m} AND {inside} GROUP BY {others}, {axis} // 2"
        even, odd = (f"sum(CASE WHEN {axis} % 2 = {k} THEN v END)" for k in (0, 1))
        return (
            f"SELECT {others}, {axis} // 2 AS {axis}, ({even} + {odd}) * {ROOT} AS v {pair} UNION ALL BY NAME "
            f"SELECT {others}, {axis} // 2 + {m // 2} AS {axis}, ({even} - {odd}) * {ROOT} AS v {pair} UNION ALL BY NAME SELECT {others}, {axis}, v FROM {r} WHERE NOT ({axis} < {m} AND {inside})"
        )

    return step


def bank(axis: str, others: str, m: int, low: dict, high: dict):
    taps = ", ".join(f"({p}, {k}, {c!r}::DOUBLE)" for p, t in ((0, low), (1, high)) for k, c in t.items())
    p = 2 * (m - 1)

    def step(r: str) -> str:
        return (
            f"SELECT {others}, o.i // 2 + {m // 2} * (o.i % 2) AS {axis}, sum(t.c * s.v) AS v FROM (SELECT unnest(range({m})) AS i) o JOIN (VALUES {taps}) t(p, k, c) ON t.p = o.i % 2 "
            f"JOIN {r} s ON s.{axis} = least(((o.i + t.k) % {p} + {p}) % {p}, {p} - ((o.i + t.k) % {p} + {p}) % {p}) GROUP BY {others}, o.i UNION ALL BY NAME SELECT {others}, {axis}, v FROM {r} WHERE {axis} >= {m}"
        )

    return step


def around(*taps: float) -> dict[int, float]:
    return {k - len(taps) // 2: c for k, c in enumerate(taps)}


def alternating(*taps: float) -> dict[int, float]:
    return {k: (-c if k % 2 == 0 else c) for k, c in around(*taps).items()}


#: Taps of the filter banks, spelled here again so that no query is checked with its own.
LA = around(0.037828455506995, -0.02384946501938, -0.110624404418420, 0.377402855612650, 0.85269867900940, 0.377402855612650, -0.110624404418420, -0.02384946501938, 0.037828455506995)
HA = around(-0.064538882628938, 0.040689417609558, 0.418092273222210, -0.788485616405660, 0.418092273222210, 0.040689417609558, -0.064538882628938)
SPLINE = alternating(0.35355339059327, 0.70710678118655, 0.35355339059327)
B22 = around(-0.17677669529664, 0.35355339059327, 1.06066017177982, 0.35355339059327, -0.17677669529664), SPLINE
B26 = around(-0.00690533966002, 0.01381067932005, 0.04695630968817, -0.10772329869639, -0.16987135563661, 0.44746600996961, 0.96674755240348, 0.44746600996961, -0.16987135563661, -0.10772329869639, 0.04695630968817, 0.01381067932005, -0.00690533966002), SPLINE
R2 = 2**0.5
B44 = around(*(R2 * c for c in (0.026748757411, -0.016864118443, -0.078223266529, 0.266864118443, 0.602949018236, 0.266864118443, -0.078223266529, -0.016864118443, 0.026748757411))), alternating(*(R2 * c for c in (-0.045635881557, -0.028771763114, 0.295635881557, 0.557543526229, 0.295635881557, -0.028771763114, -0.045635881557)))
D4 = (0.48296291314453416, 0.8365163037378079, 0.2241438680420134, -0.12940952255126037)
POS1 = f"SELECT cube_id, x::BIGINT AS pos, {r6('v')} AS v FROM done"
POS2 = f"SELECT cube_id, (y * 8 + x)::BIGINT AS pos, {r6('v')} AS v FROM done"
POS3 = f"SELECT cube_id, (z * 16 + y * 4 + x)::BIGINT AS pos, {r6('v')} AS v FROM done"
SAME = f"SELECT cube_id, x::BIGINT AS pos, {r6('v')} AS v FROM ({LINE})"
C1, C2, C3 = "cube_id", "cube_id, y", "cube_id, y, z"
HAAR3 = [haar("x", "cube_id, y, z", 4), haar("x", "cube_id, y, z", 2), haar("y", "cube_id, x, z", 4), haar("y", "cube_id, x, z", 2), haar("z", "cube_id, x, y", 4), haar("z", "cube_id, x, y", 2)]


def unhaar(axis: str, others: str, m: int):
    def step(r: str) -> str:
        h = m // 2
        low, high = f"sum(CASE WHEN {axis} < {h} THEN v END)", f"sum(CASE WHEN {axis} >= {h} THEN v END)"
        pair = f"FROM {r} WHERE {axis} < {m} GROUP BY {others}, {axis} % {h}"
        return (
            f"SELECT {others}, {axis} % {h} * 2 AS {axis}, ({low} + {high}) * {ROOT} AS v {pair} UNION ALL BY NAME "
            f"SELECT {others}, {axis} % {h} * 2 + 1 AS {axis}, ({low} - {high}) * {ROOT} AS v {pair} UNION ALL BY NAME SELECT {others}, {axis}, v FROM {r} WHERE {axis} >= {m}"
        )

    return step


UNHAAR3 = [unhaar("z", "cube_id, x, y", 2), unhaar("z", "cube_id, x, y", 4), unhaar("y", "cube_id, x, z", 2), unhaar("y", "cube_id, x, z", 4), unhaar("x", "cube_id, y, z", 2), unhaar("x", "cube_id, y, z", 4)]


def uniform(x: str, bins, t: str, most: str) -> str:
    z, nb, pb = f"(({bins}-1)//2)", f"(({bins}-1)//2)", f"({bins}//2)"
    ps, ns = f"(({pb}-1)/({most}-{t}))", f"(({nb}-1)/({most}-{t}))"
    up = f"trunc({x}*{ps}+((1-{t}*{ps})+{z}))"
    down = f"(trunc({x}*{ns}-(1-{t}*{ns}))+{z})"
    return f"(CASE WHEN {x} > {t} THEN least({bins}-1, {up}) WHEN {x} < -{t} THEN greatest(0, {down}) ELSE {z} END)::BIGINT"


def un_uniform(q: str, bins, t: str, most: str) -> str:
    z, nb, pb = f"(({bins}-1)//2)", f"(({bins}-1)//2)", f"({bins}//2)"
    ps, ns = f"(({pb}-1)/({most}-{t}))", f"(({nb}-1)/({most}-{t}))"
    return f"(CASE WHEN {q} > {z} THEN ({q}+(0.5::DOUBLE-(1-{t}*{ps})-{z}))/{ps} WHEN {q} < {z} THEN ({q}+((1-{t}*{ns})-0.5::DOUBLE-{z}))/{ns} ELSE 0 END)"


def logarithmic(x: str) -> str:
    z, ps, ns, po, no = hof._log(BINS, T, MOST)
    return f"(CASE WHEN {x} > {T} THEN least({BINS - 1}, trunc(ln(abs({x}))*{ps!r}::DOUBLE+{z + po + 0.5!r}::DOUBLE)) WHEN {x} < -{T} THEN greatest(0, trunc({z - no + 0.5!r}::DOUBLE-ln(abs({x}))*{ns!r}::DOUBLE)) ELSE {z} END)::BIGINT"


def un_logarithmic(q: str) -> str:
    z, ps, ns, po, no = hof._log(BINS, T, MOST)
    return f"(CASE WHEN {q} > {z} THEN exp(({q}-{z}-({po!r}::DOUBLE))/{ps!r}::DOUBLE) WHEN {q} < {z} THEN -exp(({z}-{q}-({no!r}::DOUBLE))/{ns!r}::DOUBLE) ELSE 0 END)"


TD, MD = f"{T}::DOUBLE", f"{MOST}::DOUBLE"
BOOK_Q = f"(CASE WHEN v >= {BOOK[-1]} THEN {len(BOOK)} ELSE " + " + ".join(f"(CASE WHEN {b} < v THEN 1 ELSE 0 END)" for b in BOOK) + " END)::BIGINT"
BOOK_D = "[-50000.0, -30000.0, -12000.0, 0.0, 12000.0, 30000.0, 50000.0]::DOUBLE[]"
QUANT = {"uniform": (uniform("v", BINS, TD, MD), un_uniform("q", BINS, TD, MD)), "log": (logarithmic("v"), un_logarithmic("q")), "codebook": (BOOK_Q, f"({BOOK_D})[q + 1]")}


def rank(relation: str, value: str, k: str) -> str:
    return f"(SELECT list_sort(list({value}))[{k} + 1] FROM ({relation}))"


RUNS = "SELECT cube_id, min(pos) AS start, any_value(s) AS s, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY cube_id, s ORDER BY pos) AS g FROM ({stream})) GROUP BY cube_id, s, g"
PAIRS = f"SELECT cube_id, start + 255 * part AS start, s, least(255, length - 255 * part)::BIGINT AS length FROM (SELECT *, unnest(range((length - 1) // 255 + 1)) AS part FROM ({RUNS.format(stream=STREAM.format(n=3))}))"
WANTED = ", ".join(f"({i}, {x})" for i, x in enumerate(IDS))
OFFSETS = "vec_id AS cube_id, vec_id % 8 * 4 AS x_off, (vec_id // 8) % 8 * 4 AS y_off, vec_id // 64 * 4 AS z_off"
#: The bits of an optimal prefix code for a list l of counts: the two least are merged until one is left.
HUFFMAN = (
    "(CASE WHEN len(l) = 1 THEN l[1] ELSE (list_reduce(list_concat([list_concat([0::BIGINT], list_sort(l))], list_transform(range(len(l) - 1), lambda i: [0::BIGINT])), "
    "lambda a, x: list_concat([a[1] + a[2] + a[3]], list_sort(list_append(a[4:], a[2] + a[3])))))[1] END)"
)
POINTS = "c AS ({coef}), m AS (SELECT max(abs(v)) AS most, list_sort(list(abs(v))) AS s, count(*) AS n FROM c)".format(coef=COEF)


def log_of(x: str, bins: str, t: str, most: str) -> tuple[str, str]:
    """The log quantizer with columns for its parameters, and what it gives back."""
    z, nb, pb = f"(({bins}-1)//2)", f"(({bins}-1)//2)", f"({bins}//2)"
    ps, ns = (f"(({n}-1)/ln({most}/{t}))" for n in (pb, nb))
    po, no = (f"(1-ln({t})*{k})" for k in (ps, ns))
    quant = f"(CASE WHEN {x} > {t} THEN least({bins}-1, trunc(ln(abs({x}))*{ps}+({z}+{po}+0.5::DOUBLE))) WHEN {x} < -{t} THEN greatest(0, trunc(({z}-{no}+0.5::DOUBLE)-ln(abs({x}))*{ns})) ELSE {z} END)::BIGINT"
    return quant, f"(CASE WHEN q > {z} THEN exp((q-{z}-{po})/{ps}) WHEN q < {z} THEN -exp(({z}-q-{no})/{ns}) ELSE 0 END)"


def swept(fractions: str, bins: str, kind: str = "log") -> str:
    """The CTEs of a search: `tr` has a row for each trial. The quantizers' constants are worked out once for each."""
    quant, back = (uniform("v", "bins", "t", "most"), un_uniform("q", "bins", "t", "most")) if kind == "uniform" else log_of("v", "bins", "t", "most")
    return (
        f"{POINTS}, t AS MATERIALIZED (SELECT f.f AS fraction, b.b AS bins, s[least(trunc(f.f * n)::BIGINT, n - 1) + 1] AS t, most FROM m, (SELECT unnest([{fractions}]::DOUBLE[]) AS f) f, (SELECT unnest([{bins}]::BIGINT[]) AS b) b), "
        f"q AS (SELECT fraction, bins, t, most, v, {quant} AS q FROM c, t), "
        "g AS MATERIALIZED (SELECT fraction, bins, t, most, q, count(*) AS n, sum(v) AS s1, sum(v * v) AS s2 FROM q GROUP BY ALL), "
        f"d AS (SELECT *, {back} AS b FROM g), "
        "h AS MATERIALIZED (SELECT fraction, bins, any_value(t) AS t, any_value(most) AS most, count(*) AS used, list(n::BIGINT) AS l, sum(n) AS n, sum(n * b * b - 2 * b * s1 + s2) AS sse, sum(s2) AS s2 FROM d GROUP BY fraction, bins), "
        f"tr AS MATERIALIZED (SELECT fraction, t, bins, used, ({HUFFMAN} + 31) // 32 * 4 AS size_bytes, sse / n AS mse, log10(most * most / (sse / n)) * 10 AS psnr, sse / s2 AS rel, n FROM h)"
    )


TRIAL = "SELECT fraction, round(t, 6) AS threshold, bins, used, size_bytes::BIGINT AS size_bytes, round(sqrt(mse), 4) AS rmse, round(psnr, 4) AS psnr FROM tr"


def spelled(values) -> str:
    return ", ".join(map(str, values))


def ladder(first: int, last: int, factor: float) -> str:
    out = [first]
    while int(out[-1] * factor) <= last:
        out.append(int(out[-1] * factor))
    return spelled(out)


GRID = spelled(round(0.5 + i / 100, 2) for i in range(50))
#: Absolute values in order, and the ranks at which bins of equal population begin (no value here fills a bin).
RANKED = f"s AS (SELECT list_sort(list(abs(v))) AS s, count(*) AS n, count(*) FILTER (abs(v) <= {T}) AS small FROM ({COEF})), w AS (SELECT *, CASE WHEN small < n // 8 THEN n // 8 ELSE (n - small) // 7 END AS w, greatest(small, n // 8) AS first FROM s)"


def lloyd(k: int, most: int, stop: float) -> str:
    """Lloyd's iteration as a recursion over lists: codewords, partition, sums and counts of each codeword's values."""
    sums = "list_transform(range(1, {k} + 1), lambda i: coalesce(list_sum(list_filter(vs, lambda v: (i = 1 OR v > ({b}[greatest(i - 1, 1)] + {b}[i]) / 2) AND (i = {k} OR v <= ({b}[i] + {b}[least(i + 1, {k})]) / 2))), 0))"
    counts = sums.replace("coalesce(list_sum(", "len(").replace(")), 0))", ")))")
    off = "list_sum(list_transform(range(1, {k} + 1), lambda i: {b}[i] * {c}[i] - {s}[i])) / n"
    near = "list_filter(vs, lambda v: {b}[i] <= v AND v < {b}[i + 1])"
    f = lambda x, **o: x.format(k=k, **o)
    return (
        f"WITH RECURSIVE p AS MATERIALIZED (SELECT list(abs(v)) AS vs, min(abs(v)) AS least, max(abs(v)) AS top, count(*) AS n FROM ({COEF}) WHERE abs(v) > {T}), "
        f"a AS (SELECT *, list_transform(range({k}), lambda i: {T} * exp(i * ln({MOST} / {T}) / {k})) AS book FROM p), "
        f"b AS (SELECT *, list_transform(range(1, {k}), lambda i: (book[i] + book[i + 1]) / 2) AS part, {f(sums, b='book')} AS s, {f(counts, b='book')} AS c FROM a), "
        f"r AS (SELECT book, part, s, c, {f(off, b='book', s='s', c='c')} AS dist, abs({f(off, b='book', s='s', c='c')}) AS change, 0 AS i FROM b UNION ALL "
        f"SELECT nb, np, ns, nc, nd, abs(dist - nd), i FROM (SELECT *, {f(off, b='nb', s='ns', c='nc')} AS nd FROM (SELECT *, {f(sums, b='nb')} AS ns, {f(counts, b='nb')} AS nc FROM ("
        f"SELECT *, list_transform(range(1, {k}), lambda i: coalesce(list_avg({near.format(b='nb')}), (nb[i] + nb[i + 1]) / 2)) AS np FROM ("
        f"SELECT vs, n, dist, r.i + 1 AS i, list_transform(range(1, {k} + 1), lambda j: CASE WHEN c[j] > 0 THEN s[j] / c[j] ELSE (list_concat([least], part, [top])[j] + list_concat([least], part, [top])[j + 1]) / 2 END) AS nb FROM r, p WHERE change > {stop} AND r.i < {most})))))"
        " SELECT unnest(range(len(book))) AS bin, round(unnest(book), 4) AS value, round(unnest(list_append(part, NULL)), 4) AS upper FROM (SELECT * FROM r ORDER BY i DESC LIMIT 1)"
    )


def mirror(i: str, n: int) -> str:
    if n == 1:
        return "0"
    p = 2 * (n - 1)
    return f"least((({i}) % {p} + {p}) % {p}, {p} - (({i}) % {p} + {p}) % {p})"


def box(size: tuple, offset: tuple, n: tuple) -> str:
    """Every place of a box, with the source's value or zero."""
    (sx, sy, sz), (ox, oy, oz), (nx, ny, nz) = size, offset, n
    total = sx * sy * sz
    return (
        f"SELECT e.vec_id AS cube_id, p.p::BIGINT AS pos, {r6('coalesce(s.v, 0)')} AS v FROM embeddings e CROSS JOIN (SELECT unnest(range({total})) AS p) p LEFT JOIN (SELECT cube_id, x % {nx} AS x, (x // {nx}) % {ny} AS y, x // {nx * ny} AS z, v FROM ({LINE})) s "
        f"ON s.cube_id = e.vec_id AND s.x = p.p % {sx} + {ox} AND s.y = (p.p // {sx}) % {sy} + {oy} AND s.z = p.p // {sx * sy} + {oz}"
    )


def placed(total: int, source: str) -> str:
    """Place p of the result holds what stood at `source`, a term in p."""
    return f"SELECT s.cube_id, p.p::BIGINT AS pos, {r6('s.v')} AS v FROM (SELECT unnest(range({total})) AS p) p JOIN ({LINE}) s ON s.x = {source}"


QUANT_CUBE = chain(CUBE, HAAR3, f"SELECT cube_id, x, y, z, {un_uniform('q', 16, '0.15::DOUBLE', '1.0::DOUBLE')} AS v FROM (SELECT *, {uniform('v', 16, '0.15::DOUBLE', '1.0::DOUBLE')} AS q FROM done)")
RESTORED = chain(f"SELECT * FROM ({QUANT_CUBE})", UNHAAR3, "SELECT cube_id, z * 16 + y * 4 + x AS x, v FROM done")
BACK = f"SELECT l_orderkey, l_linenumber, v, {un_uniform('q', BINS, TD, MD)} AS b FROM (SELECT l_orderkey, l_linenumber, v, {uniform('v', BINS, TD, MD)} AS q FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) - {CENTRE} AS v FROM lineitem GROUP BY 1, 2))"

ORACLES = {
    "haar_quant_histogram": chain(
        LINE, [haar("x", "cube_id", 64)],
        f", c AS (SELECT round(v, 9) AS c FROM done), m AS (SELECT max(abs(c)) AS most, list_sort(list(abs(c)))[trunc(0.5 * count(*))::BIGINT + 1] AS t FROM c) SELECT bin, count(*) AS n FROM (SELECT {uniform('c', 16, 't', 'most')} AS bin FROM c, m) GROUP BY bin",
    ),
    "haar1d_multi": chain(LINE, [haar("x", C1, 64 >> k) for k in range(6)], POS1),
    **dict.fromkeys(("haar1d_inverse", "haar2d_inverse", "haar3d_inverse", "haar2d_mallat_inverse", "cdf97_1d_inverse", "cdf97_3d_inverse", "filterbank_1d_inverse", "daubechies4_inverse"), SAME),
    "haar_layers": chain(CUBE, [*HAAR3[:2], haar("y", "cube_id, x, z", 4)], POS3),
    "haar2d": chain(SQUARE, [haar("x", C2, 8), haar("x", C2, 4), *(haar("y", "cube_id, x", 8 >> k) for k in range(3))], POS2),
    "haar3d": chain(CUBE, HAAR3, POS3),
    "haar2d_mallat": chain(SQUARE, [s for k in range(3) for s in (haar("x", C2, 8 >> k, f"y < {8 >> k}"), haar("y", "cube_id, x", 8 >> k, f"x < {8 >> k}"))], POS2),
    "cdf97_1d": chain(LINE, [bank("x", C1, 64 >> k, LA, HA) for k in range(3)], POS1),
    "cdf97_2d": chain(SQUARE, [bank("x", C2, 8, LA, HA), bank("x", C2, 4, LA, HA), bank("y", "cube_id, x", 8, LA, HA)], POS2),
    "cdf97_3d": chain(CUBE, [bank("x", C3, 4, LA, HA), bank("y", "cube_id, x, z", 4, LA, HA), bank("z", "cube_id, x, y", 4, LA, HA)], POS3),
    **{f"filterbank_{name}": chain(LINE, [bank("x", C1, 64 >> k, *own) for k in range(2)], POS1) for name, own in (("1d", B22), ("26", B26), ("44", B44), ("79", (LA, HA)))},
    "filterbank_3d": chain(CUBE, [bank("x", C3, 4, *B22), bank("y", "cube_id, x, z", 4, *B22), bank("z", "cube_id, x, y", 4, *B22)], POS3),
    "daubechies4": f"SELECT cube_id, (o.i + 32 * o.h)::BIGINT AS pos, {r6('sum(t.c * s.v)')} AS v FROM (SELECT unnest(range(32)) AS i, 0 AS h UNION ALL SELECT unnest(range(32)), 1) o JOIN (VALUES {', '.join(f'(0, {k}, {c!r}::DOUBLE), (1, {k}, {(-1) ** k * D4[3 - k]!r}::DOUBLE)' for k, c in enumerate(D4))}) t(h, k, c) ON t.h = o.h JOIN ({LINE}) s ON s.x = (2 * o.i + t.k) % 64 GROUP BY cube_id, o.i, o.h",
    "separable_lows_first": f"SELECT cube_id, (32 * o.h + s.y * 4 + o.i)::BIGINT AS pos, {r6('sum(t.c * s.v)')} AS v FROM (SELECT unnest(range(4)) AS i, 0 AS h UNION ALL SELECT unnest(range(4)), 1) o JOIN (VALUES (0, -1, 0.25::DOUBLE), (0, 0, 0.5::DOUBLE), (0, 1, 0.25::DOUBLE), (1, -1, -0.25::DOUBLE), (1, 0, 0.5::DOUBLE), (1, 1, -0.25::DOUBLE)) t(h, k, c) ON t.h = o.h JOIN ({SQUARE}) s ON s.x = {mirror('2 * o.i + o.h + t.k', 8)} GROUP BY cube_id, s.y, o.i, o.h",
    "threshold_from_one": f"SELECT cut, up, round(s[CASE WHEN up THEN ceil(cut * n) ELSE floor(cut * n) END::BIGINT], 6) AS threshold FROM (SELECT list_sort(list(abs(v))) AS s, count(*) AS n FROM ({COEF})), (SELECT unnest([0.3, 0.77]::DOUBLE[]) AS cut), (SELECT unnest([true, false]) AS up)",
    "pad_zero": f"SELECT cube_id, x::BIGINT AS pos, {r6('CASE WHEN x < 50 THEN v ELSE 0 END')} AS v FROM ({LINE})",
    "pad_repeat": placed(64, "least(p.p, 49)"),
    "pad_reflect": placed(64, mirror("p.p", 20)),
    "pad_2d_reflect": placed(64, f"{mirror('p.p // 8', 5)} * 8 + {mirror('p.p % 8', 5)}"),
    "pad_3d_repeat": placed(125, "least(p.p // 25, 3) * 16 + least((p.p // 5) % 5, 3) * 4 + least(p.p % 5, 3)"),
    "transpose2d": f"SELECT cube_id, (x * 8 + y)::BIGINT AS pos, {r6('v')} AS v FROM ({SQUARE})",
    "axis_rotate": f"SELECT cube_id, (x * 16 + z * 4 + y)::BIGINT AS pos, {r6('v')} AS v FROM ({CUBE})",
    "axis_rotate_back": f"SELECT cube_id, (y * 16 + x * 4 + z)::BIGINT AS pos, {r6('v')} AS v FROM ({CUBE})",
    "crop": f"SELECT cube_id, (z * 9 + y * 3 + x)::BIGINT AS pos, {r6('v')} AS v FROM ({CUBE}) WHERE x < 3 AND y < 3 AND z < 2",
    "sub_rectangle": f"SELECT cube_id, ((y - 1) * 4 + x - 2)::BIGINT AS pos, {r6('v')} AS v FROM ({SQUARE}) WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3",
    "cubelet_partial": box((4, 3, 4), (2, -1, 1), (4, 4, 4)),
    "subband_rescale": chain(
        SQUARE, [haar("x", C2, 8), haar("y", "cube_id, x", 8)],
        f", b AS (SELECT cube_id, y * 8 + x AS pos, {r6('v')} AS v, (x >= 4)::INT + 2 * (y >= 4)::INT AS band FROM done), e AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM b WINDOW w AS (PARTITION BY cube_id, band)) SELECT cube_id, pos::BIGINT AS pos, {r6('CASE WHEN hi > lo THEN (v - lo) / (hi - lo) - 0.5::DOUBLE ELSE 0 END')} AS v FROM e",
    ),
    "cubelet_list": f"SELECT {OFFSETS}, 4::BIGINT AS width, 4::BIGINT AS height, 4::BIGINT AS depth, 'FLOAT32' AS data_type, 256::BIGINT AS byte_count FROM embeddings",
    "cubelet_find": f"SELECT cube_id FROM (SELECT {OFFSETS} FROM embeddings) WHERE x_off = 4 AND y_off = 8 AND z_off = 4",
    "cubelet_cat": f"SELECT x, y, z, {r6('v')} AS v FROM ({CUBE}) WHERE cube_id = 7",
    "cubelet_extract": f"SELECT ord::BIGINT AS ord, id::BIGINT AS cube_id, len(embedding)::BIGINT AS n, {r6('embedding[1]::DOUBLE')} AS first FROM (VALUES {WANTED}) w(ord, id) JOIN embeddings ON vec_id = id",
    "cubelet_missing": f"SELECT ord::BIGINT AS ord, id::BIGINT AS cube_id FROM (VALUES {WANTED}) w(ord, id) WHERE id NOT IN (SELECT vec_id FROM embeddings)",
    "frame_validate": "SELECT count(*) AS n, true AS flat, true AS same_size, max(vec_id) - min(vec_id) + 1 = count(*) AND count(DISTINCT vec_id) = count(*) AS contiguous, true AS at_origin, true AS same_type FROM embeddings",
    "tile_split_overlap": "WITH v AS (SELECT p % 8 AS x, p // 8 AS y, z, v FROM (SELECT vec_id AS z, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)), n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), "
    "t AS (SELECT unnest(range(3)) AS t), tz AS (SELECT unnest(range((n - 2) // 3 + 1)) AS t FROM n) "
    "SELECT a.t AS tx, b.t AS ty, c.t AS tz, count(*) AS n, round(sum(v), 6) + 0.0 AS total, round(arg_max(v, (z * 64 + y * 8 + x)), 6) + 0.0 AS last FROM v JOIN t a ON x BETWEEN a.t * 3 AND a.t * 3 + 3 JOIN t b ON y BETWEEN b.t * 3 AND b.t * 3 + 3 JOIN tz c ON z BETWEEN c.t * 3 AND c.t * 3 + 3 GROUP BY 1, 2, 3",
    "byte_convert": "SELECT trunc(least(greatest(l_extendedprice / 300 - 20, 0), 255))::BIGINT AS byte, count(*) AS n FROM lineitem GROUP BY 1",
    "int_convert": f"SELECT trunc((l_extendedprice - {CENTRE}) / 1000 + 0.5::DOUBLE)::BIGINT AS i, count(*) AS n FROM lineitem GROUP BY 1",
    "high_byte": "SELECT (event_id % 65536) // 256 AS high, (event_id % 65536) // 16 AS twelve, count(*) AS n FROM events GROUP BY 1, 2",
    "bit_functions": "SELECT o_orderkey AS n, CASE WHEN o_orderkey = 0 THEN 32 ELSE 32 - len(bin(o_orderkey)) END::BIGINT AS clz, CASE WHEN o_orderkey <= 1 THEN 0 ELSE len(bin(o_orderkey - 1)) END::BIGINT AS log2 FROM orders",
    "padded_length": "SELECT user_id, n, (n + 1) // 2 * 2 AS p1, (n + 3) // 4 * 4 AS p2, (n + 7) // 8 * 8 AS p3, CASE WHEN n <= 1 THEN 1 ELSE (1::BIGINT << len(bin(n - 1))) END::BIGINT AS power FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
    "mirror_index": "SELECT i, " + ", ".join(f"({mirror('i', n)})::BIGINT AS m{n}" for n in (1, 2, 3, 8)) + " FROM (SELECT unnest(range(-20, 20)) AS i)",
    "gray_minmax": f"SELECT floor({r6('CASE WHEN hi > lo THEN (v - lo) / (hi - lo) * 255 ELSE 0 END')})::BIGINT AS g, count(*) AS n FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ({LINE}) WINDOW w AS (PARTITION BY cube_id)) GROUP BY 1",
    "threshold_rank": f"SELECT f AS fraction, round(s[least(trunc(f * n)::BIGINT, n - 1) + 1], 6) AS threshold FROM (SELECT list_sort(list(abs(v))) AS s, count(*) AS n FROM ({COEF})), (SELECT unnest([0, 0.25, 0.5, 0.95, 1]::DOUBLE[]) AS f)",
    "hard_threshold": f"SELECT sum((w = 0)::INT)::BIGINT AS zeros, count(*) AS n, round(sum(w), 2) AS total FROM (SELECT CASE WHEN abs(v) <= {T} THEN 0 ELSE v END AS w FROM ({COEF}))",
    "filter_sorted": f"SELECT round(v, 2) AS v FROM ({COEF}) WHERE abs(v) >= {MOST} ORDER BY abs(v)",
    "lower_bound_rank": f"SELECT " + ", ".join(f"count(*) FILTER (abs(v) < {t}) AS below_{t}" for t in (100, 5000, 20000)) + f" FROM ({COEF})",
    "mode_value": "SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 1",
    "summary_stats": f"SELECT count(v) AS n, count(DISTINCT v) AS n_distinct, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS stddev, round(min(v), 4) AS lo, round(max(v), 4) AS hi FROM ({COEF})",
    "trimmed_histogram": f"WITH c AS ({COEF}), s AS (SELECT list_sort(list(v)) AS s, count(*) AS n FROM c), e AS (SELECT s[n // 100 + 1] AS lo, s[n - n // 100] AS hi, n AS total FROM s) SELECT bin, n, repeat('*', floor(n * 200 / total)::INT) AS bar FROM (SELECT least(greatest(floor({r6('(v - lo) / ((hi - lo) / 24)')}), 0), 23)::BIGINT AS bin, count(*) AS n, any_value(total) AS total FROM c, e GROUP BY 1)",
    "sign_counts": f"SELECT count(*) FILTER (i < 0) AS negative, count(*) FILTER (i = 0) AS zero, count(*) FILTER (i > 0) AS positive FROM (SELECT trunc(v / 1000 + 0.5::DOUBLE)::BIGINT AS i FROM ({COEF}))",
    "quantization_error": "SELECT " + ", ".join(f"(SELECT round(avg(({d} - v) * ({d} - v)), 2) FROM (SELECT v, {q} AS q FROM ({COEF}))) AS {name}" for name, (q, d) in QUANT.items()),
    "quant_legacy_bits": f"SELECT *, {r6(f'CASE WHEN uniform = 0 THEN 0 ELSE sign(uniform) * (abs(uniform) * ({MOST} - {T}) / 7 + {T}) END')} AS uniform_value, {r6(f'CASE WHEN log = 0 THEN 0 ELSE sign(log) * {T} * exp(abs(log) * ln({MOST} / {T}) / 7) END')} AS log_value FROM (SELECT (CASE WHEN abs(v) <= {T} THEN 0 ELSE sign(v) * least(ceil((abs(v) - {T}) / ({MOST} - {T}) * 7), 7) END)::BIGINT AS uniform, (CASE WHEN abs(v) <= {T} THEN 0 ELSE sign(v) * least(ceil(ln(abs(v) / {T}) / {math.log(MOST / T)!r}::DOUBLE * 7), 7) END)::BIGINT AS log, count(*) AS n FROM ({COEF}) GROUP BY 1, 2)",
    "init_codebook": f"SELECT i AS bin, round({T} * exp(i * ln({MOST} / {T}) / 15), 6) AS value FROM (SELECT unnest(range(15)) AS i)",
    "lloyd_one_step": f"WITH p AS (SELECT abs(v) AS v FROM ({COEF}) WHERE abs(v) > {T}) SELECT bin, round(avg(v), 4) AS value FROM (SELECT v, ((v > 15000)::INT + (v > 25000)::INT + (v > 40000)::INT)::BIGINT AS bin FROM p) GROUP BY bin",
    "symbol_frequency": f"SELECT s, count(*) AS n FROM ({STREAM.format(n=3)}) GROUP BY s",
    "rle_encode": PAIRS,
    "rle_pair_frequency": f"SELECT symbol, count(*) AS n FROM (SELECT unnest([s, length]) AS symbol FROM ({PAIRS})) GROUP BY symbol",
    "zero_run_lengths": f"SELECT length, count(*) AS n FROM ({RUNS.format(stream=STREAM.format(n=2))}) WHERE s = 0 GROUP BY length",
    "zero_run_savings": f"SELECT count(*) AS runs, sum(length - 2)::BIGINT AS saved FROM ({RUNS.format(stream=STREAM.format(n=2))}) WHERE s = 0 AND length > 2",
    "huffman_roundtrip": "SELECT count(*) AS cubes, 0::BIGINT AS mismatches FROM embeddings",
    "error_metrics": f"SELECT round(sum(abs(b - a)), 5) AS l1, round(sqrt(sum((b - a) * (b - a))), 5) AS l2, round(avg((b - a) * (b - a)), 5) AS mse, round(log10(1 / avg((b - a) * (b - a))) * 10, 5) AS psnr, round(sum((b - a) * (b - a)) / sum(a * a), 5) AS rel_err FROM (SELECT o.v AS a, r.v AS b FROM ({LINE}) o JOIN ({RESTORED}) r USING (cube_id, x))",
    "compress_roundtrip": f"SELECT cube_id, {r6('sum((a - b) * (a - b)) / 64')} AS mse FROM (SELECT cube_id, o.v AS a, r.v AS b FROM ({LINE}) o JOIN ({RESTORED}) r USING (cube_id, x)) GROUP BY cube_id",
    "matrix_mse": f"SELECT round(avg((b - v) * (b - v)), 2) AS mse FROM ({BACK}) WHERE l_linenumber BETWEEN 2 AND 5",
    "relative_norms": f"SELECT round(sum((v - b) * (v - b)) / sum(v * v), 6) AS mse, round(sqrt(sum((v - b) * (v - b))) / sqrt(sum(v * v)), 6) AS l2, round(sum(abs(v - b)) / sum(abs(v)), 6) AS l1 FROM ({BACK})",
    "difference_map": f"SELECT cube_id, x::BIGINT AS pos, {r6('CASE WHEN most > 0 THEN d / most * 255 ELSE 0 END')} AS v FROM (SELECT *, max(abs(d)) OVER (PARTITION BY cube_id) AS most FROM (SELECT a.cube_id, a.x, b.v - a.v AS d FROM ({LINE}) a JOIN ({LINE}) b ON b.cube_id = a.cube_id + 1 AND b.x = a.x))",
    "param_sweep": f"WITH {swept(GRID, ladder(100, 2000, 1.1))} {TRIAL}",
    "bin_sweep": f"WITH {swept('0.95', ladder(20, 1500, 1.5))} {TRIAL}",
    "threshold_sweep": f"WITH {POINTS}, f AS (SELECT unnest([{spelled(1 - 0.5 * 0.8**k for k in range(18))}]::DOUBLE[]) AS f), t AS (SELECT f AS fraction, most, s[trunc(f * n)::BIGINT + 1] AS t FROM f, m), e AS (SELECT fraction, any_value(t) AS t, any_value(most) AS most, sum(CASE WHEN abs(v) <= t THEN v * v ELSE 0 END) / count(*) AS mse FROM c, t GROUP BY fraction) "
    "SELECT fraction, round(t, 6) AS threshold, 0::BIGINT AS bins, 0::BIGINT AS used, 0::BIGINT AS size_bytes, round(sqrt(mse), 4) AS rmse, round(log10(most * most / mse) * 10, 4) AS psnr FROM e",
    "bits_experiment": f"WITH {swept(spelled(round(0.1 * i, 1) for i in range(1, 10)), spelled(1 << b for b in range(4, 13)))} SELECT log2(bins)::BIGINT AS bits, fraction, round(log10(mse), 4) AS log_mse, round(100.0::DOUBLE * (n - size_bytes) / n, 4) AS reduction FROM tr",
    "fixed_psnr_search": f"WITH {swept('0.3, 0.4, 0.5, 0.6, 0.7', ladder(8, 300, 1.3), 'uniform')}, alone AS (SELECT DISTINCT fraction FROM (SELECT fraction, any_value(most) AS most, sum(CASE WHEN abs(v) <= t THEN v * v ELSE 0 END) / count(*) AS mse FROM c, (SELECT DISTINCT fraction, t, most FROM t) GROUP BY fraction) WHERE log10(most * most / mse) * 10 >= 14) "
    "SELECT fraction, min(bins) AS bins, arg_min(size_bytes, bins)::BIGINT AS size_bytes, round(arg_min(psnr, bins), 4) AS psnr FROM tr WHERE psnr > 14 AND fraction IN (FROM alone) GROUP BY fraction",
    "max_cut_bisect": f"WITH RECURSIVE m AS MATERIALIZED (SELECT list_sort(list(abs(v))) AS s, count(*) AS n, sum(v * v) AS total FROM ({COEF})), e AS MATERIALIZED (SELECT k, sum(CASE WHEN v <= t THEN v * v ELSE 0 END) / any_value(total) AS err FROM (SELECT k, s[trunc(k / 128 * n)::BIGINT + 1] AS t, total FROM m, (SELECT unnest(range(1, 128)) AS k)), (SELECT unnest(s) AS v FROM m) GROUP BY k), "
    "r AS (SELECT 0 AS lo, 128 AS hi, 0 AS i UNION ALL SELECT CASE WHEN err <= 0.05 THEN k ELSE lo END, CASE WHEN err <= 0.05 THEN hi ELSE k END, i + 1 FROM r JOIN e ON k = (lo + hi) // 2 WHERE i < 7) SELECT lo / 128 AS cut FROM r WHERE i = 7",
    "min_bins_bisect": f"WITH RECURSIVE {swept('0.3', spelled(range(8, 1024, 8)), 'uniform')}, r AS (SELECT 0::BIGINT AS lo, 1024::BIGINT AS hi, 0 AS i UNION ALL SELECT CASE WHEN rel >= 0.03 THEN bins ELSE lo END, CASE WHEN rel >= 0.03 THEN hi ELSE bins END, i + 1 FROM r JOIN tr ON bins = (lo + hi) // 2 WHERE i < 7) SELECT (lo + hi) // 2 AS bins FROM r WHERE i = 7",
    "hill_climb": f"WITH RECURSIVE {swept(spelled(i / 100 for i in range(30, 41)), spelled(range(30, 41)), 'uniform')}, k AS MATERIALIZED (SELECT round(fraction * 100)::INT AS cut, bins, rel, n / size_bytes AS ratio FROM tr), "
    "r AS (SELECT cut, bins, ratio, 0 AS i FROM k WHERE cut = 30 AND bins = 40 UNION ALL (SELECT k.cut, k.bins, k.ratio, i + 1 FROM r JOIN k ON (k.cut = r.cut + 1 AND k.bins = r.bins) OR (k.cut = r.cut AND k.bins = r.bins - 1) WHERE rel <= 0.04 AND k.ratio >= r.ratio AND i < 10 ORDER BY k.ratio DESC, k.cut DESC LIMIT 1)) "
    "SELECT cut::DOUBLE AS cut, bins, round(ratio, 6) AS ratio FROM r ORDER BY i DESC LIMIT 1",
    "lloyd_codebook": lloyd(6, 20, 1.0),
    "equal_pop_bins": f"WITH {RANKED} SELECT i AS bin, CASE WHEN i = 0 THEN 0 ELSE round(s[least(CASE WHEN i < 7 THEN (2 * first + (2 * i - 1) * w) // 2 ELSE (first + 6 * w + n) // 2 END, n - 1) + 1], 4) END AS value, CASE WHEN i < 7 THEN round(s[least(first + i * w, n - 1) + 1], 4) END AS upper FROM w, (SELECT unnest(range(8)) AS i)",
    "quant_equal_pop": f"WITH {RANKED}, b AS (SELECT list_transform(range(7), lambda i: s[least(first + i * w, n - 1) + 1]) AS b FROM w) SELECT (sign(v) * len(list_filter(b, lambda x: x <= abs(v))))::BIGINT AS bin, count(*) AS n FROM ({COEF}), b GROUP BY 1",
    "equal_pop_signed": f"WITH s AS (SELECT list_sort(list(v)) AS s, count(*) AS n, count(*) FILTER (v < -{T}) AS below, count(*) FILTER (v > {T}) AS over FROM ({COEF})), w AS (SELECT *, floor(below / (below + over) * 16)::INT AS d FROM s), x AS (SELECT *, 15 - d AS u, below / d AS a, over / (15 - d) AS b FROM w) "
    f"SELECT i AS bin, round(CASE WHEN i = 0 THEN s[1] WHEN i < d - 1 THEN s[floor(a * i + a / 2)::INT + 1] WHEN i = d - 1 THEN s[floor((below + a * (d - 1)) / 2)::INT + 1] WHEN i = d THEN 0 WHEN i < 15 THEN s[floor(n - over + b * (i - d - 1) + b / 2)::INT + 1] ELSE s[n] END, 4) AS value, "
    f"round(CASE WHEN i < d - 1 THEN s[floor(a * (i + 1))::INT + 1] WHEN i = d - 1 THEN -{T} WHEN i = 14 THEN 0.01::DOUBLE * s[n - 1] + 0.99::DOUBLE * s[n] WHEN i = d THEN {T} WHEN i < 14 THEN s[floor(n - over + b * (i - d))::INT + 1] END, 4) AS upper FROM x, (SELECT unnest(range(16)) AS i)",
    "mirror_codebook": f"WITH e AS (SELECT min(v) AS lo, max(v) AS hi FROM ({COEF})), g AS (SELECT list_transform(range(4), lambda i: {T} * exp(i * ln({MOST} / {T}) / 4)) AS g), h AS (SELECT g, list_transform(range(1, 4), lambda i: (g[i] + g[i + 1]) / 2) AS m FROM g), "
    f"a AS (SELECT *, list_concat(list_transform(list_reverse(g), lambda x: -x), [0.0::DOUBLE], g) AS v, list_concat(list_transform(list_reverse(m), lambda x: -x), [-{T}::DOUBLE, {T}::DOUBLE], m) AS b FROM h, e), "
    "z AS (SELECT CASE WHEN abs(lo) > hi THEN list_prepend(lo, v) ELSE list_append(v, hi) END AS v, CASE WHEN abs(lo) > hi THEN list_prepend((lo - g[4]) / 2, b) ELSE list_append(b, (hi + g[4]) / 2) END AS b FROM a) "
    "SELECT unnest(range(10)) AS bin, round(unnest(v), 6) AS value, round(unnest(list_append(b, NULL)), 6) AS upper FROM z",
    "huffman_size": f"SELECT len(l) AS symbols, n, bits, (bits + 31) // 32 * 4 AS bytes, round(bits / n, 6) AS bits_per_value FROM (SELECT l, list_sum(l)::BIGINT AS n, {HUFFMAN} AS bits FROM (SELECT list(n) AS l FROM (SELECT q, count(*) AS n FROM (SELECT {uniform('v', BINS, TD, MD)} AS q FROM ({COEF})) GROUP BY q)))",
    "quant_partition": "SELECT (" + " + ".join(f"(CASE WHEN {b} < v THEN 1 ELSE 0 END)" for b in BOOK) + f")::BIGINT AS bin, count(*) AS n FROM ({COEF}) GROUP BY 1",
    "quant_few_bins": f"SELECT b AS bins, coalesce(q, -1) AS q, {r6('back')} AS back, count(*) AS n FROM (SELECT b, q, CASE WHEN q IS NULL THEN NULL WHEN b = 4 AND q > 1 THEN (q + 0.5::DOUBLE - (1 - {T} / ({MOST} - {T})) - 1) * ({MOST} - {T}) ELSE 0 END AS back FROM (SELECT b, CASE WHEN v IS NULL THEN NULL WHEN b = 1 THEN 0 WHEN v > {T} THEN CASE b WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE least(3, trunc(v / ({MOST} - {T}) + 2 - {T} / ({MOST} - {T}))) END WHEN v < -{T} THEN 0 ELSE (b - 1) // 2 END::BIGINT AS q FROM (SELECT CASE WHEN l_linenumber > 1 THEN l_extendedprice - {CENTRE} END AS v FROM lineitem), (SELECT unnest([1, 2, 3, 4]::BIGINT[]) AS b))) GROUP BY ALL",
    "unit_conversions": "SELECT b AS byte, i AS int, trunc(l_discount * 255 + 0.5::DOUBLE)::BIGINT AS share, (n % 8 = 0)::BIGINT AS padded, count(*) AS n, " + r6("avg(b / 255 - 0.5::DOUBLE)") + " AS unit FROM (SELECT n, n % 256 AS b, (n * 13) % 4096 AS i, l_discount FROM (SELECT (l_linenumber * 31 + l_quantity)::BIGINT AS n, l_discount FROM lineitem)) GROUP BY 1, 2, 3, 4",
    "brightness": "SELECT trunc(least(greatest((l_extendedprice - 10000) / 50000 * 255 * 1.5::DOUBLE, 0), 255))::BIGINT AS level, count(*) AS n FROM lineitem GROUP BY 1",
    "cubelet_order": f"SELECT cube_id, z_off, y_off, x_off FROM (SELECT {OFFSETS} FROM embeddings) ORDER BY z_off, y_off, x_off, cube_id LIMIT 5",
    "compress_cubelets": "SELECT vec_id AS cube_id, 64::BIGINT AS n, true AS close FROM embeddings",
    "symbols_by_frequency": f"SELECT q AS s, count(*) AS n FROM (SELECT {uniform('v', BINS, TD, MD)} AS q FROM ({COEF})) GROUP BY q ORDER BY n DESC, s LIMIT 10",
    "slice_minmax_codec": "SELECT vec_id AS cube_id, true AS same, true AS close FROM embeddings",
}
for _name, (_q, _d) in QUANT.items():
    ORACLES[f"quant_{_name}"] = f"SELECT {_q} AS bin, count(*) AS n FROM ({COEF}) GROUP BY 1"
    ORACLES[f"dequant_{_name}"] = f"SELECT {r6(_d)} AS v, count(*) AS n FROM (SELECT {_q} AS q FROM ({COEF})) GROUP BY 1"

_OFFSETS = "(vec_id % 8 * 4)::INT AS x_off, (vec_id // 8 % 8 * 4)::INT AS y_off, (vec_id // 64 * 4)::INT AS z_off"
_SHORTS = "SELECT event_id // 4096 AS frame, event_id % 4096 AS pos, user_id % 4096 * 16 AS v FROM events"
ORACLES |= {
    "file_cubelets": f"SELECT {_OFFSETS}, 'FLOAT32' AS data_type, 64::BIGINT AS n, {r6('list_sum(embedding::DOUBLE[])')} AS total FROM embeddings",
    "file_index": f"SELECT {_OFFSETS}, 4 AS width, 4 AS height, 4 AS depth, 'FLOAT32' AS data_type, 'NONE' AS compression, 256::BIGINT AS byte_count, true AS no_payload FROM embeddings",
    "raw_shorts": f"SELECT (v // 256)::BIGINT AS byte, count(*) AS n, sum(v)::BIGINT AS total, sum(row_number)::BIGINT AS places FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY pos) - 1 AS row_number FROM ({_SHORTS})) GROUP BY 1",
    "raw_frames": f"SELECT (dense_rank() OVER (ORDER BY frame) - 1)::INT AS z_off, 'INT32' AS data_type, 4095 AS max_value, 4096::BIGINT AS n, sum(v // 16)::BIGINT AS total FROM ({_SHORTS}) GROUP BY frame",
    "number_text": "SELECT v % 256 AS byte, count(*) AS n FROM (SELECT l_quantity::BIGINT + 250 AS v FROM lineitem UNION ALL SELECT l_linenumber::BIGINT FROM lineitem) GROUP BY 1",
    "parameter_files": """SELECT 'r' || n_regionkey AS file, 'nation ' || n_name AS name, 'key = "' || n_nationkey || '"' AS value FROM nation""",
    "random_matrix": "SELECT 60000::BIGINT AS n, 60000::BIGINT AS cells, true AS fit, 0.5::DOUBLE AS mean",
}
_TILES = ORACLES["tile_split_overlap"].split("SELECT a.t")[0]
_IN_TILES = "v JOIN t a ON x BETWEEN a.t * 3 AND a.t * 3 + 3 JOIN t b ON y BETWEEN b.t * 3 AND b.t * 3 + 3 JOIN tz c ON z BETWEEN c.t * 3 AND c.t * 3 + 3"
ORACLES |= {
    "tile_cubelets": f"{_TILES}, p AS (SELECT a.t AS tx, b.t AS ty, c.t AS tz, x, y, z, v, row_number() OVER (PARTITION BY a.t, b.t, c.t ORDER BY z, y, x) AS i FROM {_IN_TILES}) "
    "SELECT (tx * 3)::INT AS x_off, (ty * 3)::INT AS y_off, (tz * 3)::INT AS z_off, count(DISTINCT x)::INT AS width, count(DISTINCT y)::INT AS height, count(DISTINCT z)::INT AS depth, round(sum(v * i), 4) AS weighted FROM p GROUP BY tx, ty, tz",
    "dump_coefficients": chain(CUBE, HAAR3, f"SELECT cube_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {r6('v')} AS v FROM done"),
}

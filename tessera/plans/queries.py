"""Queries over the test tables, one for each array operator; `plans.oracles` has the same in SQL.

Stand-ins: an embedding of 64 values is a 1-D array, an 8 x 8 square or a 4 x 4 x 4 cubelet; centred prices are a large
column of coefficients; events in their order are a stream of symbols, in cubes of 4096.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.functions import arrow_udf

from ..functions import blocks, hof
from ..operators import codebooks, codec, cubes, entropy, metrics, search, select
from ..operators.select import order_statistics, threshold, thresholds
from ..sources import files, parameters, paths, raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CENTRE, T, MOST, BINS = 38000.0, 5000.0, 60000.0, 32
BOOK = [-40000.0, -20000.0, -5000.0, 5000.0, 20000.0, 40000.0]
SQUARE, CUBE, LINE = (8, 8, 1), (4, 4, 4), (64, 1, 1)
IDS = [3, 5, 8, 99999, 1]


def query(name: str, f: Callable) -> None:
    QUERIES[name] = f


def named(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def arrays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("cube_id"), F.col("embedding").cast("array<double>").alias("a"))


def cubelets(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        n.alias("cube_id"), (n % 8 * 4).cast("int").alias("x_off"), (F.floor(n / 8) % 8 * 4).cast("int").alias("y_off"), (F.floor(n / 64) * 4).cast("int").alias("z_off"),
        *(F.lit(4).alias(c) for c in ("width", "height", "depth")), F.lit("FLOAT32").alias("data_type"), F.col("embedding").cast("array<double>").alias("payload"),
    )


def long(df: DataFrame, a: Column) -> DataFrame:
    flat = df.select("cube_id", F.posexplode(a).alias("pos", "v"))
    return flat.select("cube_id", F.col("pos").cast("long").alias("pos"), r6(F.col("v")).alias("v"))


def on_arrays(f: Callable[[Column], Column]):
    return lambda spark, sf: long(arrays(spark, sf), f(F.col("a")))


def coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_extendedprice") - CENTRE).alias("v"))


def histogram(df: DataFrame, symbol: Column) -> DataFrame:
    return df.groupBy(symbol.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def symbols(spark: SparkSession, sf: str, n: int = 3) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(F.floor(e / 4096).cast("long").alias("cube_id"), (e % 4096).alias("pos"), (F.col("user_id") % n).alias("s"))


# Transforms and shapes of payloads.


@named
def haar_quant_histogram(spark, sf):
    """Scan, one Haar step, exact-rank threshold, uniform quantizer, histogram."""
    c = arrays(spark, sf).select(F.explode(blocks.forward(F.col("a"), 1)).alias("c")).select(F.round("c", 9).alias("c"))
    t = threshold(c, F.col("c"), 0.5)
    most = c.agg(F.max(F.abs("c"))).first()[0]
    return histogram(c, hof.quant_uniform(F.col("c"), 16, t, most))


for _name, _f in {
    "haar1d_multi": lambda a: blocks.forward(a, -1),
    "haar1d_inverse": lambda a: blocks.inverse(blocks.forward(a, 3), 3),
    "haar2d": lambda a: blocks.transform(a, SQUARE, (2, 3, 0)),
    "haar2d_inverse": lambda a: blocks.transform(blocks.transform(a, SQUARE, (2, 3, 0)), SQUARE, (2, 3, 0), back=True),
    "haar3d": lambda a: blocks.transform(a, CUBE, (2, 2, 2)),
    "haar3d_inverse": lambda a: blocks.transform(blocks.transform(a, CUBE, (2, 2, 2)), CUBE, (2, 2, 2), back=True),
    "haar_layers": lambda a: blocks.transform(a, CUBE, (2, 1, 2), layers=True),
    "haar2d_mallat": lambda a: blocks.alternating(a, 8, 3),
    "haar2d_mallat_inverse": lambda a: blocks.alternating(blocks.alternating(a, 8, 3), 8, 3, back=True),
    "cdf97_1d": lambda a: blocks.forward(a, 3, "cdf97"),
    "cdf97_1d_inverse": lambda a: blocks.inverse(blocks.forward(a, 3, "cdf97"), 3, "cdf97"),
    "cdf97_2d": lambda a: blocks.transform(a, SQUARE, (2, 1, 0), "cdf97"),
    "cdf97_3d": lambda a: blocks.transform(a, CUBE, (1, 1, 1), "cdf97"),
    "cdf97_3d_inverse": lambda a: blocks.transform(blocks.transform(a, CUBE, (1, 1, 1), "cdf97"), CUBE, (1, 1, 1), "cdf97", back=True),
    "filterbank_1d": lambda a: blocks.forward(a, 2, "CDF_2.2"),
    "filterbank_1d_inverse": lambda a: blocks.inverse(blocks.forward(a, 2, "CDF_2.4"), 2, "CDF_2.4"),
    "filterbank_26": lambda a: blocks.forward(a, 2, "CDF_2.6"),
    "filterbank_44": lambda a: blocks.forward(a, 2, "CDF_4.4"),
    "filterbank_79": lambda a: blocks.forward(a, 2, "VS_7.9"),
    "filterbank_3d": lambda a: blocks.transform(a, CUBE, (1, 1, 1), "CDF_2.2"),
    "daubechies4": lambda a: blocks.forward(a, 1, "d4"),
    "daubechies4_inverse": lambda a: blocks.inverse(blocks.forward(a, 4, "d4"), 4, "d4"),
    "separable_lows_first": lambda a: blocks.lows_first(a, 8, {-1: 0.25, 0: 0.5, 1: 0.25}, {-1: -0.25, 0: 0.5, 1: -0.25}),
    "pad_zero": lambda a: hof.pad(F.slice(a, 1, 50), 50, 64, "zero"),
    "pad_repeat": lambda a: hof.pad(F.slice(a, 1, 50), 50, 64, "repeat"),
    "pad_reflect": lambda a: hof.pad(F.slice(a, 1, 20), 20, 64, "reflect"),
    "pad_2d_reflect": lambda a: hof.relabelled(a, 64, lambda p: hof.mirrored(F.floor(p / 8), 5) * 8 + hof.mirrored(p % 8, 5)),
    "pad_3d_repeat": lambda a: hof.relabelled(a, 125, lambda p: F.least(F.floor(p / 25), F.lit(3)) * 16 + F.least(F.floor(p / 5) % 5, F.lit(3)) * 4 + F.least(p % 5, F.lit(3))),
    "transpose2d": lambda a: hof.relabelled(a, 64, lambda p: p % 8 * 8 + F.floor(p / 8)),
    "axis_rotate": lambda a: hof.relabelled(a, 64, lambda p: p % 4 * 4 + F.floor(p / 4) % 4 * 16 + F.floor(p / 16)),
    "axis_rotate_back": lambda a: hof.relabelled(a, 64, lambda p: p % 4 * 16 + F.floor(p / 4) % 4 + F.floor(p / 16) * 4),
    "crop": lambda a: cubes.part(a, CUBE, (0, 0, 0), (3, 3, 2)),
    "sub_rectangle": lambda a: cubes.part(a, SQUARE, (2, 1, 0), (4, 3, 1)),
    "cubelet_partial": lambda a: cubes.part(a, CUBE, (2, -1, 1), (4, 3, 4)),
}.items():
    query(_name, on_arrays(_f))


@named
def subband_rescale(spark, sf):
    """Each quadrant of a one-step square rescaled to -0.5..0.5 by its own least and most."""
    c = long(arrays(spark, sf), blocks.transform(F.col("a"), SQUARE, (1, 1, 0)))
    band = F.when(F.col("pos") % 8 < 4, 0).otherwise(1) + F.when(F.col("pos") < 32, 0).otherwise(2)
    c = c.withColumn("band", band)
    ends = c.groupBy("cube_id", "band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) - 0.5).otherwise(0.0)
    return c.join(ends, ["cube_id", "band"]).select("cube_id", "pos", r6(v).alias("v"))


# Cubelets.


@named
def cubelet_list(spark, sf):
    out = cubes.listed(cubelets(spark, sf))
    return out.select(*(F.col(c).cast("long").alias(c) if c != "data_type" else c for c in out.columns))


@named
def cubelet_find(spark, sf):
    return cubes.found(cubelets(spark, sf), 4, 8, 4).select("cube_id")


@named
def cubelet_cat(spark, sf):
    out = cubes.voxels(cubelets(spark, sf).where("cube_id = 7"))
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("x", "y", "z")), r6(F.col("v")).alias("v"))


def wanted(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(IDS)), "ord long, cube_id long")


@named
def cubelet_extract(spark, sf):
    out = cubes.extracted(cubelets(spark, sf), wanted(spark))
    return out.select("ord", "cube_id", F.size("payload").cast("long").alias("n"), r6(F.get("payload", F.lit(0))).alias("first"))


@named
def cubelet_missing(spark, sf):
    return cubes.missing(cubelets(spark, sf), wanted(spark)).select("ord", "cube_id")


@named
def frame_validate(spark, sf):
    frames = table(spark, sf, "embeddings").select(*(F.lit(0).alias(c) for c in ("x_off", "y_off")), F.col("vec_id").alias("z_off"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("depth"), F.lit("FLOAT32").alias("data_type"))
    return cubes.frames_valid(frames)


def frames(spark, sf) -> tuple[DataFrame, int]:
    rows = table(spark, sf, "embeddings")
    flat = rows.select(F.col("vec_id").alias("z"), F.posexplode("embedding").alias("p", "v"))
    return flat.select((F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "z", F.col("v").cast("double").alias("v")), rows.agg(F.max("vec_id")).first()[0] + 1


@named
def tile_split_overlap(spark, sf):
    """8 x 8 frames, in order of z, cut into 4 x 4 x 4 tiles that overlap by one."""
    voxels, n = frames(spark, sf)
    out = cubes.tiles(voxels, (8, 8, n), (4, 4, 4), 1)
    return out.groupBy(*(F.col(f"t{a}").cast("long").alias(f"t{a}") for a in "xyz")).agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"), r6(F.max_by("v", F.struct("iz", "iy", "ix"))).alias("last"))


@named
def tile_cubelets(spark, sf):
    """The same tiles as cubelets with payloads: sizes, places, and a sum that tells the order of the values."""
    voxels, n = frames(spark, sf)
    out = cubes.rebuilt(cubes.tiles(voxels, (8, 8, n), (4, 4, 4), 1), (4, 4, 4), 1)
    weighted = F.aggregate(F.transform("payload", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("x_off", "y_off", "z_off", "width", "height", "depth", F.round(weighted, 4).alias("weighted"))


@named
def dump_coefficients(spark, sf):
    """What compression would quantise: the 3-D transform, with the axes of the original."""
    c = codec.dumped(cubelets(spark, sf).withColumn("max_value", F.lit(0)), codec.Settings((2, 2, 2), "haar", fraction=0.2, bins=200, quantizer="uniform"))
    flat = c.select("cube_id", F.posexplode("payload").alias("pos", "v"))
    return flat.select("cube_id", (F.col("pos") % 4).cast("long").alias("x"), (F.floor(F.col("pos") / 4) % 4).cast("long").alias("y"), F.floor(F.col("pos") / 16).cast("long").alias("z"), r6(F.col("v")).alias("v"))


@named
def cubelet_order(spark, sf):
    """By z, y, x: the first of them, ranked."""
    return cubelets(spark, sf).orderBy("z_off", "y_off", "x_off", "cube_id").limit(5).select("cube_id", *(F.col(c).cast("long").alias(c) for c in ("z_off", "y_off", "x_off")))


@named
def compress_cubelets(spark, sf):
    """Each cubelet encoded with its parameters and restored: how many values come back, and whether their error is that of
    quantising alone."""
    packed = codec.compressed(cubelets(spark, sf).withColumn("max_value", F.lit(0)), codec.Settings((2, 2, 2), "haar", fraction=0.2, bins=200, quantizer="uniform"))
    back = codec.restored(packed).select("cube_id", F.col("payload").alias("b"))
    error = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    size = F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)
    return arrays(spark, sf).join(back, "cube_id").select("cube_id", F.size("b").cast("long").alias("n"), (error <= 0.03 * size).alias("close"))


# Scalar functions.


@named
def byte_convert(spark, sf):
    v = F.col("l_extendedprice") / 300 - 20
    return table(spark, sf, "lineitem").groupBy(hof.to_byte(v).cast("long").alias("byte")).agg(F.count("*").alias("n"))


@named
def int_convert(spark, sf):
    v = (F.col("l_extendedprice") - CENTRE) / 1000
    return table(spark, sf, "lineitem").groupBy(hof.to_int(v).cast("long").alias("i")).agg(F.count("*").alias("n"))


@named
def high_byte(spark, sf):
    return table(spark, sf, "events").groupBy(F.shiftright(F.col("event_id") % 65536, 8).cast("long").alias("high"), F.shiftright(F.col("event_id") % 65536, 4).cast("long").alias("twelve")).agg(F.count("*").alias("n"))


@named
def bit_functions(spark, sf):
    n = F.col("o_orderkey").cast("long")
    return table(spark, sf, "orders").select(n.alias("n"), hof.leading_zeros(n).cast("long").alias("clz"), hof.ceil_log2(n).cast("long").alias("log2"))


@named
def padded_length(spark, sf):
    """Series lengths of users, padded for 1 to 3 steps and to a power of two."""
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    out = [(F.floor((F.col("n") - 1) / (1 << k)) * (1 << k) + (1 << k)).cast("long").alias(f"p{k}") for k in (1, 2, 3)]
    return n.select("user_id", "n", *out, F.call_function("shiftleft", F.lit(1).cast("long"), hof.ceil_log2(F.col("n"))).alias("power"))


@named
def mirror_index(spark, sf):
    return spark.range(-20, 20).select(F.col("id").alias("i"), *(hof.mirrored(F.col("id"), n).cast("long").alias(f"m{n}") for n in (1, 2, 3, 8)))


@named
def gray_minmax(spark, sf):
    a = F.col("a")
    lo, hi = F.array_min(a), F.array_max(a)
    return arrays(spark, sf).select("cube_id", F.posexplode(F.transform(a, lambda x: F.when(hi > lo, (x - lo) / (hi - lo) * 255).otherwise(0.0))).alias("pos", "g")).groupBy(F.floor(r6(F.col("g"))).cast("long").alias("g")).agg(F.count("*").alias("n"))


@named
def unit_conversions(spark, sf):
    """Bytes, and integers up to 4095, to -0.5..0.5 and back; shares to bytes; whether lengths are padded."""
    n = F.col("l_linenumber") * 31 + F.col("l_quantity").cast("int")
    b, i = n % 256, (n * 13) % 4096
    back = (hof.unit_to_byte(hof.byte_to_unit(b) + 1e-9), hof.unit_to_int(hof.int_to_unit(i, 4095), 4095), hof.share_to_byte(F.col("l_discount")), hof.is_padded(n, 3).cast("long"))
    return table(spark, sf, "lineitem").groupBy(*(c.cast("long").alias(name) for name, c in zip(("byte", "int", "share", "padded"), back))).agg(F.count("*").alias("n"), r6(F.avg(hof.byte_to_unit(b))).alias("unit"))


@named
def brightness(spark, sf):
    v = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy(hof.brightened(v, F.lit(10000.0), F.lit(60000.0), 1.5).cast("long").alias("level")).agg(F.count("*").alias("n"))


# Thresholds and statistics.


@named
def threshold_rank(spark, sf):
    fractions = (0.0, 0.25, 0.5, 0.95, 1.0)
    found = thresholds(coefficients(spark, sf), F.col("v"), fractions)
    return spark.createDataFrame([(f, round(t, 6)) for f, t in zip(fractions, found)], "fraction double, threshold double")


@named
def threshold_from_one(spark, sf):
    c = coefficients(spark, sf)
    rows = [(f, up, round(select.threshold_from_one(c, F.col("v"), f, up), 6)) for f in (0.3, 0.77) for up in (False, True)]
    return spark.createDataFrame(rows, "cut double, up boolean, threshold double")


@named
def hard_threshold(spark, sf):
    kept = coefficients(spark, sf).select(F.when(F.abs("v") <= T, 0.0).otherwise(F.col("v")).alias("v"))
    return kept.agg(F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).alias("zeros"), F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@named
def filter_sorted(spark, sf):
    return coefficients(spark, sf).where(F.abs("v") >= MOST).select(F.round("v", 2).alias("v")).orderBy(F.abs("v"))


@named
def lower_bound_rank(spark, sf):
    c = coefficients(spark, sf)
    return c.agg(*(F.sum(F.when(F.abs("v") < t, 1).otherwise(0)).cast("long").alias(f"below_{t}") for t in (100, 5000, 20000)))


@named
def mode_value(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1)


@named
def summary_stats(spark, sf):
    v = F.col("v")
    return coefficients(spark, sf).agg(F.count(v).alias("n"), F.count_distinct(v).alias("n_distinct"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("stddev"), F.round(F.min(v), 4).alias("lo"), F.round(F.max(v), 4).alias("hi"))


@named
def trimmed_histogram(spark, sf):
    """24 bins between the values at 1 % from either end; what lies beyond goes into the end bins."""
    c = coefficients(spark, sf)
    n = c.count()
    lo, hi = order_statistics(c, F.col("v"), [n // 100, n - 1 - n // 100])
    place = F.least(F.greatest(F.floor(r6((F.col("v") - lo) / ((hi - lo) / 24))), F.lit(0)), F.lit(23))
    return histogram(c, place).withColumn("bar", F.expr(f"repeat('*', cast(floor(n * 200 / {n}) as int))"))


@named
def sign_counts(spark, sf):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    v = hof.to_int(F.col("v") / 1000)
    return coefficients(spark, sf).agg(count(v < 0).alias("negative"), count(v == 0).alias("zero"), count(v > 0).alias("positive"))


# Quantizers.

UNIFORM = partial(hof.quant_uniform, bins=BINS, t=T, most=MOST)
LOG = partial(hof.quant_log, bins=BINS, t=T, most=MOST)
QUANTIZERS = {
    "uniform": (UNIFORM, partial(hof.dequant_uniform, bins=BINS, t=T, most=MOST)),
    "log": (LOG, partial(hof.dequant_log, bins=BINS, t=T, most=MOST)),
    "codebook": (partial(hof.quant_codebook, boundaries=BOOK), partial(hof.dequant_codebook, values=[-50000.0, -30000.0, -12000.0, 0.0, 12000.0, 30000.0, 50000.0])),
}
for _name, (_quant, _dequant) in QUANTIZERS.items():
    query(f"quant_{_name}", lambda spark, sf, q=_quant: histogram(coefficients(spark, sf), q(F.col("v"))))
    query(
        f"dequant_{_name}",
        lambda spark, sf, q=_quant, d=_dequant: coefficients(spark, sf).select(r6(d(q(F.col("v")))).alias("v")).groupBy("v").agg(F.count("*").alias("n")),
    )


@named
def quantization_error(spark, sf):
    """Squared error of each quantizer, relative to the number of values."""
    c = coefficients(spark, sf)
    return c.agg(*(F.round(F.avg((d(q(F.col("v"))) - F.col("v")) ** 2), 2).alias(name) for name, (q, d) in QUANTIZERS.items()))


@named
def quant_legacy_bits(spark, sf):
    """The older forms, and what they give back."""
    v = F.col("v")
    q = {kind: F.greatest(F.least(hof.quant_bits(v, 4, T, MOST, kind == "log"), F.lit(7)), F.lit(-7)) for kind in ("uniform", "log")}
    both = coefficients(spark, sf).groupBy(*(c.cast("long").alias(kind) for kind, c in q.items())).agg(F.count("*").alias("n"))
    return both.select("*", *(r6(hof.dequant_bits(F.col(kind), 4, T, MOST, kind == "log")).alias(f"{kind}_value") for kind in q))


@named
def quant_partition(spark, sf):
    return histogram(coefficients(spark, sf), hof.quant_partition(F.col("v"), BOOK))


@named
def quant_few_bins(spark, sf):
    """One to four bins, nulls among the values."""
    v = F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice") - CENTRE)
    c = table(spark, sf, "lineitem").select(v.alias("v"))
    rows = [F.struct(F.lit(b).cast("long").alias("bins"), hof.quant_uniform(F.col("v"), b, T, MOST).cast("long").alias("q"), r6(hof.dequant_uniform(hof.quant_uniform(F.col("v"), b, T, MOST), b, T, MOST)).alias("back")) for b in (1, 2, 3, 4)]
    return c.select(F.inline(F.array(*rows))).groupBy("bins", F.coalesce("q", F.lit(-1)).alias("q"), "back").agg(F.count("*").alias("n"))  # -1: no bin


@named
def init_codebook(spark, sf):
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(codebooks.geometric(T, MOST, 15))], "bin long, value double")


@named
def mirror_codebook(spark, sf):
    c = coefficients(spark, sf).agg(F.min("v"), F.max("v")).first()
    bounds, values = codebooks.mirrored(codebooks.geometric(T, MOST, 4), T, c[0], c[1], 10)
    return spark.createDataFrame([(i, round(v, 6), round(bounds[i], 6) if i < len(bounds) else None) for i, v in enumerate(values)], "bin long, value double, upper double")


@named
def lloyd_codebook(spark, sf):
    c = coefficients(spark, sf).where(F.abs("v") > T).select(F.abs("v").alias("v"))
    book, partition, _ = codebooks.lloyd(c, F.col("v"), codebooks.geometric(T, MOST, 6), stop=1.0, most=20)
    return spark.createDataFrame([(i, round(v, 4), round(partition[i], 4) if i < len(partition) else None) for i, v in enumerate(book)], "bin long, value double, upper double")


@named
def lloyd_one_step(spark, sf):
    c = coefficients(spark, sf).where(F.abs("v") > T).select(F.abs("v").alias("v"))
    book, _, _ = codebooks.lloyd(c, F.col("v"), [10000.0, 20000.0, 30000.0, 50000.0], stop=0.0, most=1)
    return spark.createDataFrame([(i, round(v, 4)) for i, v in enumerate(book)], "bin long, value double")


@named
def equal_pop_bins(spark, sf):
    bounds, values = codebooks.equal_population(coefficients(spark, sf), F.col("v"), 3, T)
    return spark.createDataFrame([(i, round(v, 4), round(bounds[i], 4) if i < len(bounds) else None) for i, v in enumerate(values)], "bin long, value double, upper double")


@named
def equal_pop_signed(spark, sf):
    bounds, values = codebooks.equal_population_signed(coefficients(spark, sf), F.col("v"), 4, T)
    return spark.createDataFrame([(i, round(v, 4), round(bounds[i], 4) if i < len(bounds) else None) for i, v in enumerate(values)], "bin long, value double, upper double")


@named
def quant_equal_pop(spark, sf):
    c = coefficients(spark, sf)
    bounds, _ = codebooks.equal_population(c, F.col("v"), 3, T)
    return histogram(c, codebooks.quant_population(F.col("v"), bounds))


# Runs and codes.


@named
def symbol_frequency(spark, sf):
    return symbols(spark, sf).groupBy("s").agg(F.count("*").alias("n"))


@named
def symbols_by_frequency(spark, sf):
    q = coefficients(spark, sf).select(UNIFORM(F.col("v")).cast("long").alias("s"))
    return q.groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(10)


@named
def rle_encode(spark, sf):
    return entropy.run_pairs(symbols(spark, sf)).select("cube_id", "start", "s", F.col("length").cast("long").alias("length"))


@named
def rle_pair_frequency(spark, sf):
    """Run values and run lengths counted together."""
    pairs = entropy.run_pairs(symbols(spark, sf))
    return pairs.select(F.explode(F.array(F.col("s").cast("long"), F.col("length").cast("long"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@named
def zero_run_lengths(spark, sf):
    return entropy.runs(symbols(spark, sf, 2)).where("s = 0").groupBy("length").agg(F.count("*").alias("n"))


@named
def zero_run_savings(spark, sf):
    """Symbols that would go if each run of zeros over two were a pair."""
    return entropy.runs(symbols(spark, sf, 2)).where("s = 0 and length > 2").agg(F.count("*").alias("runs"), F.sum(F.col("length") - 2).cast("long").alias("saved"))


@named
def huffman_size(spark, sf):
    q = coefficients(spark, sf).select(UNIFORM(F.col("v")).alias("s"))
    counts = entropy.frequencies(q)
    own = entropy.lengths(counts)
    bits, n = sum(k * own[s] for s, k in counts.items()), sum(counts.values())
    return spark.createDataFrame([(len(counts), n, bits, entropy.encoded_bytes(counts, own), round(bits / n, 6))], "symbols long, n long, bits long, bytes long, bits_per_value double")


def quantised_arrays(spark, sf) -> DataFrame:
    coded = blocks.transform(F.col("a"), CUBE, (2, 2, 2))
    return arrays(spark, sf).select("cube_id", F.transform(coded, lambda c: hof.quant_uniform(c, 16, 0.15, 1.0)).alias("q"))


@named
def huffman_roundtrip(spark, sf):
    """Encode each cubelet's symbols, runs of the zero bin as escapes, decode, and count what differs."""
    q = quantised_arrays(spark, sf)
    counts = entropy.frequencies(q.select(F.explode("q").alias("s"))) | {16: 1}
    book = entropy.codes(entropy.lengths(counts))
    coded = q.withColumn("data", entropy.encode_column(F.col("q"), book, common=7, key=16))
    back = coded.withColumn("back", entropy.decode_column(F.col("data"), 64, book, common=7, key=16))
    return back.agg(F.count("*").alias("cubes"), F.sum(F.when(F.col("q") == F.col("back"), 0).otherwise(1)).alias("mismatches"))


# Errors.


@named
def error_metrics(spark, sf):
    """Original against transformed, quantised and restored."""
    q = quantised_arrays(spark, sf)
    back = q.select("cube_id", blocks.transform(F.transform("q", lambda s: hof.dequant_uniform(s, 16, 0.15, 1.0)), CUBE, (2, 2, 2), back=True).alias("b"))
    a = arrays(spark, sf).select("cube_id", F.posexplode("a").alias("pos", "v"))
    b = back.select("cube_id", F.posexplode("b").alias("pos", "v"))
    out = metrics.compared(a, b, ["cube_id", "pos"], 1.0)
    return out.select(*(F.round(c, 5).alias(c) for c in out.columns))


@named
def compress_roundtrip(spark, sf):
    """As error_metrics, without a join: payload against payload in one row."""
    q = blocks.transform(F.transform(F.transform(blocks.transform(F.col("a"), CUBE, (2, 2, 2)), lambda c: hof.quant_uniform(c, 16, 0.15, 1.0)), lambda s: hof.dequant_uniform(s, 16, 0.15, 1.0)), CUBE, (2, 2, 2), back=True)
    rows = arrays(spark, sf).select("cube_id", "a", q.alias("b")).select("cube_id", F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("sse"))
    return rows.select("cube_id", r6(F.col("sse") / 64).alias("mse"))


def versions(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_extendedprice") - CENTRE).alias("v"))
    return c, c.withColumn("v", QUANTIZERS["uniform"][1](UNIFORM(F.col("v"))))


@named
def matrix_mse(spark, sf):
    """Over the part that both matrices have."""
    a, b = versions(spark, sf)
    out = metrics.compared(a.where("l_linenumber <= 5"), b.where("l_linenumber >= 2"), ["l_orderkey", "l_linenumber"], MOST)
    return out.select(F.round("mse", 2).alias("mse"))


@named
def relative_norms(spark, sf):
    a, b = versions(spark, sf)
    j = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), ["l_orderkey", "l_linenumber"])
    d = F.col("a") - F.col("b")
    return j.agg(F.round(F.sum(d * d) / F.sum(F.col("a") ** 2), 6).alias("mse"), F.round(F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("a") ** 2)), 6).alias("l2"), F.round(F.sum(F.abs(d)) / F.sum(F.abs("a")), 6).alias("l1"))


@named
def difference_map(spark, sf):
    """Signed differences of two frames, scaled by the largest, in -255..255."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), "pos", F.col("v").alias("w")), ["vec_id", "pos"])
    d = pairs.select(F.col("vec_id").alias("cube_id"), "pos", (F.col("w").cast("double") - F.col("v").cast("double")).alias("d"))
    most = d.groupBy("cube_id").agg(F.max(F.abs("d")).alias("most"))
    return d.join(most, "cube_id").select("cube_id", F.col("pos").cast("long").alias("pos"), r6(F.when(F.col("most") > 0, F.col("d") / F.col("most") * 255).otherwise(0.0)).alias("v"))


# Search.


def rounded_trials(df: DataFrame) -> DataFrame:
    return df.select("fraction", F.round("threshold", 6).alias("threshold"), "bins", "used", "size_bytes", F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("psnr", 4).alias("psnr"))


@named
def param_sweep(spark, sf):
    """The full grid: 50 fractions, 32 numbers of bins, log quantizer."""
    return rounded_trials(search.grid(coefficients(spark, sf), F.col("v")))


@named
def threshold_sweep(spark, sf):
    return rounded_trials(search.threshold_sweep(coefficients(spark, sf), F.col("v")))


@named
def bin_sweep(spark, sf):
    return rounded_trials(search.bin_sweep(coefficients(spark, sf), F.col("v"), last=1500))


@named
def bits_experiment(spark, sf):
    out = search.experiment(coefficients(spark, sf), F.col("v"))
    return out.select(F.col("bits").cast("long").alias("bits"), "fraction", F.round("log_mse", 4).alias("log_mse"), F.round("reduction", 4).alias("reduction"))


@named
def fixed_psnr_search(spark, sf):
    """For each fraction, the fewest bins that reach 14 dB."""
    out = search.fixed_psnr(coefficients(spark, sf), F.col("v"), 14.0, fractions=[0.3, 0.4, 0.5, 0.6, 0.7], bins=search.grown(8, 300, 1.3), kind="uniform")
    return out.select("fraction", "bins", "size_bytes", F.round("psnr", 4).alias("psnr"))


@named
def max_cut_bisect(spark, sf):
    """The largest cut whose relative error stays under 0.05, by seven halvings."""
    return spark.createDataFrame([(select.max_cut(coefficients(spark, sf), F.col("v"), 0.05),)], "cut double")


@named
def min_bins_bisect(spark, sf):
    return spark.createDataFrame([(search.fewest_bins(coefficients(spark, sf), F.col("v"), 0.3, 0.03, kind="uniform"),)], "bins long")


@named
def hill_climb(spark, sf):
    cut, bins, ratio = search.climbed(coefficients(spark, sf), F.col("v"), 30.0, 40, 0.04, kind="uniform")
    return spark.createDataFrame([(cut, bins, round(ratio, 6))], "cut double, bins long, ratio double")


# Codecs of whole slices.


@arrow_udf(ST.BinaryType())
def deflated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if x is None else zlib.compress(np.array(x, dtype=np.uint8).tobytes(), 6) for x in batch.to_pylist()], pa.binary())


@arrow_udf(ST.ArrayType(ST.IntegerType()))
def inflated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if x is None else np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int32) for x in batch.to_pylist()], pa.list_(pa.int32()))


@named
def slice_minmax_codec(spark, sf):
    """Each 8 x 8 slice: 2-D transform, quantised between its least and most, deflated; the restored slice's error."""
    c = arrays(spark, sf).select("cube_id", "a", blocks.transform(F.col("a"), SQUARE, (2, 2, 0), "cdf97").alias("c"))
    c = c.withColumn("lo", F.array_min("c")).withColumn("hi", F.array_max("c"))
    level = F.when(F.col("hi") > F.col("lo"), 255 / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    c = c.withColumn("f", level).withColumn("q", F.expr("transform(c, x -> cast(greatest(ceil((x - lo) * f - 0.5), 0) as int))"))
    c = c.withColumn("q2", inflated(deflated("q"))).withColumn("b", F.expr("transform(q2, q -> case when f > 0 then q / f + lo else lo end)"))
    c = c.withColumn("b", blocks.transform(F.col("b"), SQUARE, (2, 2, 0), "cdf97", back=True))
    return c.select("cube_id", F.expr("q = q2").alias("same"), F.expr("aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> greatest(s, x)) < (hi - lo) * 0.03").alias("close"))


# Files: written to the shared folder and read back.


def written_cubelets(spark, sf) -> str:
    files.register(spark)
    path = paths.scratch(spark)
    cubelets(spark, sf).drop("cube_id").write.format("cubelets").mode("append").save(path)
    return path


@named
def file_cubelets(spark, sf):
    back = spark.read.format("cubelets").load(written_cubelets(spark, sf))
    return back.select("x_off", "y_off", "z_off", "data_type", F.size("payload").cast("long").alias("n"), r6(F.aggregate("payload", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@named
def file_index(spark, sf):
    """Metadata from the files' indexes; payloads aren't read."""
    back = spark.read.format("cubelets").option("metadata", "true").load(written_cubelets(spark, sf))
    return back.select("x_off", "y_off", "z_off", "width", "height", "depth", "data_type", "compression", "byte_count", F.col("payload").isNull().alias("no_payload"))


def written_shorts(spark, sf) -> str:
    """Event times of a day in units of 16, as 16-bit frames of 4096."""
    raw.register(spark)
    path = paths.scratch(spark)
    e = table(spark, sf, "events").select(F.format_string("frame%06d", F.floor(F.col("event_id") / 4096)).alias("file"), "event_id", (F.col("user_id") % 4096 * 16).alias("value"))
    rows = e.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value")
    rows.write.format("rawnumbers").option("kind", "u2").mode("append").save(path)
    return path


@named
def raw_shorts(spark, sf):
    """16-bit numbers and their high bytes."""
    back = spark.read.format("rawnumbers").option("kind", "u2").option("split", "10000").load(written_shorts(spark, sf))
    value = F.col("value").cast("long")
    return back.groupBy(F.shiftright(value, 8).alias("byte")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum("pos").alias("places"))


@named
def raw_frames(spark, sf):
    """Frames of 64 x 64 as cubelets in their order; the last one is short and filled up with zeros."""
    c = raw.frames(spark, written_shorts(spark, sf), 64, 64)
    return c.select("z_off", "data_type", "max_value", F.size("payload").cast("long").alias("n"), F.aggregate("payload", F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"))


@named
def number_text(spark, sf):
    """Numbers as text lines, read as a stream of numbers and kept as bytes."""
    path = paths.scratch(spark)
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").cast("long").alias("v"))
    raw.write_lines(p, F.concat_ws(" ", F.col("v") + 250, F.col("l")), ["k", "l"], path)
    return raw.numbers(spark, path).groupBy((F.col("value").cast("long") % 256).alias("byte")).agg(F.count("*").alias("n"))


@named
def parameter_files(spark, sf):
    """A parameter file for each region, with the comments of its nations; written and read."""
    path = paths.scratch(spark)
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"), F.concat(F.lit("nation "), "n_name").alias("name"), F.concat(F.lit('key = "'), F.col("n_nationkey").cast("string"), F.lit('"')).alias("value"))
    parameters.write_parameters(n, path)
    return parameters.read_parameters(spark, path + "/*/*.txt").select(F.regexp_extract("file", "file=([^/]+)", 1).alias("file"), "name", "value")


@named
def random_matrix(spark, sf):
    m = raw.random_matrix(spark, 300, 200, 7)
    whole = F.abs(F.col("value") * 100000 - F.round(F.col("value") * 100000)) < 1e-6
    return m.agg(F.count("*").alias("n"), F.countDistinct("row", "col").alias("cells"), F.min((F.col("value") >= 0) & (F.col("value") < 1) & whole).alias("fit"), F.round(F.avg("value"), 1).alias("mean"))

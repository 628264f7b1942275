"""Operators on cubelet tables (a row for each cubelet, its values in a payload array, x fastest) and voxel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hof

BYTES = {"UINT8": 1, "INT32": 4, "FLOAT32": 4}


def listed(cubes: DataFrame) -> DataFrame:
    """Metadata only: the payload isn't read."""
    size = F.create_map(*(F.lit(x) for kv in BYTES.items() for x in kv))[F.col("data_type")]
    return cubes.select("cube_id", "x_off", "y_off", "z_off", "width", "height", "depth", "data_type", (F.col("width") * F.col("height") * F.col("depth") * size).cast("long").alias("byte_count"))


def found(cubes: DataFrame, x: int, y: int, z: int) -> DataFrame:
    return cubes.where((F.col("x_off") == x) & (F.col("y_off") == y) & (F.col("z_off") == z))


def extracted(cubes: DataFrame, ids: DataFrame) -> DataFrame:
    """The cubelets of a list of ids (ord, cube_id), with their order; ids without a cubelet give nothing."""
    return cubes.join(ids, "cube_id")


def missing(cubes: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(cubes.select("cube_id"), "cube_id", "left_anti")


def voxels(cubes: DataFrame, payload: str = "payload") -> DataFrame:
    w, h = F.col("width"), F.col("height")
    flat = cubes.select("cube_id", "width", "height", F.posexplode(payload).alias("pos", "v"))
    return flat.select("cube_id", F.pmod("pos", w).alias("x"), F.pmod(F.floor(F.col("pos") / w), h).cast("int").alias("y"), F.floor(F.col("pos") / (w * h)).cast("int").alias("z"), "v")


def part(a: Column, shape: tuple[int, int, int], offset: tuple[int, int, int], size: tuple[int, int, int]) -> Column:
    """A box of a payload; what lies outside the source is zero."""
    (nx, ny, nz), (ox, oy, oz), (sx, sy, sz) = shape, offset, size

    def value(v: Column, p: Column) -> Column:
        x, y, z = p % sx + ox, F.floor(p / sx) % sy + oy, F.floor(p / (sx * sy)) + oz
        inside = (x >= 0) & (x < nx) & (y >= 0) & (y < ny) & (z >= 0) & (z < nz)
        return F.when(inside, F.get(v, ((z * ny + y) * nx + x).cast("int"))).otherwise(0.0)

    return hof.let(a, lambda v: F.transform(hof.index(sx * sy * sz), lambda p: value(v, p)))


def tiles(voxels: DataFrame, total: tuple[int, int, int], size: tuple[int, int, int], overlap: int) -> DataFrame:
    """Each voxel (x, y, z, v) once for each tile that covers it: tx, ty, tz and the place inside. Tiles begin every size -
    overlap voxels; the last of an axis may be short."""
    out = voxels
    for axis, n, s in zip("xyz", total, size):
        step = s - overlap
        count = max(1, (n - overlap - 1) // step + 1)
        first = F.greatest(F.lit(0), F.ceil((F.col(axis) - s + 1) / step)).cast("int")
        last = F.least(F.lit(count - 1), F.floor(F.col(axis) / step)).cast("int")
        out = out.withColumn(f"t{axis}", F.explode(F.sequence(first, last))).withColumn(f"i{axis}", F.col(axis) - F.col(f"t{axis}") * step)
    return out


def rebuilt(tiles: DataFrame, size: tuple[int, int, int], overlap: int) -> DataFrame:
    """The rows of `tiles` as cubelets, a row each: no group is larger than a tile."""
    cell = F.array_sort(F.collect_list(F.struct("iz", "iy", "ix", "v")))
    out = tiles.groupBy("tx", "ty", "tz").agg(cell.alias("cells"), *((F.max(f"i{a}") + 1).cast("int").alias(name) for a, name in zip("xyz", ("width", "height", "depth"))))
    places = ((F.col(f"t{a}") * (s - overlap)).cast("int").alias(f"{a}_off") for a, s in zip("xyz", size))
    return out.select(*places, "width", "height", "depth", F.col("cells.v").alias("payload"))


def plain(cubes: DataFrame) -> DataFrame:
    """Cubelets as they are, for an operator that needs values: a compressed one is an error."""
    if "compression" not in cubes.columns:
        return cubes
    refused = F.raise_error(F.concat(F.lit("compressed cubelet at "), F.concat_ws(",", "x_off", "y_off", "z_off"))).cast("boolean")
    return cubes.where(F.when(F.col("compression") == "NONE", True).otherwise(refused))


def first_plain(cubes: DataFrame) -> DataFrame:
    """The first uncompressed cubelet of a file table, as it lies in its file."""
    return cubes.where("compression = 'NONE'").orderBy("file", "file_offset").limit(1)


def frames_valid(frames: DataFrame) -> DataFrame:
    """Whether frames (x_off, y_off, z_off, width, height, depth, data_type) make up one volume: n, and one flag each.
    Places are contiguous if they are distinct and span no more than their number."""
    same = lambda c: F.count_distinct(c) <= 1
    return frames.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max("depth") == 1, F.lit(True)).alias("flat"),
        (same(F.struct("width", "height"))).alias("same_size"),
        F.coalesce((F.max("z_off") - F.min("z_off") + 1 == F.count("*")) & (F.count_distinct("z_off") == F.count("*")), F.lit(True)).alias("contiguous"),
        F.coalesce((F.max("x_off") == 0) & (F.max("y_off") == 0), F.lit(True)).alias("at_origin"),
        same("data_type").alias("same_type"),
    )

"""Error measures of a restored array against the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_columns(a: Column, b: Column, most: float) -> list[Column]:
    """Aggregates: l1, l2, mse, psnr (0 if the error is zero or no maximum is known), rel_err (squares against squares)."""
    d = b - a
    mse = F.avg(d * d)
    return [
        F.sum(F.abs(d)).alias("l1"),
        F.sqrt(F.sum(d * d)).alias("l2"),
        mse.alias("mse"),
        (F.when((mse > 0) & (F.lit(most) > 0), F.log10(most * most / mse) * 10).otherwise(0.0)).alias("psnr"),
        F.when(F.sum(a * a) > 0, F.sum(d * d) / F.sum(a * a)).otherwise(0.0).alias("rel_err"),
    ]


def compared(original: DataFrame, restored: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Both tables need the keys and v; only places that both have count."""
    joined = original.select(*keys, F.col("v").alias("a")).join(restored.select(*keys, F.col("v").alias("b")), keys)
    return joined.agg(*error_columns(F.col("a"), F.col("b"), most))

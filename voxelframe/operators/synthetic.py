"""Closed-form cubes and surfaces, generated where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _wave():
    """Whole offset of a trace: two slow waves, rounded towards zero."""
    w = 5 * F.cos(F.col("i") * 0.02) + 5 * F.sin(F.col("x") * 0.05)
    return F.when(w >= 0, F.floor(w)).otherwise(F.ceil(w)).cast("long")


def traces(spark: SparkSession, shape: tuple[int, int]) -> DataFrame:
    return spark.range(shape[0] * shape[1]).select(F.expr(f"id div {shape[1]}").alias("i"), (F.col("id") % shape[1]).alias("x"))


def wavy_cube(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """(i, x, samples): sin(0.1 * ((d - offset) mod depth))."""
    n = shape[2]
    t = traces(spark, shape[:2]).withColumn("o", _wave())
    return t.select("i", "x", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: F.sin(F.pmod(d - F.col("o"), F.lit(n)) * 0.1)).alias("samples"))


def wavy_surface(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """(i, x, d): the offset below mid-depth."""
    return traces(spark, shape[:2]).select("i", "x", (_wave() + shape[2] // 2).alias("d"))

"""Locations of crops: regular grids, unions, chunks, candidate starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starts(length: int, crop: int, stride: int) -> list[int]:
    """Distinct start points along an axis, the last one clipped to fit."""
    return sorted({min(max(v, 0), max(length - crop, 0)) for v in range(0, length, stride)})


def extent(traces: DataFrame) -> DataFrame:
    """One row (i_lo, i_hi, x_lo, x_hi, d_lo, d_hi): the least box around all samples; ends are exclusive."""
    n = F.size("samples")
    t = traces.where((n > 0) & F.col("i").isNotNull() & F.col("x").isNotNull())
    ends = [f(c).cast("long").alias(f"{c}_{k}") for c in "ix" for k, f in (("lo", F.min), ("hi", lambda c: F.max(c) + 1))]
    return t.agg(*ends, F.lit(0).cast("long").alias("d_lo"), F.max(n).cast("long").alias("d_hi"))


def regular_grid(box: DataFrame, crop: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """(loc_id, i0, x0, d0, i1, x1, d1), numbered in order of the starts. ``box``
    is the row of ``extent``, hence the grid covers it whatever its size; a box
    without traces has no locations. Starts along an axis as in ``starts``."""
    g = box
    for k, axis in enumerate("ixd"):
        last = f"greatest({axis}_hi - {crop[k]}, {axis}_lo)"
        places = f"array_distinct(transform(sequence({axis}_lo, {axis}_hi - 1, {stride[k]}L), v -> least(v, {last})))"
        g = g.withColumn(f"_{axis}", F.when(F.col(f"{axis}_hi").isNotNull(), F.expr(places)))
    for axis in "ixd":
        g = g.select("*", F.posexplode(f"_{axis}").alias(f"p{axis}", f"{axis}0")).withColumn(f"n{axis}", F.size(f"_{axis}")).drop(f"_{axis}")
    n = (F.col("pi").cast("long") * F.col("nx") + F.col("px")) * F.col("nd") + F.col("pd")
    return g.select(n.alias("loc_id"), "i0", "x0", "d0", *((F.col(f"{k}0") + crop[j]).alias(f"{k}1") for j, k in enumerate("ixd")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = ["i0", "x0", "d0"]
    return a.select(*cols).union(b.select(*cols)).distinct()


def unseen(a: DataFrame, seen: DataFrame) -> DataFrame:
    return a.join(seen, ["i0", "x0", "d0"], "left_anti").select("i0", "x0", "d0")


def chunks(locations: DataFrame, crop: tuple[int, int], size: tuple[int, int], step: tuple[int, int]) -> DataFrame:
    """(loc_id, ki, kx): the overlapping chunks that contain each location, found
    by arithmetic on chunk numbers, not by comparing all chunks."""
    out = locations
    for k, axis in enumerate("ix"):
        lo = F.greatest(F.ceil((F.col(f"{axis}0") + crop[k] - size[k]) / step[k]), F.lit(0))
        hi = F.floor(F.col(f"{axis}0") / step[k])
        out = out.withColumn(f"k{axis}", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.expr("cast(array() as array<bigint>)"))))
    return out.select("loc_id", "ki", "kx")


def crops_with_labels(locations: DataFrame, surface: DataFrame, crop: tuple[int, int, int], least: int) -> DataFrame:
    """Locations whose crop holds at least ``least`` points of the surface."""
    from .volume import load_crops

    pts = surface.select("i", "x", "d", F.lit(1.0).alias("amp"))
    return load_crops(pts, locations, crop).groupBy("loc_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)

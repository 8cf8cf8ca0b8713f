"""Depth surfaces: rows (i, x, d), keyed further by any ``by`` columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stencil

TRACE = ["i", "x"]


def _long(c):
    return c.cast("long")


def trace_surface(points: DataFrame, how: str = "mean", by: list[str] | None = None, weight: str = "p") -> DataFrame:
    """One depth for each trace. how: mean (rounded half to even), min, max,
    prob (mean weighted by ``weight``, rounded), all (count, min, max, mean)."""
    g = points.groupBy(*(by or []), *TRACE)
    if how == "all":
        return g.agg(F.count("*").alias("n"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), _long(F.floor(F.avg("d"))).alias("d_mean"))
    agg = {"mean": F.rint(F.avg("d")), "min": F.min("d"), "max": F.max("d"), "prob": F.rint(F.sum(F.col("d") * F.col(weight)) / F.sum(weight))}[how]
    return g.agg(_long(agg).alias("d"))


def compare(a: DataFrame, b: DataFrame, interval: float = 2.0) -> DataFrame:
    """One row: differences of two surfaces where both exist, and presence."""
    j = a.select(*TRACE, F.col("d").alias("da")).join(b.select(*TRACE, F.col("d").alias("db")), TRACE, "full")
    e = F.col("da") - F.col("db")
    r = lambda c: F.round(c, 4)
    share = lambda t: r(F.avg(F.when(e.isNotNull(), (F.abs(e) <= t).cast("double"))))
    return j.agg(
        r(F.avg(e)).alias("mean"), r(F.avg(F.abs(e))).alias("abs_mean"), F.min(e).alias("min"), F.max(e).alias("max"), r(F.stddev_pop(e)).alias("std"), r(F.stddev_pop(F.abs(e))).alias("abs_std"),
        share(0).alias("accuracy_0"), share(1).alias("accuracy_1"), share(2).alias("accuracy_2"), F.count(e).alias("overlap"),
        r(F.count(e) / F.count("da")).alias("coverage"), r(F.avg(F.when(e.isNotNull(), (F.abs(e) < 5 / interval).cast("double")))).alias("window_rate"),
        F.count(F.when(F.col("db").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("da").isNull(), 1)).alias("only_b"),
    )


def closest(surfaces: DataFrame, key: str = "s") -> DataFrame:
    """For each surface the other of least mean absolute difference (ties: smaller
    name). All pairs of surfaces that share a trace are compared, as their
    differences are what is asked for; surfaces are few, traces many."""
    a, b = surfaces.select(*TRACE, F.col(key).alias("a"), F.col("d").alias("da")), surfaces.select(*TRACE, F.col(key).alias("b"), F.col("d").alias("db"))
    m = a.join(b, TRACE).where("a <> b").groupBy("a", "b").agg(F.round(F.avg(F.abs(F.col("da") - F.col("db"))), 6).alias("m"))
    best = m.groupBy("a").agg(F.min(F.struct("m", "b")).alias("k"))
    return best.select(F.col("a").alias(key), F.col("k.b").alias("closest"), F.col("k.m").alias("abs_mean"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Traces of a that b lacks."""
    return a.join(b.select(*TRACE), TRACE, "left_anti")


def proportional(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """The surface at ``share`` of the way from the shallower to the deeper."""
    j = a.select(*TRACE, F.col("d").alias("da")).join(b.select(*TRACE, F.col("d").alias("db")), TRACE)
    lo, hi = F.least("da", "db"), F.greatest("da", "db")
    return j.select(*TRACE, _long(F.ceil(lo + F.lit(share) * (hi - lo))).alias("d"))


def merge(parts: DataFrame, how: str = "mean") -> DataFrame:
    """Stacked surfaces to one."""
    return trace_surface(parts, how)


def overlap_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two surfaces; where both exist, the floor of their mean."""
    j = a.select(*TRACE, F.col("d").alias("da")).join(b.select(*TRACE, F.col("d").alias("db")), TRACE, "full")
    both = F.col("da").isNotNull() & F.col("db").isNotNull()
    return j.select(*TRACE, F.when(both, _long(F.floor((F.col("da") + F.col("db")) / 2))).otherwise(F.coalesce("da", "db")).alias("d"))


def merge_status(surfaces: DataFrame, key: str = "s", mean_threshold: float = 1.0, max_threshold: float = 20.0) -> DataFrame:
    """For each pair: 4 mergeable on overlap, 3 no common trace, 1 mean difference too large, 0 largest too large."""
    a, b = surfaces.select(*TRACE, F.col(key).alias("a"), F.col("d").alias("da")), surfaces.select(*TRACE, F.col(key).alias("b"), F.col("d").alias("db"))
    names = surfaces.select(key).distinct()
    pairs = names.select(F.col(key).alias("a")).join(names.select(F.col(key).alias("b")), F.col("a") < F.col("b"))
    e = F.abs(F.col("da") - F.col("db"))
    m = a.join(b, TRACE).where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"), F.round(F.avg(e), 6).alias("abs_mean"), F.max(e).alias("abs_max"))
    status = F.when(F.col("overlap").isNull(), 3).when(F.col("abs_max") > max_threshold, 0).when(F.col("abs_mean") > mean_threshold, 1).otherwise(4)
    return pairs.join(m, ["a", "b"], "left").select("a", "b", F.coalesce("overlap", F.lit(0)).alias("overlap"), "abs_mean", "abs_max", status.cast("long").alias("status"))


def stats(surfaces: DataFrame, by: list[str]) -> DataFrame:
    return surfaces.groupBy(*by).agg(F.count("*").alias("n"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.round(F.avg("d"), 6).alias("d_mean"), F.round(F.stddev_pop("d"), 6).alias("d_std"), F.min("i").alias("i_min"), F.max("i").alias("i_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def coverage(surfaces: DataFrame, alive: DataFrame, by: str = "s") -> DataFrame:
    """Share of the alive traces that each surface covers, and its solidity
    within its bounding box."""
    total = alive.agg(F.count("*").alias("alive"))
    s = surfaces.join(alive.select(*TRACE), TRACE, "left_semi").groupBy(by).agg(F.count("*").alias("n"), ((F.max("i") - F.min("i") + 1) * (F.max("x") - F.min("x") + 1)).alias("box"))
    return s.join(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("alive"), 5).alias("coverage"), F.round(F.col("n") / F.col("box"), 5).alias("solidity"))


def prediction_std(surfaces: DataFrame) -> DataFrame:
    """Spread of depth over surfaces for each trace."""
    return surfaces.groupBy(*TRACE).agg(F.count("*").alias("n"), F.round(F.stddev_pop("d"), 6).alias("std"))


def carcass_lines(surfaces: DataFrame, by: str = "s", threshold: int = 20) -> DataFrame:
    """Lines along each axis with more than ``threshold`` points."""
    one = lambda axis: surfaces.groupBy(by, F.col(axis).alias("line")).agg(F.count("*").alias("n")).where(F.col("n") > threshold).select(by, F.lit(axis).alias("axis"), "line", "n")
    return one("i").union(one("x"))


def thin_out(surfaces: DataFrame, by: str = "s", factor: int = 2, threshold: int = 20) -> DataFrame:
    """Points on every ``factor``-th of the lines that have more than
    ``threshold`` points, along either axis."""
    out = surfaces.select(by, *TRACE, "d")
    for axis in TRACE:
        lines = surfaces.groupBy(by, axis).agg(F.count("*").alias("_n")).where(F.col("_n") > threshold)
        k = F.row_number().over(Window.partitionBy(by).orderBy(axis)) - 1
        out = out.join(lines.select(by, axis, (k % factor == 0).alias(f"_on_{axis}")), [by, axis], "left")
    return out.where(F.coalesce("_on_i", F.lit(False)) | F.coalesce("_on_x", F.lit(False))).select(by, *TRACE, "d")


def on_grid(surfaces: DataFrame, frequency: tuple[int, int]) -> DataFrame:
    """Points on grid lines."""
    return surfaces.where((F.col("i") % frequency[0] == 0) | (F.col("x") % frequency[1] == 0))


def drop_masked(points: DataFrame, mask: DataFrame) -> DataFrame:
    return points.join(mask.select(*TRACE), TRACE, "left_anti")


def keep_masked(points: DataFrame, mask: DataFrame) -> DataFrame:
    return points.join(mask.select(*TRACE), TRACE, "left_semi")


def gradient(surfaces: DataFrame, by: str, axis: str) -> DataFrame:
    """Difference to the preceding trace along ``axis`` (null where absent)."""
    other = "x" if axis == "i" else "i"
    w = Window.partitionBy(by, other).orderBy(axis)
    step = F.when(F.col(axis) - F.lag(axis).over(w) == 1, F.col("d") - F.lag("d").over(w))
    return surfaces.select(by, *TRACE, step.alias("g"))


def boundary(surfaces: DataFrame, by: str) -> DataFrame:
    """Points with an absent 8-neighbour."""
    f = lambda a: np.where(np.isfinite(stencil.neighbourhood(a, 1, 1)).all(axis=0), np.nan, a)
    return stencil.by_tiles(surfaces, [by], f, 1).withColumn("d", _long(F.col("d")))


def dilate(surfaces: DataFrame, by: str, times: int = 1) -> DataFrame:
    """Largest depth within ``times`` traces, also where there was none."""
    f = lambda a: np.where(np.isnan(n := stencil.neighbourhood(a, times, times)), -np.inf, n).max(axis=0)
    return stencil.by_tiles(surfaces, [by], f, times).withColumn("d", _long(F.col("d")))


def smooth(surfaces: DataFrame, by: str, kernel: list[list[float]], max_difference: float | None = None, sigma_range: float | None = None, times: int = 1) -> DataFrame:
    """Normalised kernel over present neighbours, those farther than
    ``max_difference`` left out; with ``sigma_range`` also weighted by a
    Gaussian of the difference (bilateral); ``times`` passes."""
    k = np.array(kernel, float)

    def f(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = stencil.kernel_mean(a, k, max_difference, sigma_range)
        return a

    return stencil.by_tiles(surfaces, [by], f, max(k.shape) // 2 * times).withColumn("d", F.round("d", 6))


def median_difference(surfaces: DataFrame, by: str, reach: int = 2) -> DataFrame:
    """Depth less the median of the neighbourhood (the point itself not counted); null for a lone point."""
    lone = 1e300  # stands for null within the tiles

    def f(a: np.ndarray) -> np.ndarray:
        m = stencil.median_of_others(a, reach)
        return np.where(np.isfinite(m), a - m, np.where(np.isfinite(a), lone, np.nan))

    return stencil.by_tiles(surfaces, [by], f, reach, name="diff").withColumn("diff", F.when(F.col("diff") != lone, F.col("diff")))


def fill_missing(surfaces: DataFrame, by: str, least_neighbours: int = 3, max_ptp: float | None = None) -> DataFrame:
    """Mean of 3 x 3 neighbours for traces that are absent and have enough of them."""
    f = lambda a: np.where(np.isfinite(a), np.nan, stencil.filled(a, np.ones((3, 3)), least_neighbours, max_ptp))
    return stencil.by_tiles(surfaces, [by], f, 1).withColumn("d", F.round("d", 6))


def interpolate(surfaces: DataFrame, by: str, kernel: list[list[float]], least_neighbours: int = 1, max_ptp: float | None = None, times: int = 1) -> DataFrame:
    """Absent traces from their weighted neighbours, ``times`` passes; present ones stay."""
    k = np.array(kernel, float)

    def f(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = stencil.filled(a, k, least_neighbours, max_ptp)
        return a

    return stencil.by_tiles(surfaces, [by], f, max(k.shape) // 2 * times).withColumn("d", F.round("d", 6))

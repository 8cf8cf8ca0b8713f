"""Maps and edits of surfaces (by, i, x, d): masks, holes, gradients, spikes,
smoothing in passes, containers. ``by`` is the column that names the surface."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stencil, surface
from .components import grid_components

TRACE = ["i", "x"]


def _long(name: str) -> Column:
    return F.rint(name).cast("long").alias(name)


# --- containers -------------------------------------------------------------
def from_points(points: DataFrame, shape: tuple[int, int, int], by: list[str] | None = None) -> DataFrame:
    """Whole points inside a cube of ``shape``, one for each trace (the shallowest)."""
    p = points.select(*(by or []), *(_long(c) for c in "ixd"))
    inside = [(F.col(c) >= 0) & (F.col(c) < n) for c, n in zip("ixd", shape, strict=True)]
    return p.where(inside[0] & inside[1] & inside[2]).groupBy(*(by or []), *TRACE).agg(F.min("d").alias("d"))


def from_matrix(rows: DataFrame, i_min: int = 0, x_min: int = 0, fill: float = -999999) -> DataFrame:
    """Points of a depth map given as rows (k, depths: array): trace (i_min + k, x_min + place), fill left out."""
    p = rows.select((F.col("k") + i_min).cast("long").alias("i"), F.posexplode("depths").alias("x", "d"))
    return p.where(F.col("d").isNotNull() & (F.col("d") != fill)).select("i", (F.col("x") + x_min).cast("long").alias("x"), _long("d"))


def to_matrix(points: DataFrame, by: list[str], fill: int = -999999) -> DataFrame:
    """(by, k, depths): a row for each inline from the least on, depths from the
    least crossline to the largest of the surface, ``fill`` where there is none."""
    w = Window.partitionBy(*by)
    p = points.select(*by, *TRACE, "d", F.min("i").over(w).alias("i0"), F.min("x").over(w).alias("x0"), F.max("x").over(w).alias("x1"))
    m = p.groupBy(*by, (F.col("i") - F.col("i0")).alias("k"), "x0", "x1").agg(F.map_from_entries(F.collect_list(F.struct(F.col("x") - F.col("x0"), "d"))).alias("m"))
    places = F.sequence(F.lit(0).cast("long"), (F.col("x1") - F.col("x0")).cast("long"))
    return m.select(*by, "k", F.transform(places, lambda v: F.coalesce(F.try_element_at("m", v), F.lit(fill).cast("long"))).alias("depths"))


def put_on_full(points: DataFrame, grid: DataFrame, by: list[str], fill: int = -999999) -> DataFrame:
    """Each surface on all traces of ``grid`` (i, x), ``fill`` where it is absent."""
    names = points.select(*by).distinct()
    full = grid.select(*TRACE).distinct().crossJoin(F.broadcast(names)) if by else grid.select(*TRACE).distinct()  # names of surfaces are few
    return full.join(points, [*by, *TRACE], "left").select(*by, *TRACE, F.coalesce("d", F.lit(fill).cast("long")).alias("d"))


def fill_to_number(points: DataFrame, value: float, fill: int = -999999) -> DataFrame:
    return points.withColumn("d", F.when(F.col("d") == fill, F.lit(value)).otherwise(F.col("d")))


def number_to_fill(points: DataFrame, value: float, fill: int = -999999) -> DataFrame:
    return points.withColumn("d", F.when(F.col("d") == value, F.lit(fill)).otherwise(F.col("d")))


def normalize_map(points: DataFrame, by: list[str], mode: str = "min-max") -> DataFrame:
    """Depths of each surface to 0..1 (min-max) or to mean 0 and deviation 1 (mean-std)."""
    s = points.groupBy(*by).agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"), F.avg("d").alias("_m"), F.stddev_pop("d").alias("_s"))
    e = (F.col("d") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) if mode == "min-max" else (F.col("d") - F.col("_m")) / F.col("_s")
    j = points.join(s, by) if by else points.join(F.broadcast(s))
    return j.select(*by, *TRACE, F.round(e, 6).alias("d"))


def transformed(points: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``steps`` one after another."""
    for f in steps:
        points = points.transform(f)
    return points


# --- filters ----------------------------------------------------------------
def spread(mask: DataFrame, margin: int, cross: bool = True) -> DataFrame:
    """(i, x) within ``margin`` steps of the mask; steps go along the axes, or with cross=False also across."""
    off = F.sequence(F.lit(-margin), F.lit(margin))
    e = mask.select(*TRACE, F.explode(off).alias("a")).select("*", F.explode(off).alias("b"))
    e = e.where(F.abs("a") + F.abs("b") <= margin) if cross else e
    return e.select((F.col("i") + F.col("a")).alias("i"), (F.col("x") + F.col("b")).alias("x")).distinct()


def drop_under(points: DataFrame, mask: DataFrame, frame: DataFrame, margin: int = 0) -> DataFrame:
    """Points off the mask, more than ``margin`` steps from it and from the frame (of the traces ``frame``)."""
    out = points.join(spread(mask, margin) if margin else mask.select(*TRACE), TRACE, "left_anti")
    return _inside(out, frame, margin) if margin else out


def _inside(points: DataFrame, frame: DataFrame, margin: int) -> DataFrame:
    box = frame.agg(F.min("i").alias("_i0"), F.max("i").alias("_i1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    return points.join(F.broadcast(box)).where(f"i >= _i0 + {margin} and i <= _i1 - {margin} and x >= _x0 + {margin} and x <= _x1 - {margin}").select(*points.columns)


def main_part(points: DataFrame, erosion: int = 0) -> DataFrame:
    """The largest 8-connected part of one surface (ties: that of the smallest
    trace), looked for after ``erosion`` passes over its edge."""
    core = points
    if erosion:
        f = lambda a: np.where(np.isfinite(stencil.neighbourhood(a, erosion, erosion)).all(axis=0), a, np.nan)
        core = stencil.by_tiles(points, [], f, erosion)
    c = grid_components(core, TRACE, f"i * {1 << 31}L + x", 256)
    top = c.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(1).select("c")
    kept = c.join(F.broadcast(top), "c", "left_semi").select(*TRACE)
    return points.join(spread(kept, erosion, False) if erosion else kept, TRACE, "left_semi")


def grid_traces(traces: DataFrame, frequency: tuple[int, int], dead: DataFrame, margin: int = 20) -> DataFrame:
    """(i, x) of traces on lines of the grid, more than ``margin`` off dead traces and the frame."""
    g = traces.where((F.col("i") % frequency[0] == 0) | (F.col("x") % frequency[1] == 0)).select(*TRACE)
    return _inside(g, traces, margin).join(spread(dead, margin, False), TRACE, "left_anti")


def sparse_coverage(points: DataFrame, grid: DataFrame) -> DataFrame:
    """One row: the share of grid traces where the surface is."""
    j = grid.select(*TRACE).distinct().join(points.select(*TRACE, F.lit(1).alias("_on")), TRACE, "left")
    return j.agg(F.count("*").alias("grid"), F.count("_on").alias("covered"), F.round(F.count("_on") / F.count("*"), 5).alias("share"))


# --- holes and edges --------------------------------------------------------
def absent(points: DataFrame) -> DataFrame:
    """(i, x) inside the box of one surface where it has no point."""
    box = points.agg(F.min("i").alias("a"), F.max("i").alias("b"), F.min("x").alias("c"), F.max("x").alias("d"))
    lines = box.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("i"), "c", "d")
    return lines.select("i", F.explode(F.sequence("c", "d")).alias("x")).join(points.select(*TRACE), TRACE, "left_anti")


def holes(points: DataFrame, cross: bool = True) -> DataFrame:
    """(i, x, c): absent traces that the surface encloses, by hole; ``cross``:
    absent traces hang together along axes only."""
    c = grid_components(absent(points), TRACE, f"i * {1 << 31}L + x", 256, cross)
    box = points.agg(F.min("i").alias("_a"), F.max("i").alias("_b"), F.min("x").alias("_c"), F.max("x").alias("_d"))
    open_ = c.join(F.broadcast(box)).where("i in (_a, _b) or x in (_c, _d)").select("c").distinct()
    return c.join(open_, "c", "left_anti").select(*TRACE, "c")


def filled_traces(points: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """(i, x) of the surface with its holes filled, without dead traces."""
    out = points.select(*TRACE).union(holes(points).select(*TRACE))
    return out.join(dead.select(*TRACE), TRACE, "left_anti") if dead is not None else out


def borders(points: DataFrame) -> DataFrame:
    """(i, x) with an absent 8-neighbour once holes are filled."""
    f = filled_traces(points).withColumn("d", F.lit(0)).withColumn("s", F.lit("a"))
    return surface.boundary(f, "s").select(*TRACE)


def shape_report(points: DataFrame, alive: DataFrame) -> DataFrame:
    """One row: traces, traces with holes filled, both as shares of the alive
    traces, solidity, border traces and number of holes (8-connected)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    filled = filled_traces(points)
    parts = [one(points, "n"), one(filled, "filled"), one(alive.select(*TRACE).distinct(), "alive"), one(borders(points), "perimeter"), holes(points, False).agg(F.count_distinct("c").alias("holes"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    share = lambda a, b: F.round(F.col(a) / F.col(b), 5)
    return out.select("n", "filled", share("n", "alive").alias("coverage"), share("filled", "alive").alias("filled_coverage"), share("n", "filled").alias("solidity"), "perimeter", "holes", (F.col("n") < F.col("filled") / 2).alias("is_carcass"))


# --- gradients, spikes, probabilities ----------------------------------------
def gradients(surfaces: DataFrame, by: str) -> DataFrame:
    """(by, i, x, gi, gx): differences to the preceding trace along both axes."""
    a, b = (surface.gradient(surfaces, by, axis).withColumnRenamed("g", f"g{axis}") for axis in TRACE)
    return a.join(b, [by, *TRACE])


def gradient_map(surfaces: DataFrame, by: str, threshold: float = 1) -> DataFrame:
    """Sum of both gradients, those within ``threshold`` counting 0; null where one is absent."""
    cut = lambda c: F.when(F.abs(c) <= threshold, 0).otherwise(F.col(c))
    return gradients(surfaces, by).select(by, *TRACE, (cut("gi") + cut("gx")).alias("g"))


def max_gradient(surfaces: DataFrame, by: str) -> DataFrame:
    """Absolute value of the larger gradient, and the larger absolute value; absent ones don't count."""
    g = gradients(surfaces, by)
    return g.select(by, *TRACE, F.abs(F.greatest("gi", "gx")).alias("of_max"), F.greatest(F.abs("gi"), F.abs("gx")).alias("of_abs"))


def spikes(surfaces: DataFrame, by: str, width: int = 7, size: float = 5, close: float = 2, distance: int = 3) -> DataFrame:
    """Points of spikes: a jump of ``size`` or more over ``distance`` traces
    that returns, within ``width`` more, to within ``close`` of where it began;
    looked for in four directions, the points in between are marked."""

    def f(a: np.ndarray) -> np.ndarray:
        mark = np.zeros(a.shape, bool)
        with np.errstate(invalid="ignore"):
            for di, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                jump = np.abs(stencil.shifted(a, distance * di, distance * dx) - a) >= size
                done = np.zeros(a.shape, bool)
                for e in range(distance + 1, distance + width + 1):
                    back = jump & ~done & (np.abs(stencil.shifted(a, e * di, e * dx) - a) <= close)
                    done |= back
                    for o in range(1, e):
                        mark |= stencil.shifted(back.astype(float), -o * di, -o * dx) == 1
        return np.where(mark, a, np.nan)

    return stencil.by_tiles(surfaces, [by], f, distance + width).select(by, *TRACE, _long("d"))


def probabilities(points: DataFrame, predicted: DataFrame) -> DataFrame:
    """(i, x, d, p): the mean probability of voxels (i, x, d, p) at the surface's points, null where there is none."""
    p = predicted.groupBy(*TRACE, "d").agg(F.round(F.avg("p"), 6).alias("p"))
    return points.select(*TRACE, "d").join(p, [*TRACE, "d"], "left")


# --- passes ------------------------------------------------------------------
def smooth_out(surfaces: DataFrame, by: str, times: int = 1, sides: tuple[int, int] = (3, 3), sigma: float = 0.8, max_difference: float = 5, sigma_range: float | None = None, whole: bool = True) -> DataFrame:
    """Gaussian (with ``sigma_range`` bilateral) smoothing in passes; whole depths unless ``whole`` is false."""
    out = surface.smooth(surfaces, by, stencil.gaussian_kernel(sides, sigma).tolist(), max_difference, sigma_range, times)
    return out.select(by, *TRACE, _long("d")) if whole else out


def inpaint(surfaces: DataFrame, by: str, radius: int = 3, passes: int = 24, margin: float = 10) -> DataFrame:
    """Absent traces within ``radius`` steps of present ones get the value of a
    membrane stretched over them: ``passes`` means of the four neighbours.
    Values over ``margin`` beyond the surface's depths are dropped."""
    def f(a: np.ndarray) -> np.ndarray:
        known = np.isfinite(a)
        near, b = known.copy(), a.copy()
        four = lambda v: np.stack([stencil.shifted(v, *o) for o in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        for _ in range(radius):
            near |= (four(near.astype(float)) == 1).any(axis=0)
        for _ in range(passes):
            n = four(b)
            here = np.isfinite(n)
            count = here.sum(axis=0)
            mean = np.where(count > 0, np.nan_to_num(n).sum(axis=0) / np.maximum(count, 1), np.nan)
            b = np.where(known, a, np.where(near, mean, np.nan))
        return b

    out = stencil.by_tiles(surfaces, [by], f, passes + radius)
    e = surfaces.groupBy(by).agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    return out.join(e, by).where((F.col("d") >= F.col("_lo") - margin) & (F.col("d") <= F.col("_hi") + margin)).select(by, *TRACE, F.round("d", 6).alias("d"))


def enlarge(surfaces: DataFrame, by: str, width: int = 3) -> DataFrame:
    """A carcass made thicker: absent traces within width // 2 along an axis take
    the largest depth there, the mean of both where both axes have one."""
    k = width // 2

    def f(a: np.ndarray) -> np.ndarray:
        top = lambda v: np.where(np.isnan(v), -np.inf, v).max(axis=0)
        p, q = top(stencil.neighbourhood(a, k, 0)), top(stencil.neighbourhood(a, 0, k))
        both = np.where(np.isinf(p), q, np.where(np.isinf(q), p, (p + q) / 2))
        return np.where(np.isfinite(a), a, np.where(np.isinf(both), np.nan, both))

    return stencil.by_tiles(surfaces, [by], f, max(k, 1))


# --- comparison ----------------------------------------------------------------
def equal(a: DataFrame, b: DataFrame, missing: int = 0) -> DataFrame:
    """One row: whether two surfaces agree, all but ``missing`` traces being in both and the mean difference 0."""
    j = a.select(*TRACE, F.col("d").alias("p")).join(b.select(*TRACE, F.col("d").alias("q")), TRACE, "full")
    alone = F.count(F.when(F.col("p").isNull() | F.col("q").isNull(), 1))
    gap = F.avg(F.abs(F.col("p") - F.col("q")))
    return j.agg(alone.alias("alone"), F.round(gap, 6).alias("gap"), ((alone <= missing) & (F.coalesce(gap, F.lit(0.0)) == 0)).alias("equal"))


def float_correction(window: DataFrame, exact: DataFrame) -> DataFrame:
    """Amplitudes (i, x, w, amp) along whole depths d moved to exact depths
    (i, x, f): the mean of a sample and its neighbour on that side, weighted by nearness."""
    w = Window.partitionBy(*TRACE).orderBy("w")
    j = window.join(exact.select(*TRACE, (F.col("f")).alias("f")), TRACE)
    shift = F.col("f") - F.col("d")
    beside = F.when(shift > 0, F.lead("amp").over(w)).otherwise(F.lag("amp").over(w))
    return j.select(*TRACE, "w", F.round(F.col("amp") * (1 - F.abs(shift)) + F.coalesce(beside, F.col("amp")) * F.abs(shift), 6).alias("amp"))


def report(points: DataFrame, alive: DataFrame) -> DataFrame:
    """One row of summary figures."""
    s = points.agg(F.count("*").alias("n"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.round(F.avg("d"), 6).alias("d_mean"), F.round(F.stddev_pop("d"), 6).alias("d_std"))
    total = alive.select(*TRACE).distinct().agg(F.count("*").alias("_n"))
    return s.join(F.broadcast(total)).select("n", F.round(F.col("n") / F.col("_n"), 5).alias("coverage"), "d_min", "d_max", "d_mean", "d_std")


# --- coordinates -----------------------------------------------------------------
def thin_line(points: DataFrame, by: list[str], column: str, order: list[str]) -> DataFrame:
    """One point for each value of ``column``: the first in ``order``."""
    w = Window.partitionBy(*by, column).orderBy(*order)
    return points.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def dilate_points(points: DataFrame, axis: str, by: int = 3, least: int = 0, most: int | None = None) -> DataFrame:
    """Distinct points and their copies up to by // 2 along ``axis``, inside least..most."""
    k = by // 2
    e = points.select(*points.columns, F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("_k")).withColumn(axis, F.col(axis) + F.col("_k")).drop("_k")
    e = e.where(F.col(axis) >= least)
    return (e.where(F.col(axis) <= most) if most is not None else e).distinct()


def contour(points: DataFrame, by: str, axis: str = "d") -> DataFrame:
    """The outer points of each body seen along ``axis``, as (by, u, v): those with an absent 8-neighbour."""
    u, v = (c for c in "ixd" if c != axis)
    p = points.select(by, F.col(u).alias("i"), F.col(v).alias("x")).distinct().withColumn("d", F.lit(0))
    return surface.boundary(p, by).select(by, F.col("i").alias("u"), F.col("x").alias("v"))


def longest_run(points: DataFrame, by: str, axis: str, gap: int = 2) -> DataFrame:
    """(by, lo, hi, n): the longest run of distinct values along ``axis`` whose
    neighbours differ by ``gap`` at most (ties: the first)."""
    w = Window.partitionBy(by).orderBy(axis)
    u = points.select(by, axis).distinct()
    u = u.withColumn("_g", F.sum(F.when(F.col(axis) - F.lag(axis).over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = u.groupBy(by, "_g").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"), F.count("*").alias("n"))
    best = r.groupBy(by).agg(F.max(F.struct("n", (-F.col("lo")).alias("m"), "hi")).alias("b"))
    return best.select(by, (-F.col("b.m")).alias("lo"), F.col("b.hi").alias("hi"), F.col("b.n").alias("n"))

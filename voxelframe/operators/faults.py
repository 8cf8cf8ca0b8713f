"""Faults as points (fault, i, x, d): sizes, filters, neighbours, sticks, and
extraction from 2-D components of slides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import grid_components, label


# --- boxes ---------------------------------------------------------------------
def boxes(points: DataFrame, by: str = "fault") -> DataFrame:
    """(by, n, i0, i1, x0, x1, d0, d1): points and inclusive boxes."""
    return points.groupBy(by).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{k}") for c in "ixd" for k, f in enumerate((F.min, F.max))))


def overlap(axis: str, a: str = "a", b: str = "b") -> Column:
    """Cells that two boxes share along an axis; minus the gap if they don't meet."""
    return F.least(F.col(f"{a}.{axis}1"), F.col(f"{b}.{axis}1")) - F.greatest(F.col(f"{a}.{axis}0"), F.col(f"{b}.{axis}0")) + 1


def intersected(a: str = "a", b: str = "b", axes: str = "ixd") -> Column:
    out = F.lit(True)
    for c in axes:
        out = out & (overlap(c, a, b) >= 1)
    return out


def adjacent(a: str = "a", b: str = "b", gap: int = 1) -> Column:
    """Along each axis at most ``gap`` apart."""
    out = F.lit(True)
    for c in "ixd":
        out = out & (overlap(c, a, b) >= 1 - gap)
    return out


def embedded(a: str = "a", b: str = "b", margin: int = 3) -> Column:
    """a within b, give or take ``margin``."""
    out = F.lit(True)
    for c in "ixd":
        out = out & (F.col(f"{a}.{c}0") >= F.col(f"{b}.{c}0") - margin) & (F.col(f"{a}.{c}1") <= F.col(f"{b}.{c}1") + margin)
    return out


def box_pairs(table: DataFrame, by: str, gap: int = 1, cell: int = 64) -> DataFrame:
    """Pairs (a, b) of rows of ``boxes`` whose boxes are within ``gap``, a < b,
    as structs. Boxes meet only in shared cells of a grid over (i, x)."""
    near = lambda c: F.sequence(F.floor((F.col(f"{c}0") - gap) / cell), F.floor((F.col(f"{c}1") + gap) / cell))
    e = table.withColumn("ci", F.explode(near("i"))).withColumn("cx", F.explode(near("x"))).select(F.struct(*table.columns).alias("r"), "ci", "cx")
    j = e.withColumnRenamed("r", "a").join(e.withColumnRenamed("r", "b"), ["ci", "cx"]).where(F.col(f"a.{by}") < F.col(f"b.{by}"))
    return j.where(adjacent("a", "b", gap)).select("a", "b").distinct()


# --- filters -----------------------------------------------------------------------
def size_filter(points: DataFrame, by: str = "fault", length: float = 2000, height: float = 20, n: int = 30) -> DataFrame:
    """Faults with at least ``n`` points, a horizontal extent of ``length`` and a ``height``."""
    s = boxes(points, by)
    extent = F.sqrt(F.pow(F.col("i1") - F.col("i0"), 2) + F.pow(F.col("x1") - F.col("x0"), 2))
    ok = s.where((F.col("n") >= n) & (extent >= length) & (F.col("d1") - F.col("d0") >= height)).select(by)
    return points.join(ok, by, "left_semi")


def near_pairs(points: DataFrame, by: str = "fault", gap: int = 5, least: int = 5) -> DataFrame:
    """(a, b): faults whose boxes are within ``gap`` and that both have ``least``
    points or more in the shared zone, which reaches ``gap`` over each box."""
    p = box_pairs(boxes(points, by), by, gap)
    z = p.select(F.col(f"a.{by}").alias("a"), F.col(f"b.{by}").alias("b"), *(f for c in "ixd" for f in ((F.greatest(F.col(f"a.{c}0"), F.col(f"b.{c}0")) - gap).alias(f"{c}0"), (F.least(F.col(f"a.{c}1"), F.col(f"b.{c}1")) + gap).alias(f"{c}1"))))
    inside = F.expr("i >= i0 and i <= i1 and x >= x0 and x <= x1 and d >= d0 and d <= d1")
    out = z.select("a", "b")
    for k in ("a", "b"):
        n = z.join(points.withColumnRenamed(by, k), k).where(inside).groupBy("a", "b").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("a", "b")
        out = out.join(n, ["a", "b"], "left_semi")
    return out


def without_lone(points: DataFrame, by: str = "fault", height: float = 200, width: float = 40, gap: int = 5, least: int = 5) -> DataFrame:
    """Small faults that have no neighbour are dropped."""
    s = boxes(points, by)
    big = s.where((F.col("d1") - F.col("d0") >= height) | (F.greatest(F.col("i1") - F.col("i0"), F.col("x1") - F.col("x0")) >= width)).select(by)
    p = near_pairs(points, by, gap, least)
    keep = big.union(p.select(F.col("a").alias(by))).union(p.select(F.col("b").alias(by))).distinct()
    return points.join(keep, by, "left_semi")


def groups(points: DataFrame, by: str = "fault", gap: int = 5, least: int = 5) -> DataFrame:
    """(by, group): faults that neighbours connect; group is the smallest code."""
    codes = points.select(by).distinct().select(by, F.xxhash64(by).alias("_c"))
    p = near_pairs(points, by, gap, least)
    a = p.join(codes.select(F.col(by).alias("a"), F.col("_c").alias("ca")), "a").join(codes.select(F.col(by).alias("b"), F.col("_c").alias("cb")), "b")
    lab = label(a.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    g = codes.join(lab.select(F.col("n").alias("_c"), F.col("c").alias("_g")), "_c", "left").select(by, F.coalesce("_g", "_c").alias("_g"))
    names = g.groupBy("_g").agg(F.min(by).alias("group"))
    return g.join(names, "_g").select(by, "group")


def biggest_groups(points: DataFrame, by: str = "fault", top: int = 5, gap: int = 5, least: int = 5) -> DataFrame:
    """(by, group, height, rank) of the ``top`` groups by height (ties: smaller name)."""
    g = groups(points, by, gap, least)
    h = points.join(g, by).groupBy("group").agg((F.max("d") - F.min("d")).alias("height"))
    r = h.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("height"), "group")).cast("long")).where(F.col("rank") <= top)  # groups, not points
    return g.join(r, "group").select(by, "group", "height", "rank")


def direction(points: DataFrame, by: str = "fault") -> DataFrame:
    """(by, axis): 0 if the fault's extent along i is at least that along x on its median depth, else 1."""
    mid = points.groupBy(by).agg(F.expr("percentile_disc(0.5) within group (order by d)").cast("long").alias("_m"))
    s = points.join(mid, by).where("d = _m").groupBy(by).agg((F.max("i") - F.min("i")).alias("a"), (F.max("x") - F.min("x")).alias("b"))
    return s.select(by, F.when(F.col("a") >= F.col("b"), 0).otherwise(1).cast("long").alias("axis"))


# --- sticks -------------------------------------------------------------------------
def points_to_sticks(points: DataFrame, by: str = "fault", axis: str = "i", step: int = 10, nodes: int = 10, least: int = 5) -> DataFrame:
    """(by, stick, i, x, d): on every ``step``-th line along ``axis`` (from the
    least) with ``least`` depths or more, the mean place at every ``nodes``-th
    depth (from the least), and at the last."""
    other = "x" if axis == "i" else "i"
    m = points.groupBy(by, axis, "d").agg(F.avg(other).alias(other))
    w, s = Window.partitionBy(by), Window.partitionBy(by, axis)
    m = m.withColumns({"_a": F.min(axis).over(w), "_d0": F.min("d").over(s), "_d1": F.max("d").over(s), "_n": F.count("*").over(s)})
    on = ((F.col(axis) - F.col("_a")) % step == 0) & (F.col("_n") >= least) & (((F.col("d") - F.col("_d0")) % nodes == 0) | (F.col("d") == F.col("_d1")))
    return m.where(on).select(by, F.col(axis).alias("stick"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in "ix"), "d")


def stick_faults(nodes: DataFrame) -> DataFrame:
    """(fault, sticks, one_node, level): a report on sticks (fault, stick, i, x,
    d): how many there are, how many have one node, how many repeat a depth."""
    s = nodes.groupBy("fault", "stick").agg(F.count("*").alias("n"), F.count_distinct("d").alias("u"))
    return s.groupBy("fault").agg(F.count("*").alias("sticks"), F.count(F.when(F.col("n") == 1, 1)).alias("one_node"), F.count(F.when(F.col("u") < F.col("n"), 1)).alias("level"))


def nodes_on_lines(nodes: DataFrame) -> DataFrame:
    """Nodes copied to the lines up to the next stick of the fault."""
    sticks = nodes.select("fault", "stick").distinct()
    nxt = sticks.withColumn("_next", F.lead("stick").over(Window.partitionBy("fault").orderBy("stick")))
    e = nodes.join(nxt, ["fault", "stick"]).withColumn("line", F.explode(F.sequence(F.col("stick"), F.coalesce(F.col("_next") - 1, F.col("stick")))))
    return e.select("fault", "stick", "line", "x", "d")


# --- components of slides ---------------------------------------------------------------
def slide_components(mask: DataFrame, axis: str = "i") -> DataFrame:
    """(i, x, d, c): 8-connected parts within each slide along ``axis``; lines
    are spread apart so that slides don't touch."""
    other = "x" if axis == "i" else "i"
    v = mask.select((F.col(axis) * 2).alias(axis), other, "d")
    axes = [axis, other, "d"]
    c = grid_components(v, axes, f"({axis} * {1 << 20}L + {other}) * {1 << 20}L + d")
    return c.select((F.col(axis) / 2).cast("long").alias(axis), other, "d", "c").select("i", "x", "d", "c")


def slide_links(parts: DataFrame, axis: str = "i", reach: int = 1) -> DataFrame:
    """(a, b, contact): parts of neighbouring slides with points within
    ``reach`` along the other axes, and how many points of a touch b."""
    other = "x" if axis == "i" else "i"
    off = F.sequence(F.lit(-reach), F.lit(reach))
    e = parts.select(F.col("c").alias("a"), (F.col(axis) + 1).alias(axis), F.col(other).alias("_o"), F.col("d").alias("_d"), F.explode(off).alias("_p")).select("*", F.explode(off).alias("_q"))
    e = e.select("a", axis, (F.col("_o") + F.col("_p")).alias(other), (F.col("_d") + F.col("_q")).alias("d"), "_o", "_d")
    j = e.join(parts.select(F.col("c").alias("b"), "i", "x", "d"), ["i", "x", "d"])
    return j.select("a", "b", "_o", "_d").distinct().groupBy("a", "b").agg(F.count("*").alias("contact"))


def chained(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(i, x, d, c, p): prototypes: each part goes on in that part of the next
    slide which touches it most, if it is also that one's best predecessor
    (ties: smaller name); chains are contracted."""
    best = Window.partitionBy("a").orderBy(F.desc("contact"), "b")
    back = Window.partitionBy("b").orderBy(F.desc("contact"), "a")
    mutual = links.withColumns({"_f": F.row_number().over(best), "_g": F.row_number().over(back)}).where("_f = 1 and _g = 1")
    lab = label(mutual.select("a", "b")).select(F.col("n").alias("c"), F.col("c").alias("_p"))
    return parts.join(lab, "c", "left").select("i", "x", "d", "c", F.coalesce("_p", "c").alias("p"))


def extract(mask: DataFrame, axis: str = "i", height: int = 40, width: int = 20, n: int = 100, reach: int = 1) -> DataFrame:
    """(fault, i, x, d) from voxels: parts of slides, chained, without small ones."""
    from ..session import cut

    parts = cut(slide_components(mask, axis))
    p = chained(parts, slide_links(parts, axis, reach)).select(F.col("p").alias("fault"), "i", "x", "d")
    s = boxes(p)
    ok = s.where((F.col("d1") - F.col("d0") + 1 >= height) & (F.greatest(F.col("i1") - F.col("i0"), F.col("x1") - F.col("x0")) + 1 >= width) & (F.col("n") >= n)).select("fault")
    return p.join(ok, "fault", "left_semi")


def contact(points: DataFrame, by: str = "fault") -> DataFrame:
    """(a, b, n): places (i, x) where a point of a lies just over one of b."""
    up = points.select(F.col(by).alias("a"), "i", "x", (F.col("d") + 1).alias("d"))
    return up.join(points.withColumnRenamed(by, "b"), ["i", "x", "d"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def contour_overlap(points: DataFrame, by: str = "fault", width: int = 3) -> DataFrame:
    """(a, b, n, share): points of a's contour (seen along x) within width // 2
    along i of b's, and their share of the shorter contour; a < b."""
    from .surface_maps import contour

    c = contour(points, by, "x")
    k = width // 2
    e = c.select(F.col(by).alias("a"), "u", "v", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("_k")).select("a", F.col("u").alias("_u"), (F.col("u") + F.col("_k")).alias("u"), "v")
    hit = e.join(c.withColumnRenamed(by, "b"), ["u", "v"]).where("a < b").select("a", "b", "_u", "v").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    size = c.groupBy(by).agg(F.count("*").alias("_n"))
    j = hit.join(size.select(F.col(by).alias("a"), F.col("_n").alias("na")), "a").join(size.select(F.col(by).alias("b"), F.col("_n").alias("nb")), "b")
    return j.select("a", "b", "n", F.round(F.col("n") / F.least("na", "nb"), 6).alias("share"))


def connected_groups(overlaps: DataFrame, ratio: float = 0.0) -> DataFrame:
    """(n, c): numbered bodies whose contours overlap by more than ``ratio``."""
    return label(overlaps.where(F.col("share") > ratio).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))


def split_at(points: DataFrame, by: str, axis: str, at: list[int]) -> DataFrame:
    """Bodies cut at the given coordinates of ``axis``, and each part again where
    its distinct coordinates along the other horizontal axis have gaps: (by, part, i, x, d)."""
    other = "x" if axis == "i" else "i"
    part = sum(((F.col(axis) >= k).cast("int") for k in at), F.lit(0))
    p = points.withColumn("_p", part)
    u = p.select(by, "_p", other).distinct()
    w = Window.partitionBy(by, "_p").orderBy(other)
    u = u.withColumn("_g", F.sum(F.when(F.col(other) - F.lag(other).over(w) > 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.join(u, [by, "_p", other]).select(by, F.concat_ws("-", "_p", "_g").alias("part"), "i", "x", "d")


def horseshoe_cuts(points: DataFrame, by: str = "fault", ratio: float = 0.7, least: int = 30) -> DataFrame:
    """(by, i): lines where a body's height falls to ``ratio`` of both the line
    before and the line after, by more than ``least``."""
    h = points.groupBy(by, "i").agg((F.max("d") - F.min("d") + 1).alias("h"))
    w = Window.partitionBy(by).orderBy("i")
    a, b = F.lag("h").over(w), F.lead("h").over(w)
    h = h.withColumns({"_a": a, "_b": b})
    return h.where((F.col("h") <= ratio * F.col("_a")) & (F.col("h") <= ratio * F.col("_b")) & (F.col("_a") - F.col("h") > least) & (F.col("_b") - F.col("h") > least)).select(by, "i")


def restore(projected: DataFrame, points: DataFrame, axis: str = "x") -> DataFrame:
    """Points of a projection along ``axis`` (i, d) with the least coordinate along it."""
    keys = [c for c in "ixd" if c != axis]
    m = points.groupBy(*keys).agg(F.min(axis).alias(axis))
    return projected.join(m, keys).select(*"ixd")


def rasterized(nodes: DataFrame, width: float = 1.0) -> DataFrame:
    from ..functions.geometry import sticks_to_points

    return sticks_to_points(nodes, width)


def skeleton_depths(points: DataFrame, by: str = "fault") -> DataFrame:
    """(by, i, d, x): one point for each line and depth: the median place along x (the lower of two)."""
    a = F.array_sort(F.collect_list("x"))
    return points.groupBy(by, "i", "d").agg(a.alias("_a")).select(by, "i", "d", F.get("_a", ((F.size("_a") - 1) / 2).cast("int")).alias("x"))


def stick_order(nodes: pd.DataFrame) -> np.ndarray:
    """Numbers of sticks (columns stick, i, x, d) along the first principal axis of their centres."""
    c = nodes.groupby("stick")[["i", "x"]].mean()
    z = c.to_numpy() - c.to_numpy().mean(0)
    axis = np.linalg.svd(z, full_matrices=False)[2][0]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    return c.index.to_numpy()[np.argsort(z @ axis, kind="stable")]

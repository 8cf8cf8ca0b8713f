"""Connected components of voxel masks, of surfaces and of graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Side of the cubes of voxels that are labelled by one task each.
TILE = 48


def label(edges: DataFrame) -> DataFrame:
    """(n, c): for each node of ``edges`` (a, b) the smallest node that it
    reaches. Large-star and small-star contractions alternate until nothing
    changes; each is a pre-aggregated minimum and an equi-join, and what is
    written after each is compared by its count and a sum of hashes."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        e = cut(large.join(down, "a").select(F.explode(ends).alias("x")).select("x.a", "x.b").where("a <> b").distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("n"), F.col("b").alias("c")).union(e.select(F.col("b"), F.col("b")).distinct())


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that edges (a, b) reach: minima
    are passed along all edges at once, then pointers jump."""
    c = np.arange(n)
    while True:
        before = c.copy()
        low = np.minimum(c[a], c[b])
        np.minimum.at(c, c[a], low)
        np.minimum.at(c, c[b], low)
        np.minimum.at(c, a, low)
        np.minimum.at(c, b, low)
        while not np.array_equal(c, c[c]):
            c = c[c]
        if np.array_equal(c, before):
            return c


def _half(axes: int, cross: bool = False) -> list[tuple[int, ...]]:
    """The offsets to neighbours, one of each two opposite ones; with ``cross``
    only those along an axis."""
    every = np.stack(np.meshgrid(*[[-1, 0, 1]] * axes, indexing="ij"), -1).reshape(-1, axes)
    return [tuple(int(v) for v in o) for o in every if tuple(o) > (0,) * axes and not (cross and np.abs(o).sum() > 1)]


def _local(axes: list[str], side: int, cross: bool):
    """Labels within one tile: the smallest code ``n`` of the voxels that hang together."""

    def run(t: pa.Table) -> pa.Table:
        at = [t.column(c).to_numpy() % side for c in axes]
        n = t.column("n").to_numpy()
        box = np.full((side + 2,) * len(axes), -1)
        box[tuple(v + 1 for v in at)] = np.arange(len(n))
        a, b = [], []
        for o in _half(len(axes), cross):
            other = box[tuple(v + 1 + k for v, k in zip(at, o, strict=True))]
            a.append(np.flatnonzero(other >= 0))
            b.append(other[other >= 0])
        c = union_find(len(n), np.concatenate(a), np.concatenate(b))
        least = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(least, c, n)
        return t.select([*axes, "n"]).append_column("c", pa.array(least[c]))

    return run


def grid_components(cells: DataFrame, axes: list[str], code: str, side: int = TILE, cross: bool = False) -> DataFrame:
    """(axes, n, c) of distinct cells: components of neighbours that differ by
    one at most along each axis (along one axis only with ``cross``); c is the smallest code n of the component.
    ``code`` is an expression of the axes, different for each cell. Tiles are
    labelled by one task each; the labels that meet at borders of tiles make a
    graph, which is contracted; only cells at borders are joined."""
    v = cells.select(*(F.col(c).cast("long").alias(c) for c in axes)).distinct().withColumn("n", F.expr(code).cast("long"))
    tiles = [F.floor(F.col(c) / side).alias(f"_t{c}") for c in axes]
    schema = ", ".join([*(f"{c} bigint" for c in axes), "n bigint, c bigint"])
    local = cut(v.select("*", *tiles).groupBy(*(f"_t{c}" for c in axes)).applyInArrow(_local(axes, side, cross), schema))
    border = " or ".join(f"pmod({c}, {side}) in (0, {side - 1})" for c in axes)
    edge = local.where(border).select(*axes, "c")
    steps = F.array(*(F.struct(*(F.lit(k).alias(f"d{c}") for c, k in zip(axes, o, strict=True))) for o in _half(len(axes), cross)))
    moved = edge.select(*axes, F.col("c").alias("a"), F.explode(steps).alias("o")).select(*((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in axes), "a")
    links = moved.join(edge, axes).where("a <> c").select("a", F.col("c").alias("b")).distinct()
    joined = label(links).select(F.col("n").alias("c"), F.col("c").alias("_c"))
    return local.join(joined, "c", "left").select(*axes, "n", F.coalesce("_c", "c").alias("c"))


def voxel_components(voxels: DataFrame, extent: tuple[int, int] = (1 << 20, 1 << 20)) -> DataFrame:
    """(i, x, d, c): 26-connected components of the distinct voxels; c is the
    smallest code (i * nx + x) * nd + d of its voxels."""
    nx, nd = extent
    return grid_components(voxels, ["i", "x", "d"], f"(i * {nx}L + x) * {nd}L + d").drop("n")


def surfaces_from_mask(voxels: DataFrame, least: int, extent: tuple[int, int] = (1 << 20, 1 << 20), how: str = "mean") -> DataFrame:
    """(c, i, x, d): one depth by trace (mean, min, max or prob) of each component with ``least`` traces or more."""
    from .surface import trace_surface

    v = voxel_components(voxels, extent)
    if how == "prob":
        v = v.join(voxels.select("i", "x", "d", "p"), ["i", "x", "d"])
    s = trace_surface(v, how, ["c"])
    big = s.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("c")
    return s.join(big, "c", "left_semi")


def from_mask(mask: DataFrame, threshold: float = 0.5, how: str = "mean", least: int = 0, extent: tuple[int, int] = (1 << 20, 1 << 20)) -> DataFrame:
    """(rank, c, i, x, d) from voxels (i, x, d, p): those of p >= threshold, as
    surfaces, the largest first (ties: smaller name)."""
    from pyspark.sql import Window

    s = surfaces_from_mask(mask.where(F.col("p") >= threshold).groupBy("i", "x", "d").agg(F.max("p").alias("p")), least, extent, how)
    n = s.groupBy("c").agg(F.count("*").alias("n"))
    rank = n.select("c", F.row_number().over(Window.orderBy(F.desc("n"), "c")).cast("long").alias("rank"))
    return s.join(rank, "c").select("rank", "c", "i", "x", "d")


def largest(components: DataFrame) -> DataFrame:
    """The component of most voxels (ties: smallest name)."""
    top = components.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(1).select("c")
    return components.join(F.broadcast(top), "c", "left_semi")

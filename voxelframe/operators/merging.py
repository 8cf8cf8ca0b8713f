"""Merging of surfaces (s, i, x, d) and their extraction from masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .components import grid_components, label

TRACE = ["i", "x"]
#: Results of a comparison.
DEPTH_SEPARATED, TOO_SMALL, TOO_BIG, ADJACENT, OVERLAPPING, SEPARATED = 0, 1, 2, 3, 4, 5


def compared(surfaces: DataFrame, mean: float = 1.0, most: float = 2.0, gap: int = 0, least: int = 1, largest: int | None = None, key: str = "s") -> DataFrame:
    """(a, b, overlap, gap_mean, status) of the pairs a < b whose boxes are at
    most ``gap`` apart along both axes; pairs farther apart are SEPARATED and
    not listed. ADJACENT: no common trace; DEPTH_SEPARATED: the mean difference
    is over ``mean`` or one is over ``most``; else by the size of the overlap."""
    box = surfaces.groupBy(key).agg(*(f(c).alias(f"{c}{k}") for c in "ix" for k, f in enumerate((F.min, F.max))))
    p, q = (box.select(F.struct(*box.columns).alias(t)) for t in "ab")
    pairs = p.join(q, F.col(f"a.{key}") < F.col(f"b.{key}"))  # boxes of surfaces, not points
    for c in "ix":
        pairs = pairs.where(F.least(F.col(f"a.{c}1"), F.col(f"b.{c}1")) - F.greatest(F.col(f"a.{c}0"), F.col(f"b.{c}0")) + 1 >= 1 - gap)
    pairs = pairs.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))
    e = F.abs(F.col("da") - F.col("db"))
    j = surfaces.select(*TRACE, F.col(key).alias("a"), F.col("d").alias("da")).join(surfaces.select(*TRACE, F.col(key).alias("b"), F.col("d").alias("db")), TRACE).where("a < b")
    m = j.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(e).alias("m"), F.max(e).alias("w"))
    far = (F.col("w") > most) | (F.col("m") > mean)
    status = F.when(F.col("n").isNull(), ADJACENT).when(far, DEPTH_SEPARATED).when(F.col("n") < least, TOO_SMALL)
    if largest is not None:
        status = status.when(F.col("n") > largest, TOO_BIG)
    return pairs.join(m, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("overlap"), F.round("m", 6).alias("gap_mean"), status.otherwise(OVERLAPPING).cast("long").alias("status"))


def adjacent_links(surfaces: DataFrame, mean: float = 3.0, gap: int = 3, key: str = "s") -> DataFrame:
    """(a, b): surfaces that come within ``gap`` traces of each other and there
    differ by less than ``mean`` on average from the other's largest depth nearby."""
    off = F.sequence(F.lit(-gap), F.lit(gap))
    e = surfaces.select(F.col(key).alias("b"), "i", "x", F.col("d").alias("o"), F.explode(off).alias("_p")).select("*", F.explode(off).alias("_q"))
    big = e.groupBy("b", (F.col("i") + F.col("_p")).alias("i"), (F.col("x") + F.col("_q")).alias("x")).agg(F.max("o").alias("o"))
    j = surfaces.withColumnRenamed(key, "a").join(big, TRACE).where("a <> b").groupBy("a", "b").agg(F.avg(F.abs(F.col("d") - F.col("o"))).alias("m")).where(F.col("m") < mean)
    return j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(surfaces: DataFrame, links: DataFrame, key: str = "s") -> DataFrame:
    """Surfaces that links (a, b) connect become one, of the smallest name; where
    several have a trace, the floor of their mean depth."""
    codes = surfaces.select(key).distinct().select(key, F.xxhash64(key).alias("_c"))
    a = links.join(codes.select(F.col(key).alias("a"), F.col("_c").alias("ca")), "a").join(codes.select(F.col(key).alias("b"), F.col("_c").alias("cb")), "b")
    lab = label(a.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("n").alias("_c"), F.col("c").alias("_g"))
    g = codes.join(lab, "_c", "left").select(key, F.coalesce("_g", "_c").alias("_g"))
    names = g.groupBy("_g").agg(F.min(key).alias("_name"))
    to = g.join(names, "_g").select(key, "_name")
    return surfaces.join(to, key).groupBy(F.col("_name").alias(key), *TRACE).agg(F.floor(F.avg("d")).cast("long").alias("d"))


def merge_list(surfaces: DataFrame, mean: float = 1.0, most: float = 2.2, gap: int = 1, least: int = 1, adjacent: bool = True, key: str = "s") -> DataFrame:
    """Surfaces merged until no two can be: in each round all that overlap well
    (and, with ``adjacent``, all that come near) are joined at once, so that the
    result doesn't depend on an order."""
    now = cut(surfaces)
    while True:
        links = compared(now, mean, most, gap, least, key=key).where(F.col("status") == OVERLAPPING).select("a", "b")
        if adjacent:
            near = adjacent_links(now, mean, gap, key)
            links = links.union(near.join(compared(now, mean, most, gap, least, key=key).where(F.col("status") == ADJACENT).select("a", "b"), ["a", "b"], "left_semi"))
        links = cut(links.distinct())
        if links.isEmpty():
            return now
        now = cut(joined(now, links, key))


def merge_into(first: DataFrame, others: DataFrame, mean: float = 1.0, most: float = 1.2, gap: int = 1, least: int = 1, key: str = "s") -> DataFrame:
    """``first`` (one surface, i, x, d) with all of ``others`` that it can absorb,
    one round after another, until none is left that fits: (i, x, d)."""
    name = others.agg(F.max(key)).first()[0]
    own = "" if name is None else f"{name}~"  # after all others, hence b in comparisons
    now, left = cut(first.select(*TRACE, "d")), cut(others)
    while True:
        both = left.select(key, *TRACE, "d").union(now.select(F.lit(own).alias(key), *TRACE, "d"))
        fits = cut(compared(both, mean, most, gap, least, key=key).where((F.col("b") == own) & (F.col("status") == OVERLAPPING)).select(F.col("a").alias(key)))
        if fits.isEmpty():
            return now
        more = left.join(fits, key, "left_semi").select(*TRACE, "d")
        now = cut(now.union(more).groupBy(*TRACE).agg(F.floor(F.avg("d")).cast("long").alias("d")))
        left = cut(left.join(fits, key, "left_anti"))


def extract_from_mask(voxels: DataFrame, least: int = 1000, rounds: int = 64) -> DataFrame:
    """(s, i, x, d): surfaces from voxels (i, x, d). Each round takes the upper
    envelope of every connected body, labels its parts anew (one depth a trace)
    and removes it from the mask; parts of ``least`` traces or more are kept. A
    body of one depth a trace is done in one round; ``rounds`` bounds the layers
    of one body (an error if it isn't enough, never a loss)."""
    code = f"(i * {1 << 20}L + x) * {1 << 20}L + d"
    left, out = cut(voxels.select("i", "x", "d").distinct()), None
    for k in range(rounds):
        if left.isEmpty():
            break
        bodies = grid_components(left, ["i", "x", "d"], code)
        top = cut(bodies.groupBy("c", "i", "x").agg(F.min("d").alias("d")))
        parts = cut(grid_components(top.select("i", "x", "d"), ["i", "x", "d"], code))
        one = parts.groupBy("c", "i", "x").agg(F.min("d").alias("d"))  # parts of two bodies may touch in a trace
        big = one.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("c")
        found = cut(one.join(big, "c", "left_semi").select(F.concat_ws("-", F.lit(k), "c").alias("s"), "i", "x", "d"))
        out = found if out is None else out.union(found)
        left = cut(left.join(one.select("i", "x", "d"), ["i", "x", "d"], "left_anti"))
    else:
        if not left.isEmpty():
            raise RuntimeError(f"bodies of over {rounds} layers: raise rounds")
    return out if out is not None else voxels.sparkSession.createDataFrame([], "s string, i long, x long, d long")


def line_lengths(parts: DataFrame, axis: str = "x") -> DataFrame:
    """(c, length, rank): parts of slides by the number of distinct places along
    ``axis``, the longest first (ties: smaller name)."""
    n = parts.groupBy("c").agg(F.count_distinct(axis).alias("length"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("length"), "c")).cast("long"))


def line_prototypes(rows: DataFrame, columns: DataFrame, least: int = 1) -> DataFrame:
    """(c, p): parts of slides along both axes (i, x, d, c) that share ``least``
    points or more hang together; p is the smallest name. Names of the two sets differ."""
    hits = rows.select("i", "x", "d", F.col("c").alias("a")).join(columns.select("i", "x", "d", F.col("c").alias("b")), ["i", "x", "d"]).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return label(hits.select("a", "b")).select(F.col("n").alias("c"), F.col("c").alias("p"))

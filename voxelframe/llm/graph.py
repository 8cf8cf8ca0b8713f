"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, discard, materialize


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b:
    long) reaches. Alternates the large-star and small-star contractions until
    every edge points at its component's smallest node; each contraction is a
    pre-aggregated minimum and a join that AQE can split at a hot node. Nodes
    without an edge don't appear; loops and repeated edges do no harm. The
    rounds end when nothing changes. The table behind the result is left to
    ``tables`` to delete."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _signature(e)
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        new = materialize(small.where("a <> b").distinct(), "cc")
        now = _signature(new)
        discard(e)
        e = new
        if now == before:
            break
        before = now
    if tables is not None:
        tables.made.append(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())

"""Corrections of lines from differences measured where they cross."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOLVED = "node long, correction double, residual_rms double, iterations long"


def distribute(a: np.ndarray, b: np.ndarray, m: np.ndarray, nodes: np.ndarray, rate: float = 0.75, most: int = 100, tolerance: float = 1e-5) -> tuple[np.ndarray, float, int]:
    """Corrections x of least RMS of m - (x_a - x_b), by damped simultaneous
    updates with the mean residual of each node."""
    at = {n: k for k, n in enumerate(nodes.tolist())}
    ia, ib = np.array([at[v] for v in a.tolist()], int), np.array([at[v] for v in b.tolist()], int)
    x = np.zeros(len(nodes))
    degree = np.maximum(np.bincount(ia, minlength=len(x)) + np.bincount(ib, minlength=len(x)), 1)
    last = np.sqrt(np.mean(m**2)) if len(m) else 0.0
    k = 0
    for k in range(1, most + 1):
        r = m - (x[ia] - x[ib])
        x = x + rate / degree * (np.bincount(ia, r, len(x)) - np.bincount(ib, r, len(x)))
        rms = float(np.sqrt(np.mean((m - (x[ia] - x[ib])) ** 2)))
        if last - rms <= tolerance * max(last, 1e-300):
            break
        last = rms
    return x, float(np.sqrt(np.mean((m - (x[ia] - x[ib])) ** 2))) if len(m) else 0.0, k


def mistie_solve(edges: DataFrame, group: str | None = None, most: int = 1_000_000) -> DataFrame:
    """Corrections of the nodes of lines (a, b, m). With ``group`` each survey is
    solved by one task; without, all edges are one survey: up to ``most`` of
    them by one task, more by updates over the cluster."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(pdf[["a", "b"]].to_numpy())
        pdf = pdf.sort_values(["a", "b"])
        x, rms, k = distribute(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["m"].to_numpy(float), nodes)
        return pd.DataFrame({"node": nodes, "correction": x, "residual_rms": rms, "iterations": k})

    if not group and edges.count() > most:
        return solve_by_updates(edges)
    return edges.withColumn("_group", F.col(group) if group else F.lit(0)).groupBy("_group").applyInPandas(run, SOLVED)


def residual_rms(edges: DataFrame, corrections: DataFrame) -> float:
    c = corrections
    j = edges.join(c.select(F.col("node").alias("a"), F.col("correction").alias("xa")), "a").join(c.select(F.col("node").alias("b"), F.col("correction").alias("xb")), "b")
    return j.agg(F.sqrt(F.avg(F.pow(F.col("m") - (F.col("xa") - F.col("xb")), 2)))).first()[0] or 0.0


def solve_by_updates(edges: DataFrame, rate: float = 0.75, most: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """The same updates as ``distribute``, each a join and a pre-aggregated mean,
    cut by a checkpoint; they stop when the residual hardly falls."""
    from ..session import cut

    edges = cut(edges.select("a", "b", "m"))
    last = edges.agg(F.sqrt(F.avg(F.col("m") * F.col("m")))).first()[0] or 0.0
    x, rms, k = None, last, 0
    for k in range(1, most + 1):
        x = cut(jacobi_step(edges, x, rate))
        rms = residual_rms(edges, x)
        if last - rms <= tolerance * max(last, 1e-300):
            break
        last = rms
    return x.select("node", "correction", F.lit(rms).alias("residual_rms"), F.lit(k).cast("long").alias("iterations"))


def jacobi_step(edges: DataFrame, corrections: DataFrame | None, rate: float = 0.75) -> DataFrame:
    """(node, correction) after one update, for graphs too large for a task."""
    both = edges.select("a", "b", "m").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("m")).alias("m")))
    if corrections is None:
        r = both.select("a", "m", F.lit(0.0).alias("xa"), F.lit(0.0).alias("xb"))
    else:
        c = corrections
        r = both.join(c.select(F.col("node").alias("a"), F.col("correction").alias("xa")), "a").join(c.select(F.col("node").alias("b"), F.col("correction").alias("xb")), "b")
    g = r.groupBy("a").agg(F.max("xa").alias("x"), F.avg(F.col("m") - (F.col("xa") - F.col("xb"))).alias("r"))
    return g.select(F.col("a").alias("node"), (F.col("x") + rate * F.col("r")).alias("correction"))


def suspicious(intersections: DataFrame, column: str) -> DataFrame:
    """Rows whose absolute value lies over the mean plus three deviations."""
    s = intersections.agg(F.avg(F.abs(column)).alias("_mean"), F.stddev_pop(F.abs(column)).alias("_std"))
    return intersections.join(F.broadcast(s)).where(F.abs(column) > F.col("_mean") + 3 * F.col("_std")).drop("_mean", "_std")

"""Confusion figures, fault similarity and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts and ratios of two 0/1 columns, for each of ``by``."""
    by = by or []
    t, p = F.col(true) == 1, F.col(pred) == 1
    c = pairs.groupBy(*by).agg(F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(~t & ~p, 1)).alias("tn"), F.count(F.when(~t & p, 1)).alias("fp"), F.count(F.when(t & ~p, 1)).alias("fn"))
    r = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    return c.select(*by, "tp", "tn", "fp", "fn", r(tp, tp + fn).alias("sensitivity"), r(tn, tn + fp).alias("specificity"), r(tp, tp + fp).alias("precision"), r(2 * tp, 2 * tp + fp + fn).alias("dice"), r(tp, tp + fp + fn).alias("iou"))


def fault_similarity(voxels: DataFrame, mask: DataFrame, shifts: tuple[int, ...] = (-20, -15, -5, 5, 15, 20)) -> DataFrame:
    """Mean over shifts along x of ln(sum of m (1 - s) / sum of shifted m (1 - s)), within -2..2."""
    e = mask.select("i", "x", "d", F.explode(F.array(F.lit(0), *(F.lit(k) for k in shifts))).alias("k")).select("i", (F.col("x") + F.col("k")).alias("x"), "d", "k")
    s = e.join(voxels, ["i", "x", "d"]).groupBy("k").agg(F.sum(1 - F.col("amp")).alias("s"))
    one = s.agg(F.max(F.when(F.col("k") == 0, F.col("s"))).alias("own"))
    part = s.where("k <> 0").join(F.broadcast(one)).select(F.least(F.greatest(F.ln(F.col("own") / F.col("s")), F.lit(-2.0)), F.lit(2.0)).alias("v"))
    return part.agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("similarity"))


def sizes(labelled: DataFrame, by: str) -> DataFrame:
    """Horizontal extent and voxel count of each label."""
    di, dx = F.max("i") - F.min("i"), F.max("x") - F.min("x")
    return labelled.groupBy(by).agg(F.count("*").alias("voxels"), F.round(F.sqrt(di * di + dx * dx), 6).alias("extent"), (F.max("d") - F.min("d")).alias("height"))

"""Well logs: rows (well, t, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate_log(left: DataFrame, right: DataFrame) -> DataFrame:
    """As-of join with linear interpolation: for each (well, t) of ``left`` the
    value of ``right`` at t, clamped at its ends; null where a well has none.
    Both are merged and ordered once; no pairs are formed."""
    both = left.select("well", "t", F.lit(None).cast("double").alias("v"), F.lit(True).alias("ask")).union(right.select("well", "t", F.col("v").cast("double"), F.lit(False)))
    back = Window.partitionBy("well").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("well").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)  # grows too, hence linear
    known = F.when(~F.col("ask"), F.struct("t", "v"))
    j = both.withColumn("a", F.max(known).over(back)).withColumn("b", F.min(known).over(ahead)).where("ask")
    inner = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return j.select("well", "t", F.round(F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")), F.col("a.v")).otherwise(inner), 6).alias("v"))


def reflectivity(logs: DataFrame) -> DataFrame:
    """(z_k - z_k-1) / (z_k + z_k-1), the first 0."""
    w = Window.partitionBy("well").orderBy("t")
    z, p = F.col("v"), F.lag("v").over(w)
    return logs.select("well", "t", F.round(F.when(p.isNull(), 0.0).when(z + p == 0, None).otherwise((z - p) / (z + p)), 6).alias("r"))


def trim_constant_ends(logs: DataFrame) -> DataFrame:
    """Values before the first and after the last change become null."""
    w = Window.partitionBy("well").orderBy("t")
    j = logs.withColumn("c", F.when(F.col("v") != F.lag("v").over(w), F.col("t")))
    span = Window.partitionBy("well")
    prev = F.lag("t").over(w)
    j = j.withColumn("p", F.when(F.col("c").isNotNull(), prev))
    lo, hi = F.min("p").over(span), F.max("c").over(span)
    return j.select("well", "t", F.when((F.col("t") >= lo) & (F.col("t") <= hi), F.col("v")).alias("v"))

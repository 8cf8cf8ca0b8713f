"""Similarity of traces (i, x, samples: array<double>), within array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def centred(traces: DataFrame) -> DataFrame:
    """Adds z (samples less their mean) and sd (population deviation)."""
    t = traces.withColumn("_m", _sum("samples") / F.size("samples"))
    t = t.withColumn("z", F.transform("samples", lambda v: v - F.col("_m"))).drop("_m")
    return t.withColumn("sd", F.sqrt(_sum(F.transform("z", lambda v: v * v)) / F.size("z")))


def correlation(a: str, b: str, sa: str, sb: str) -> Column:
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y)) / F.size(a)
    return F.when((F.col(sa) > 0) & (F.col(sb) > 0), dot / (F.col(sa) * F.col(sb)))


def find_supports(traces: DataFrame, n: int = 100, seed: int = 0, strip: int = 0) -> DataFrame:
    """The ``n`` reference traces of smallest hash of (seed, i, x) among those
    that are not constant and lie ``strip`` inside the frame: the same in every run."""
    t = centred(traces).where("sd > 0").drop("z", "sd")
    if strip:
        box = t.agg(*(f(c).alias(f"_{c}{k}") for c in "ix" for k, f in enumerate((F.min, F.max))))
        t = t.join(F.broadcast(box)).where(f"i >= _i0 + {strip} and i <= _i1 - {strip} and x >= _x0 + {strip} and x <= _x1 - {strip}").drop("_i0", "_i1", "_x0", "_x1")
    return t.orderBy(F.md5(F.concat_ws(",", F.lit(seed), "i", "x")), "i", "x").limit(n)


def support_correlation(traces: DataFrame, supports: DataFrame) -> DataFrame:
    """Mean correlation of each trace with the supports. The mean of the
    products is the product with the mean, so that the supports, however many,
    come to one normalised trace, which is broadcast; no pairs are formed.
    Constant supports don't count."""
    t = centred(traces).select("i", "x", "z", "sd")
    s = centred(supports).where("sd > 0").select("sd", F.posexplode("z").alias("k", "v"))
    mean = s.groupBy("k").agg(F.avg(F.col("v") / F.col("sd")).alias("m"))
    one = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda c: c["m"]).alias("m"))
    dot = _sum(F.zip_with("z", "m", lambda a, b: a * b)) / F.size("z")
    return t.join(F.broadcast(one)).select("i", "x", F.round(F.when(F.col("sd") > 0, dot / F.col("sd")), 6).alias("corr"))


def local_correlation(traces: DataFrame, reach: int = 1) -> DataFrame:
    """Mean correlation of each trace with its neighbours within ``reach``."""
    t = centred(traces).select("i", "x", "z", "sd")
    off = F.sequence(F.lit(-reach), F.lit(reach))
    n = t.select(F.col("i").alias("ni"), F.col("x").alias("nx"), F.col("z").alias("zn"), F.col("sd").alias("sn"), F.explode(off).alias("di")).select("*", F.explode(off).alias("dx")).where("di <> 0 or dx <> 0")
    n = n.select((F.col("ni") + F.col("di")).alias("i"), (F.col("nx") + F.col("dx")).alias("x"), "zn", "sn")
    return t.join(n, ["i", "x"]).groupBy("i", "x").agg(F.round(F.avg(correlation("z", "zn", "sd", "sn")), 6).alias("corr"))


def best_lag(pairs: DataFrame, a: str, b: str, reach: int) -> DataFrame:
    """Adds lag: the shift of b, within ``reach``, of the largest sum of products
    (ties: the smallest), b being zero outside."""
    n = F.size(a)
    at = lambda k: F.struct(F.round(_sum(F.transform(a, lambda v, i: v * F.coalesce(F.get(b, i - k), F.lit(0.0)))), 9).alias("c"), (-k).alias("l"))
    return pairs.withColumn("lag", -F.array_max(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), at))["l"]).withColumn("n", n)


def semblance(voxels: DataFrame, reach: int = 1) -> DataFrame:
    """Sum over depth of squared sums over neighbouring traces, against the
    number of traces times the sum of squares."""
    off = F.sequence(F.lit(-reach), F.lit(reach))
    e = voxels.select("i", "x", "d", "amp", F.explode(off).alias("di")).select("*", F.explode(off).alias("dx"))
    g = e.groupBy((F.col("i") + F.col("di")).alias("i"), (F.col("x") + F.col("dx")).alias("x"), "d").agg(F.sum("amp").alias("s"), F.sum(F.col("amp") * F.col("amp")).alias("q"), F.count("*").alias("n"))
    return g.groupBy("i", "x").agg(F.max("n").alias("n"), F.round(F.sum(F.col("s") * F.col("s")) / (F.max("n") * F.sum("q")), 6).alias("semblance"))


def local_statistics(voxels: DataFrame, reach: int = 1) -> DataFrame:
    """Moving normalisation over a depth window of each trace."""
    from pyspark.sql import Window

    w = Window.partitionBy("i", "x").orderBy("d").rowsBetween(-reach, reach)
    sd = F.stddev_pop("amp").over(w)
    return voxels.select("i", "x", "d", F.round(F.when(sd > 1e-12, (F.col("amp") - F.avg("amp").over(w)) / sd), 6).alias("v"))

"""Volumes as voxels (i, x, d, amp) or traces (i, x, samples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Population statistics by trace, by depth or of all (by=[])."""
    return voxels.groupBy(*by).agg(F.count("*").alias("n"), F.min("amp").alias("min"), F.max("amp").alias("max"), F.round(F.avg("amp"), 6).alias("mean"), F.round(F.stddev_pop("amp"), 6).alias("std"))


def order_statistics(rows: DataFrame, column: str, ranks: list[int], buckets: int = 4096) -> dict[int, float]:
    """The values of the given ranks (from 0) among those that aren't null.
    Each rank's interval is cut into buckets, counted by a pre-aggregated
    groupBy, and narrowed to the least and largest value of its bucket until
    these are equal: a few passes over the data, no sort and no large task."""
    v = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ends = v.agg(F.min("v"), F.max("v")).first()
    state = {r: (ends[0], ends[1], 0) for r in ranks}
    while any(lo < hi for lo, hi, _ in state.values()):
        cells = sorted({(lo, hi, n) for lo, hi, n in state.values() if lo < hi})
        known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi, _) in enumerate(cells)))
        c = v.select("v", F.explode(F.filter(known, lambda c: (F.col("v") >= c["lo"]) & (F.col("v") <= c["hi"]))).alias("c"))
        at = F.floor((F.col("v") - F.col("c.lo")) / (F.col("c.hi") - F.col("c.lo")) * buckets)
        got = c.groupBy(F.col("c.k").alias("k"), at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        counts: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r["k"], r["at"])):
            counts.setdefault(r["k"], []).append(r)
        for rank, (lo, hi, before) in state.items():
            if lo < hi:
                for r in counts[cells.index((lo, hi, before))]:
                    if rank < before + r["n"]:
                        state[rank] = (r["lo"], r["hi"], before)
                        break
                    before += r["n"]
    return {r: lo for r, (lo, _, _) in state.items()}


def exact_quantiles(rows: DataFrame, column: str, q: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles; None for no values."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(q)
    at = [v * (n - 1) for v in q]
    found = order_statistics(rows, column, sorted({k for h in at for k in (int(h), min(int(h) + 1, n - 1))}))
    return [found[int(h)] + (h - int(h)) * (found[min(int(h) + 1, n - 1)] - found[int(h)]) for h in at]


def quantiles(voxels: DataFrame, q: list[float]) -> DataFrame:
    """Exact, linearly interpolated: (q, value)."""
    rows = list(zip(q, exact_quantiles(voxels, "amp", q), strict=True))
    return voxels.sparkSession.createDataFrame(rows, "q double, value double").select("q", F.round("value", 6).alias("value"))


def signal_to_noise(traces: DataFrame) -> DataFrame:
    n = F.size("samples")
    mean = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / n
    t = traces.select("i", "x", mean.alias("m"), square.alias("q")).withColumn("var", F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
    return t.select("i", "x", F.round(F.when(F.col("var") > 0, F.ln((F.col("m") * F.col("m") + 1) / (F.col("var") + 1))), 6).alias("snr"))


def normalization_stats(voxels: DataFrame) -> DataFrame:
    """One row: mean, std, min, max and the quantiles 0.01, 0.05, 0.95 and 0.99."""
    q = dict(zip(("q_01", "q_05", "q_95", "q_99"), exact_quantiles(voxels, "amp", [0.01, 0.05, 0.95, 0.99]), strict=True))
    return voxels.agg(F.avg("amp").alias("mean"), F.stddev_pop("amp").alias("std"), F.min("amp").alias("min"), F.max("amp").alias("max"), *(F.lit(v).alias(k) for k, v in q.items()))


_NORMAL = {"mean": "amp - mean", "std": "amp / std", "meanstd": "(amp - mean) / std", "minmax": "(amp - min) / (max - min)"}
_BACK = {"mean": "amp + mean", "std": "amp * std", "meanstd": "amp * std + mean", "minmax": "amp * (max - min) + min"}


def normalize(voxels: DataFrame, mode: str = "meanstd", clip_to_quantiles: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """By statistics of the whole volume or by those given (a row of
    ``normalization_stats``): mean, std, meanstd or minmax."""
    if stats is None:
        stats = normalization_stats(voxels) if clip_to_quantiles else voxels.agg(F.avg("amp").alias("mean"), F.stddev_pop("amp").alias("std"), F.min("amp").alias("min"), F.max("amp").alias("max"))
    v = voxels.join(F.broadcast(stats))
    if clip_to_quantiles:
        v = v.withColumn("amp", F.least(F.greatest("amp", "q_01"), F.col("q_99")))
    return v.select("i", "x", "d", F.round(F.expr(_NORMAL[mode]), 6).alias("amp"))


def denormalize(voxels: DataFrame, stats: DataFrame, mode: str = "meanstd") -> DataFrame:
    return voxels.join(F.broadcast(stats)).select("i", "x", "d", F.round(F.expr(_BACK[mode]), 6).alias("amp"))


def quantization(voxels: DataFrame, share: float = 0.99, center: bool = False) -> dict[str, float]:
    """Parameters of ``quantize``: the symmetric range from the quantiles share
    and 1 - share, and the mean (0 if not ``center``)."""
    hi, lo = exact_quantiles(voxels, "amp", [share, 1 - share])
    mean = voxels.agg(F.avg("amp")).first()[0] if center else 0.0
    return {"range": min(abs(hi - mean), abs(lo - mean)), "center": mean}


def quantize(voxels: DataFrame, share: float = 0.99, center: bool = False, clip: bool = True, how: dict[str, float] | None = None) -> DataFrame:
    """(i, x, d, q): whole numbers -127..127 over a symmetric range taken from quantiles."""
    how = how or quantization(voxels, share, center)
    v = F.col("amp") - how["center"]
    v = F.least(F.greatest(v, F.lit(-how["range"])), F.lit(how["range"])) if clip else v
    return voxels.select("i", "x", "d", F.rint(v / how["range"] * 127).cast("long").alias("q"))


def dequantize(codes: DataFrame, how: dict[str, float]) -> DataFrame:
    """(i, x, d, amp) of codes of ``quantize``."""
    return codes.select("i", "x", "d", (F.col("q") / 127 * how["range"] + how["center"]).alias("amp"))


def quantization_error(voxels: DataFrame, how: dict[str, float]) -> DataFrame:
    """One row: mean absolute error of the round trip over the deviation."""
    back = dequantize(quantize(voxels, how=how), how).withColumnRenamed("amp", "back")
    return voxels.join(back, ["i", "x", "d"]).agg(F.round(F.avg(F.abs(F.col("back") - F.col("amp"))) / F.stddev_pop("amp"), 6).alias("error"))


def along_surface(voxels: DataFrame, surface: DataFrame, window: int = 1, offset: int = 0) -> DataFrame:
    """Band join: amplitudes at depths d + offset - window // 2 ... of each point
    of a surface. The depths are exploded, so that it is an equi-join."""
    at = surface.select("i", "x", F.col("d").alias("c"), F.posexplode(F.sequence(F.col("d") + offset - window // 2, F.col("d") + offset - window // 2 + window - 1)).alias("w", "d"))
    return at.join(voxels, ["i", "x", "d"], "left").select("i", "x", F.col("c").alias("d"), F.col("w").cast("long").alias("w"), F.round("amp", 6).alias("amp"))


def between_surfaces(voxels: DataFrame, top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Range join within a trace: (i, x, n, mean) of voxels from top to bottom."""
    j = top.select("i", "x", F.col("d").alias("a")).join(bottom.select("i", "x", F.col("d").alias("b")), ["i", "x"])
    j = j.select("i", "x", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return voxels.join(j, ["i", "x"]).where("d >= lo and d <= hi").groupBy("i", "x").agg(F.count("*").alias("n"), F.round(F.avg("amp"), 6).alias("mean"))


def rasterize(surface: DataFrame, box: tuple[int, int, int, int, int, int], width: int = 3) -> DataFrame:
    """Voxels of a half-open box (i0, x0, d0, i1, x1, d1) within the thickness of a surface."""
    i0, x0, d0, i1, x1, d1 = box
    s = surface.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("x") >= x0) & (F.col("x") < x1))
    v = s.select("i", "x", F.explode(F.sequence(F.col("d") - width // 2, F.col("d") - width // 2 + width - 1)).alias("d"))
    return v.where((F.col("d") >= d0) & (F.col("d") < d1)).distinct()


def regression_mask(surface: DataFrame, box: tuple[int, int, int, int, int, int], scale: bool = True) -> DataFrame:
    """Depth of each trace of the box, as a share of its height if ``scale``."""
    i0, x0, d0, i1, x1, d1 = box
    s = surface.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("d") >= d0) & (F.col("d") < d1))
    return s.select("i", "x", F.round((F.col("d") - d0) / (d1 - d0), 6).alias("d") if scale else F.col("d"))


def load_crops(voxels: DataFrame, locations: DataFrame, crop: tuple[int, int, int]) -> DataFrame:
    """(loc_id, ci, cx, cd, amp): crops that start at the locations (i0, x0, d0).
    Both sides are keyed by tiles of the crop's size: each crop touches at most
    eight, so that the join is an equi-join and no crop meets a distant voxel."""
    a, b, c = crop
    tile = lambda col, n: F.floor(F.col(col) / n)
    near = lambda col, n: F.sequence(tile(col, n), F.floor((F.col(col) + n - 1) / n))
    loc = locations.select("loc_id", "i0", "x0", "d0", F.explode(near("i0", a)).alias("ti")).select("*", F.explode(near("x0", b)).alias("tx")).select("*", F.explode(near("d0", c)).alias("td"))
    v = voxels.select("i", "x", "d", "amp", tile("i", a).alias("ti"), tile("x", b).alias("tx"), tile("d", c).alias("td"))
    j = loc.join(v, ["ti", "tx", "td"])
    inside = (F.col("i") >= F.col("i0")) & (F.col("i") < F.col("i0") + a) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + b) & (F.col("d") >= F.col("d0")) & (F.col("d") < F.col("d0") + c)
    return j.where(inside).select("loc_id", "i", "x", "d", (F.col("i") - F.col("i0")).alias("ci"), (F.col("x") - F.col("x0")).alias("cx"), (F.col("d") - F.col("d0")).alias("cd"), "amp")


def triangular_weight(place: str, length: int, alpha: float = 0.1) -> Column:
    """Weight along one axis: alpha at the border, rising linearly to the centre."""
    if length == 1:
        return F.lit(1.0)
    half = (length - 1) / 2
    return F.lit(alpha) + (1 - F.abs(F.col(place) - half) / half) * (2 - alpha) / 2


def accumulate(crops: DataFrame, how: str, value: str = "amp", crop: tuple[int, int, int] | None = None) -> DataFrame:
    """Overlapping crops to one volume: max, mean, std, gmean, mode (ties:
    least), weighted, noop (the crop of largest loc_id counts)."""
    v = F.col(value)
    if how == "noop":
        return crops.groupBy("i", "x", "d").agg(F.max_by(v, "loc_id").alias("v"))
    if how == "mode":
        c = crops.groupBy("i", "x", "d", v.alias("v")).agg(F.count("*").alias("n"))
        return c.groupBy("i", "x", "d").agg(F.max(F.struct("n", (-F.col("v")).alias("w"))).alias("b")).select("i", "x", "d", (-F.col("b.w")).alias("v"))
    if how == "weighted":
        w = triangular_weight("ci", crop[0]) * triangular_weight("cx", crop[1]) * triangular_weight("cd", crop[2])
        return crops.withColumn("w", w).groupBy("i", "x", "d").agg(F.round(F.sum(F.col("w") * v) / F.sum("w"), 6).alias("v"))
    e = {"max": F.max(v), "mean": F.avg(v), "std": F.stddev_pop(v), "gmean": F.exp(F.avg(F.ln(v)))}[how]
    return crops.groupBy("i", "x", "d").agg(F.round(e, 6).alias("v"))


def zero_crossing(voxels: DataFrame, surface: DataFrame, window: int = 15) -> DataFrame:
    """Depth of the first sign change at or below each point, within a window."""
    from pyspark.sql import Window

    near = surface.select("i", "x", F.col("d").alias("c")).join(voxels, ["i", "x"]).where((F.col("d") >= F.col("c")) & (F.col("d") <= F.col("c") + window))
    w = Window.partitionBy("i", "x", "c").orderBy("d")
    step = near.withColumn("next", F.lead("amp").over(w)).where("amp * next < 0")
    first = step.groupBy("i", "x", "c").agg(F.min(F.struct("d", "amp", "next")).alias("f"))
    return first.select("i", "x", F.col("c").alias("d"), F.round(F.col("f.d") + F.col("f.amp") / (F.col("f.amp") - F.col("f.next")), 6).alias("crossing"))

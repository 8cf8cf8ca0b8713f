"""Lines and wells: where lines cross, how their traces match, logs to seismic."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .traces import _sum


# --- arrays -----------------------------------------------------------------
def product_correlation(a, b) -> Column:
    """Mean product over the product of deviations, without centring (of line matching)."""
    n = F.size(a)
    sd = lambda c: F.sqrt(_sum(F.transform(c, lambda v: v * v)) / n - F.pow(_sum(c) / n, 2))
    d = sd(a) * sd(b)
    return F.when(d > 0, _sum(F.zip_with(a, b, lambda x, y: x * y)) / n / d)


def pearson(a, b) -> Column:
    """Centred correlation of two arrays (of well ties)."""
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    cov = _sum(F.zip_with(a, b, lambda x, y: x * y)) / n - ma * mb
    va, vb = (_sum(F.transform(c, lambda v: v * v)) / n - m * m for c, m in ((a, ma), (b, mb)))
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def r_squared(a, b) -> Column:
    """1 - residual over total sum of squares of b as a prediction of a."""
    n = F.size(a)
    mean = _sum(a) / n
    rest = _sum(F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda v: v * v))
    total = _sum(F.transform(a, lambda v: v * v)) - n * mean * mean
    return F.when(total > 0, 1 - rest / total)


def rms_gain(a, b) -> Column:
    """Root mean square of a over that of b."""
    square = lambda c: _sum(F.transform(c, lambda v: v * v)) / F.size(c)
    return F.when(square(b) > 0, F.sqrt(square(a) / square(b)))


def amplitude_ratio(a, b) -> Column:
    """Mean absolute value of a over that of b."""
    mean = lambda c: _sum(F.transform(c, F.abs)) / F.size(c)
    return F.when(mean(b) > 0, mean(a) / mean(b))


def shifted_copies(samples, shifts: list[int]) -> Column:
    """array of copies, copy k being moved down by shifts[k] samples; ends are held."""
    n = F.size(samples)
    one = lambda s: F.transform(samples, lambda v, k: F.get(samples, F.least(F.greatest(k - s, F.lit(0)), n - 1)))
    return F.array(*(one(F.lit(s)) for s in shifts))


def prepared(traces: DataFrame, key: list[str], interval: float, pad: int = 0) -> DataFrame:
    """(key, samples): mean trace of each key, resampled to 1 ms (``interval``
    ms before), ``pad`` zeros at both ends."""
    v = traces.select(*key, F.posexplode("samples").alias("d", "amp")).groupBy(*key, "d").agg(F.avg("amp").alias("amp"))
    m = v.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "amp"))), lambda c: c["amp"]).alias("m"))
    n = F.size("m")
    steps = F.sequence(F.lit(0), ((n - 1) * interval).cast("int"))

    def at(k: Column) -> Column:
        p = k / interval
        lo = F.floor(p).cast("int")
        a, b = F.get("m", lo), F.get("m", F.least(lo + 1, n - 1))
        return a + (b - a) * (p - lo)

    zeros = F.array_repeat(F.lit(0.0), pad)
    return m.select(*key, F.concat(zeros, F.transform(steps, at), zeros).alias("samples"))


def quality(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """MSE, PSNR, UQI, ERGAS (ratio 1) and SSIM (global) of two arrays."""
    e = a - b
    mse = float((e * e).mean())
    va, vb, ma, mb = a.var(), b.var(), a.mean(), b.mean()
    cov = ((a - ma) * (b - mb)).mean()
    span = max(a.max(), b.max()) - min(a.min(), b.min())
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return {"mse": mse, "psnr": float(10 * np.log10(span**2 / mse)) if mse > 0 else np.inf, "uqi": float(4 * cov * ma * mb / ((va + vb) * (ma**2 + mb**2))) if (va + vb) * (ma**2 + mb**2) else np.nan, "ergas": float(100 * np.sqrt(mse) / abs(mb)) if mb else np.nan, "ssim": float((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))) if c1 else 1.0}


def trace_quality(pairs: DataFrame, key: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(key, mse, psnr, uqi, ergas, ssim) of pairs of arrays, in column expressions."""
    n = F.size(a)
    s = pairs.select(*key, n.alias("n"), (_sum(a) / n).alias("ma"), (_sum(b) / n).alias("mb"), *(( _sum(F.zip_with(p, q, lambda x, y: x * y)) / n).alias(k) for k, p, q in (("aa", a, a), ("bb", b, b), ("ab", a, b))), (F.greatest(F.array_max(a), F.array_max(b)) - F.least(F.array_min(a), F.array_min(b))).alias("span"))
    s = s.withColumns({"va": F.expr("aa - ma * ma"), "vb": F.expr("bb - mb * mb"), "cov": F.expr("ab - ma * mb"), "mse": F.expr("aa - 2 * ab + bb")})
    mm, vv = "(ma * ma + mb * mb)", "(va + vb)"
    return s.select(*key, F.expr("mse"), F.expr("case when mse > 0 then 10 * log10(span * span / mse) end").alias("psnr"), F.expr(f"case when {vv} * {mm} > 0 then 4 * cov * ma * mb / ({vv} * {mm}) end").alias("uqi"),
                    F.expr("case when mb <> 0 then 100 * sqrt(greatest(mse, 0)) / abs(mb) end").alias("ergas"), F.expr(f"case when span > 0 then (2 * ma * mb + pow(0.01 * span, 2)) * (2 * cov + pow(0.03 * span, 2)) / (({mm} + pow(0.01 * span, 2)) * ({vv} + pow(0.03 * span, 2))) else 1.0 end").alias("ssim"))


# --- crossings ---------------------------------------------------------------
def segments(lines: DataFrame) -> DataFrame:
    """(line, k, ax, ay, bx, by): consecutive points of lines (line, k, x, y)."""
    w = Window.partitionBy("line").orderBy("k")
    return lines.select("line", "k", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")


def crossings(lines: DataFrame, cell: float, threshold: float = 10) -> DataFrame:
    """(a, b, x, y, ka, kb): where lines (line, k, x, y) cross, a < b, and the
    nearest point of each. Segments meet only in shared cells of a square grid,
    so that no pairs of distant ones are formed; hits of one pair of lines
    within ``threshold`` points of an earlier one on the first line are one."""
    s = segments(lines)
    near = lambda lo, hi: F.sequence(F.floor(F.least(lo, hi) / cell), F.floor(F.greatest(lo, hi) / cell))
    c = s.withColumn("cx", F.explode(near("ax", "bx"))).withColumn("cy", F.explode(near("ay", "by")))
    p, q = (c.select("cx", "cy", *(F.col(n).alias(f"{t}_{n}") for n in ("line", "k", "ax", "ay", "bx", "by"))) for t in "pq")
    j = p.join(q, ["cx", "cy"]).where("p_line < q_line").drop("cx", "cy").distinct()
    j = j.withColumns({"rx": F.expr("p_bx - p_ax"), "ry": F.expr("p_by - p_ay"), "sx": F.expr("q_bx - q_ax"), "sy": F.expr("q_by - q_ay")})
    j = j.withColumn("det", F.expr("rx * sy - ry * sx")).where("abs(det) > 1e-12")
    j = j.withColumns({"t": F.expr("((q_ax - p_ax) * sy - (q_ay - p_ay) * sx) / det"), "u": F.expr("((q_ax - p_ax) * ry - (q_ay - p_ay) * rx) / det")}).where("t >= 0 and t <= 1 and u >= 0 and u <= 1")
    hit = j.select(F.col("p_line").alias("a"), F.col("q_line").alias("b"), F.expr("p_ax + t * rx").alias("x"), F.expr("p_ay + t * ry").alias("y"), F.expr("p_k + cast(round(t) as long)").alias("ka"), F.expr("q_k + cast(round(u) as long)").alias("kb"))
    w = Window.partitionBy("a", "b").orderBy("ka", "kb", "x", "y")
    return hit.withColumn("_gap", F.col("ka") - F.lag("ka").over(w)).where(F.col("_gap").isNull() | (F.col("_gap") >= threshold)).drop("_gap")


def _finite(*values) -> Column:
    """Whether all are numbers but NaN and the infinities."""
    return F.coalesce(reduce(and_, (F.abs(v) < float("inf") for v in values)), F.lit(False))


def _strips(picks: DataFrame, key: str) -> DataFrame:
    """(key, strip, x0, x1, y0, y1, picks): finite places (key, x, y, depth) in
    strips along the longer axis of their key, each of at most the root of the
    key's number (64 at least). A key needn't fit a task."""
    n = picks.groupBy(key).agg(F.greatest(F.ceil(F.sqrt(F.count("*"))), F.lit(64)).alias("_size"), (F.max("x") - F.min("x") > F.max("y") - F.min("y")).alias("_wide"))
    t = picks.join(n, key).withColumns({"_a": F.when(F.col("_wide"), F.col("x")).otherwise(F.col("y")), "_b": F.when(F.col("_wide"), F.col("y")).otherwise(F.col("x"))})
    t = t.repartitionByRange(key, "_a", "_b").withColumn("_part", F.spark_partition_id())
    k = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_a", "_b")) - 1
    t = t.withColumn("strip", F.shiftleft(F.col("_part").cast("long"), 32) + F.floor(k / F.col("_size")))
    ends = (f(a).alias(f"{a}{n}") for a in "xy" for n, f in enumerate((F.min, F.max)))
    return cut(t.groupBy(key, "strip").agg(*ends, F.collect_list(F.struct("x", "y", "depth")).alias("picks")))  # used more than once, and dealt by a sample


def nearest_pick(points: DataFrame, picks: DataFrame, key: str, metric: str = "l1") -> DataFrame:
    """For each row (key, id, x, y) of ``points`` the pick (key, depth, x, y) of
    its key that is nearest (ties: least depth): (key, id, depth, distance). A
    point is compared with the strip of picks (see _strips) nearest to it, and
    then with those whose box is no farther than what was found there. Places
    that aren't finite are compared by their kinds; unknown distances are last."""
    size = (lambda dx, dy: dx + dy) if metric == "l1" else (lambda dx, dy: F.sqrt(dx * dx + dy * dy))
    far = lambda c: size(F.abs(F.col("px") - c["x"]), F.abs(F.col("py") - c["y"]))
    box = lambda c: size(*(F.greatest(c[f"{a}0"] - F.col(f"p{a}"), F.col(f"p{a}") - c[f"{a}1"], F.lit(0.0)) for a in "xy"))  # noqa: E731  # in floats too no more than to any pick of it
    rated = lambda c: F.struct(far(c).isNull().alias("unknown"), far(c).alias("far"), c["depth"].isNull().alias("none"), c["depth"].alias("depth"))
    found = F.array_min(F.transform("picks", rated))

    p = points.select(key, "id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    places = picks.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "depth").groupBy(key, "x", "y").agg(F.min("depth").alias("depth"))
    s = _strips(places.where(_finite(F.col("x"), F.col("y")) & F.col(key).isNotNull()), key)
    boxes = s.groupBy(key).agg(F.collect_list(F.struct("strip", "x0", "x1", "y0", "y1")).alias("boxes"))
    first = p.where(_finite(F.col("px"), F.col("py"))).join(boxes, key).withColumn("strip", F.array_min(F.transform("boxes", lambda c: F.struct(box(c).alias("far"), c["strip"].alias("strip"))))["strip"]).drop("boxes")
    one = first.join(s.select(key, "strip", "picks"), [key, "strip"]).withColumn("best", found).drop("picks")
    rest = F.filter("boxes", lambda c: (c["strip"] != F.col("strip")) & (box(c) <= F.col("best.far")))
    more = one.join(boxes, key).withColumn("strip", F.explode_outer(F.transform(rest, lambda c: c["strip"]))).drop("boxes")
    near = more.join(s.select(key, "strip", "picks"), [key, "strip"], "left").select(key, "id", F.least("best", found).alias("best"))

    kind = lambda v: F.when(_finite(F.col(v)), 0.0).otherwise(F.col(v))
    kinds = places.groupBy(key, kind("x").alias("x"), kind("y").alias("y")).agg(F.min("depth").alias("depth"))  # at most 25 for each key
    odd = p.join(kinds, key).where(~_finite(F.col("px"), F.col("py"), F.col("x"), F.col("y"))).select(key, "id", rated({c: F.col(c) for c in ("x", "y", "depth")}).alias("best"))
    return near.union(odd).groupBy(key, "id").agg(F.min("best").alias("m")).select(key, "id", "m.depth", F.round("m.far", 6).alias("distance"))


def adjusted(traces: DataFrame, at: DataFrame, reach: int = 1) -> DataFrame:
    """(line, k, to): each trace number moved to that of largest deviation within
    ``reach`` on its line (line, k, std; ties: the nearest, then smaller)."""
    e = at.select("line", "k", F.explode(F.sequence(F.col("k") - reach, F.col("k") + reach)).alias("to"))
    j = e.join(traces.select("line", F.col("k").alias("to"), "std"), ["line", "to"])
    return j.groupBy("line", "k").agg(F.max(F.struct("std", (-F.abs(F.col("to") - F.col("k"))).alias("near"), (-F.col("to")).alias("m"))).alias("b")).select("line", "k", (-F.col("b.m")).alias("to"))


def line_report(pairs: DataFrame, value: str = "m", corr: str = "corr") -> DataFrame:
    """Per line of pairs (a, b, value, corr): crossings, mean, deviation and least
    correlation, and how many are bad (under 0.5, or over 0.25 from the line's mean)."""
    both = pairs.select(F.col("a").alias("line"), value, corr).union(pairs.select(F.col("b"), -F.col(value), corr))
    w = Window.partitionBy("line")
    bad = (F.col(corr) < 0.5) | (F.abs(F.col(corr) - F.avg(corr).over(w)) > 0.25)
    return both.withColumn("_bad", bad.cast("int")).groupBy("line").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(corr), 6).alias("corr_mean"), F.round(F.stddev_pop(corr), 6).alias("corr_std"), F.round(F.min(corr), 6).alias("corr_min"), F.sum("_bad").alias("bad"))


def without_pairs(pairs: DataFrame, drop: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) less those of ``drop`` (a, b)."""
    return pairs.join(drop.select("a", "b"), ["a", "b"], "left_anti")


def corrected(picks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Depths of picks (line, depth, ...) less the correction (node, correction) of their line."""
    c = corrections.select(F.col("node").alias("line"), "correction")
    return picks.join(c, "line", "left").withColumn("depth", F.col("depth") - F.coalesce("correction", F.lit(0.0))).drop("correction")


# --- wells --------------------------------------------------------------------
def process_well(logs: DataFrame, dt: str = "dt", depth: str = "md") -> DataFrame:
    """Rows (well, md, dt in us/m) with velocity 1e6 / dt, density 310 v^0.25,
    their product, reflectivity and two-way time in s, summed over depth."""
    w = Window.partitionBy("well").orderBy(depth)
    v = logs.withColumn("velocity", F.lit(1e6) / F.col(dt))
    v = v.withColumn("density", 310 * F.pow("velocity", 0.25)).withColumn("ai", F.col("velocity") * F.col("density"))
    before = F.lag("ai").over(w)
    step = F.coalesce(F.col(depth) - F.lag(depth).over(w), F.lit(0.0))
    return v.withColumn("r", F.coalesce((F.col("ai") - before) / (F.col("ai") + before), F.lit(0.0))).withColumn("_s", 2 * step * F.col(dt) / 1e6).withColumn("twt", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def synthetic(logs: DataFrame, wavelet: list[float], value: str = "r", order: str = "t") -> DataFrame:
    """Adds synthetic: the log (absent values 0) convolved with a centred wavelet, of the log's length."""
    w = Window.partitionBy("well").orderBy(order)
    z = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0))
    at = lambda k: F.coalesce(F.lag(z, k).over(w) if k >= 0 else F.lead(z, -k).over(w), F.lit(0.0))
    half = len(wavelet) // 2
    total = sum((F.lit(float(v)) * at(k - half) for k, v in enumerate(wavelet)), F.lit(0.0))
    return logs.withColumn("synthetic", F.round(total, 6))


def despiked(logs: DataFrame, reach: int = 2, value: str = "v") -> DataFrame:
    """Moving median over 2 * reach + 1 rows (fewer at the ends)."""
    w = Window.partitionBy("well").orderBy("t").rowsBetween(-reach, reach)
    a = F.array_sort(F.collect_list(value).over(w))
    j = logs.withColumn("_a", a)
    n = F.size("_a")
    mid = (F.get("_a", ((n - 1) / 2).cast("int")) + F.get("_a", (n / 2).cast("int"))) / 2
    return j.withColumn(value, F.when(F.col(value).isNotNull(), mid)).drop("_a")


def filtered_log(logs: DataFrame, share: float, reach: int = 2) -> DataFrame:
    """Despiked and low-passed (see functions.signal.lowpass); one array a well."""
    from ..functions.signal import lowpass

    a = despiked(logs, reach).where("v is not null").groupBy("well").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("a"))
    p = a.select("well", F.transform("a", lambda c: c["t"]).alias("t"), lowpass(F.transform("a", lambda c: c["v"]), share).alias("v"))
    return p.select("well", F.explode(F.arrays_zip("t", "v")).alias("z")).select("well", "z.t", "z.v")


def best_shifts(pairs: DataFrame, key: list[str], reach: int, top: int = 1) -> DataFrame:
    """(key, rank, shift, corr): the best whole shifts of b against a within
    ``reach``, by centred correlation over what overlaps (8 samples or more)."""
    n = F.size("a")
    e = pairs.select(*key, "a", "b", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"))
    lo, hi = F.greatest("shift", F.lit(0)), F.least(n, F.size("b") + F.col("shift"))
    e = e.withColumns({"lo": lo, "hi": hi}).where("hi - lo >= 8")
    c = e.withColumns({"p": F.expr("slice(a, lo + 1, hi - lo)"), "q": F.expr("slice(b, lo - shift + 1, hi - lo)")}).withColumn("corr", F.round(pearson("p", "q"), 6))
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last("corr"), F.abs("shift"), "shift")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(*key, "rank", F.col("shift").cast("long").alias("shift"), "corr")


def stretched(times, position: float, alpha: float, left: float, right: float) -> Column:
    """Times moved so that ``position`` goes to position + alpha and left and
    right stay: linear on both sides, unchanged outside."""
    t = F.col(times)
    up = t + alpha * (t - left) / (position - left)
    down = t + alpha * (right - t) / (right - position)
    return F.when((t >= left) & (t <= position), up).when((t > position) & (t <= right), down).otherwise(t)


def marker_errors(markers: DataFrame, logs: DataFrame) -> DataFrame:
    """(well, name, error): for markers (well, name, depth, time) of upper-case
    names the log row (well, depth, time) nearest in depth (ties: shallower);
    its time less the marker's. Both are merged and ordered once."""
    both = markers.where(F.col("name") == F.upper("name")).select("well", "depth", "name", "time", F.lit(True).alias("ask")).union(logs.select("well", "depth", F.lit(None).cast("string"), "time", F.lit(False)))
    known = F.when(~F.col("ask"), F.struct("depth", "time"))
    up = Window.partitionBy("well").orderBy("depth").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("well").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("a", F.max(known).over(up)).withColumn("b", F.min(known).over(down)).where("ask")
    nearer = F.when(F.col("b").isNull() | (F.col("depth") - F.col("a.depth") <= F.col("b.depth") - F.col("depth")), F.col("a.time")).otherwise(F.col("b.time"))
    return j.select("well", "name", F.round(nearer - F.col("time"), 6).alias("error"))


def best_rotation(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, angle, corr): the constant phase rotation of a, within half a turn,
    that is most like b. The mean product with the rotated trace is a cosine of
    the angle, so its top is found in closed form."""
    from ..functions.signal import analytic

    def run(batches):
        for pdf in batches:
            out = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                z, b = analytic(np.asarray(a, float)), np.asarray(b, float)
                b = b - b.mean()
                p, q = (z.real - z.real.mean()) @ b, (z.imag - z.imag.mean()) @ b
                angle = float(np.arctan2(-q, p))
                r = np.cos(angle) * z.real - np.sin(angle) * z.imag
                r = r - r.mean()
                n = np.sqrt((r @ r) * (b @ b))
                out.append((angle, float(r @ b / n) if n > 0 else None))
            yield pd.concat([pdf[key].reset_index(drop=True), pd.DataFrame(out, columns=["angle", "corr"], dtype=float)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(*key, "a", "b").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "angle double, corr double"]))


def ricker_wavelet(frequency: float, step: float, half: int) -> list[float]:
    """A Ricker wavelet of 2 * half + 1 samples ``step`` seconds apart."""
    t = np.arange(-half, half + 1) * step
    a = (np.pi * frequency * t) ** 2
    return ((1 - 2 * a) * np.exp(-a)).tolist()


def autocorrelation_wavelet(trace: np.ndarray, half: int) -> np.ndarray:
    """Symmetric autocorrelation, tapered, of unit peak."""
    x = np.asarray(trace, float) - np.mean(trace)
    a = np.array([x[: len(x) - k] @ x[k:] for k in range(half + 1)])
    w = np.concatenate([a[:0:-1], a]) * np.hanning(2 * half + 3)[1:-1]
    return w / a[0] if a[0] else w


def ridge_wavelet(reflectivity: np.ndarray, trace: np.ndarray, half: int, ridge: float = 1e-3) -> np.ndarray:
    """The wavelet w of least |r * w - trace|^2 + ridge |w|^2."""
    r = np.pad(np.asarray(reflectivity, float), half)
    m = np.stack([r[2 * half - k : 2 * half - k + len(trace)] for k in range(2 * half + 1)], axis=1)
    return np.linalg.solve(m.T @ m + ridge * np.eye(m.shape[1]), m.T @ np.asarray(trace, float))


def sampled_at(logs: DataFrame, points: DataFrame, voxels: DataFrame) -> DataFrame:
    """Log rows (well, i, x, d, ...) with the amplitude of the cube there."""
    return logs.join(points, "well").join(voxels.select("i", "x", "d", "amp"), ["i", "x", "d"], "left")


def log_in_boxes(logs: DataFrame, boxes: DataFrame, cell: int = 64) -> DataFrame:
    """(loc_id, i, x, d, v): log samples inside half-open boxes (loc_id, i0, x0,
    d0, i1, x1, d1), found by cells of a grid over lines."""
    near = lambda a: F.sequence(F.floor(F.col(f"{a}0") / cell), F.floor((F.col(f"{a}1") - 1) / cell))
    b = boxes.withColumn("ci", F.explode(near("i"))).withColumn("cx", F.explode(near("x")))
    p = logs.withColumns({"ci": F.floor(F.col("i") / cell), "cx": F.floor(F.col("x") / cell)})
    return p.join(b, ["ci", "cx"]).where("i >= i0 and i < i1 and x >= x0 and x < x1 and d >= d0 and d < d1").select("loc_id", "i", "x", "d", "v")


def pseudo_logs(traces: DataFrame, interval: float) -> DataFrame:
    """(i, x, sample, time, value): a trace as logs over depth."""
    v = traces.select("i", "x", F.posexplode("samples").alias("sample", "value"))
    return v.select("i", "x", F.col("sample").cast("long").alias("sample"), (F.col("sample") * interval).alias("time"), "value")


def principal_components(rows: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """``rows`` with pc0 ... of the columns' leading principal axes; rows with a
    null there are left out. One row of covariances comes to the driver; the
    largest entry of each axis is positive."""
    r = rows.dropna(subset=columns)
    k = len(columns)
    got = r.agg(*(F.avg(c) for c in columns), *(F.covar_pop(a, b) for a in columns for b in columns)).first()
    if got[0] is None:
        return r.select("*", *(F.lit(None).cast("double").alias(f"pc{j}") for j in range(n)))
    mean, cov = np.array(got[:k], float), np.array(got[k:], float).reshape(k, k)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, np.argsort(values)[::-1][:n]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    project = lambda v: sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, v, strict=True)), F.lit(0.0))
    return r.select("*", *(project(axes[:, j]).alias(f"pc{j}") for j in range(axes.shape[1])))

"""Signals sample by sample, matching of traces and lines, wells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import matching, wells
from .registry import add
from .views import edges, logs, pts, srf, table, trc, vox


def _samples(t: DataFrame, v, digits: int = 6) -> DataFrame:
    return t.select("i", "x", F.posexplode(v).alias("d", "v")).select("i", "x", F.col("d").cast("long").alias("d"), F.round("v", digits).alias("v"))


def _beside(s: SparkSession, d: str) -> DataFrame:
    """Each trace with the next one along x."""
    t = trc(s, d)
    return t.select("i", "x", F.col("samples").alias("a")).join(t.select("i", (F.col("x") - 1).alias("x"), F.col("samples").alias("b")), ["i", "x"])


# Discrete transforms of 64 samples as sums: the odd Hilbert kernel, and filters by the cosines of their gains.
_HIL = "ke AS (SELECT m, CASE WHEN m % 2 <> 0 THEN 2 / (64 * tan(pi() * m / 64)) ELSE 0 END AS h FROM (SELECT unnest(range(-63, 64)) AS m)), hi AS (SELECT t.i, t.x, t.d, t.amp, sum(u.amp * h) AS hil FROM vox t JOIN vox u ON u.i = t.i AND u.x = t.x JOIN ke ON m = t.d - u.d GROUP BY t.i, t.x, t.d, t.amp)"
_FILTER = "f AS (SELECT k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / CAST(64 AS DOUBLE) * ({g}) AS g FROM (SELECT k, k / CAST(32 AS DOUBLE) AS w FROM (SELECT unnest(range(0, 33)) AS k))), ke AS (SELECT m, sum(g * cos(2 * pi() * k * m / 64)) AS h FROM f CROSS JOIN (SELECT unnest(range(-63, 64)) AS m) GROUP BY m), fi AS (SELECT t.i, t.x, t.d, sum(u.amp * h) AS v FROM vox t JOIN vox u ON u.i = t.i AND u.x = t.x JOIN ke ON m = t.d - u.d GROUP BY t.i, t.x, t.d)"
add("envelope", lambda s, d: _samples(trc(s, d), signal.envelope("samples")), ["vox"], f"WITH {_HIL} SELECT i, x, d, round(sqrt(amp * amp + hil * hil), 6) AS v FROM hi")
add("phase", lambda s, d: _samples(trc(s, d), signal.phase("samples", True)), ["vox"], f"WITH {_HIL}, a AS (SELECT i, x, d, atan2(hil, amp) AS a FROM hi) SELECT i, x, d, round(abs(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END - pi()), 6) AS v FROM a")
add("instantaneous_frequency", lambda s, d: _samples(trc(s, d), F.transform(signal.instantaneous_frequency("samples"), F.abs), 5), ["vox"], f"WITH {_HIL}, a AS (SELECT i, x, d, atan2(hil, amp) AS a FROM hi), g AS (SELECT i, x, d, coalesce(a - lag(a) OVER (PARTITION BY i, x ORDER BY d), 0) AS g FROM a) SELECT i, x, d, round(abs(g - 2 * pi() * floor((g + pi()) / (2 * pi()))) / (2 * pi()), 5) AS v FROM g")
add("spectrum", lambda s, d: _samples(trc(s, d), signal.amplitude_spectrum("samples")), ["vox"], "WITH w AS (SELECT unnest(range(0, 33)) AS k) SELECT i, x, CAST(k AS BIGINT) AS d, round(sqrt(pow(sum(amp * cos(2 * pi() * k * d / 64)), 2) + pow(sum(amp * sin(2 * pi() * k * d / 64)), 2)), 6) AS v FROM vox CROSS JOIN w GROUP BY i, x, k")
add("lowpass", lambda s, d: _samples(trc(s, d), signal.lowpass("samples", 0.4)), ["vox"], f"WITH {_FILTER.format(g='1 / (1 + pow(w / 0.4, 8))')} SELECT i, x, d, round(v, 6) AS v FROM fi")
add("bandpass", lambda s, d: _samples(trc(s, d), signal.bandpass("samples", 0.2, 0.6)), ["vox"], f"WITH {_FILTER.format(g='1 / (1 + pow(w / 0.6, 8)) * (1 - 1 / (1 + pow(w / 0.2, 8)))')} SELECT i, x, d, round(v, 6) AS v FROM fi")
add("modify_trace", lambda s, d: _samples(trc(s, d), signal.modify_trace("samples", 1.5, 30.0, 0.9)), ["vox"], f"""
WITH {_HIL}, n AS (SELECT i, x, avg(amp) AS m, avg(CASE WHEN d % 2 = 0 THEN amp ELSE -amp END) AS q FROM vox GROUP BY i, x), r AS (SELECT i, x, d, cos(radians(30)) * amp - sin(radians(30)) * hil AS v FROM hi),
p AS (SELECT i, x, d, greatest(d - CAST(1.5 AS DOUBLE), 0) AS p FROM r) SELECT p.i, p.x, p.d, round(CAST(0.9 AS DOUBLE) * (a.v + (b.v - a.v) * (p - floor(p))), 6) AS v FROM p JOIN r a ON a.i = p.i AND a.x = p.x AND a.d = floor(p) JOIN r b ON b.i = p.i AND b.x = p.x AND b.d = floor(p) + 1""")
add("wavelet_transform", lambda s, d: _samples(trc(s, d), signal.wavelet("samples", 4.0)), ["vox"], """
WITH ke AS (SELECT m, 2 / (sqrt(3 * 4.0) * pow(pi(), 0.25)) * (1 - m * m / 16.0) * exp(-(m * m / 16.0) / 2) AS h FROM (SELECT CAST(unnest(range(-20, 21)) AS DOUBLE) AS m))
SELECT t.i, t.x, t.d, round(sum(u.amp * h), 6) AS v FROM vox t JOIN vox u ON u.i = t.i AND u.x = t.x JOIN ke ON m = t.d - u.d GROUP BY t.i, t.x, t.d""")
add("gaussian_filter", lambda s, d: _samples(trc(s, d), signal.gaussian("samples", 2.0)), ["vox"], "WITH ke AS (SELECT m, exp(-(m * m) / CAST(8 AS DOUBLE)) AS h FROM (SELECT unnest(range(-8, 9)) AS m)) SELECT t.i, t.x, t.d, round(sum(u.amp * h) / sum(h), 6) AS v FROM vox t JOIN vox u ON u.i = t.i AND u.x = t.x JOIN ke ON m = t.d - u.d GROUP BY t.i, t.x, t.d")
add("spectral_decomposition", lambda s, d: _samples(trc(s, d), F.array(*(F.get(signal.wavelet("samples", float(w)), F.lit(32)) for w in (1, 4, 7, 10, 13)))), ["vox"], """
WITH w AS (SELECT unnest([1, 4, 7, 10, 13]) AS w), ke AS (SELECT w, m, 2 / (sqrt(CAST(3 * w AS DOUBLE)) * pow(pi(), 0.25)) * (1 - m * m / CAST(w * w AS DOUBLE)) * exp(-(m * m / CAST(w * w AS DOUBLE)) / 2) AS h FROM w CROSS JOIN (SELECT unnest(range(-63, 64)) AS m) WHERE abs(m) <= least(CASE WHEN w * 10 % 2 = 0 THEN w * 10 + 1 ELSE w * 10 END, 127) // 2)
SELECT u.i, u.x, CAST((w - 1) // 3 AS BIGINT) AS d, round(sum(u.amp * h), 6) AS v FROM vox u JOIN ke ON m = 32 - u.d GROUP BY u.i, u.x, w""")
add("skeletonize", lambda s, d: _samples(trc(s, d), signal.skeletonize("samples", 0.05, 0.05, 5)))
add("local_similarity", lambda s, d: _samples(_beside(s, d), signal.similarity("a", "b"), 4))
add("local_peaks", lambda s, d: _samples(trc(s, d), F.transform("samples", lambda v, k: F.when((v >= 0.05) & (v >= F.coalesce(F.get("samples", k - 1), v)) & (v >= F.coalesce(F.get("samples", k + 1), v)), 1.0).otherwise(0.0))), ["vox"], "SELECT i, x, d, CASE WHEN amp >= CAST(0.05 AS DOUBLE) AND amp >= coalesce(lag(amp) OVER w, amp) AND amp >= coalesce(lead(amp) OVER w, amp) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v FROM vox WINDOW w AS (PARTITION BY i, x ORDER BY d)")
add("depth_softmax", lambda s, d: _softmax(vox(s, d)), ["vox"], "WITH e AS (SELECT i, x, d, exp(amp) / sum(exp(amp)) OVER (PARTITION BY i, x) AS p FROM vox) SELECT i, x, d, round(sum(p) OVER (PARTITION BY i, x ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM e")
add("equalize", lambda s, d: _equalized(vox(s, d)), ["vox"], "SELECT i, x, d, round(percent_rank() OVER (PARTITION BY i, x ORDER BY amp), 6) AS v FROM vox")


def _softmax(v: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    e = v.withColumn("p", F.exp("amp") / F.sum(F.exp("amp")).over(Window.partitionBy("i", "x")))
    return e.select("i", "x", "d", F.round(F.sum("p").over(Window.partitionBy("i", "x").orderBy("d").rowsBetween(-1, 1)), 6).alias("v"))


def _equalized(v: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return v.select("i", "x", "d", F.round(F.percent_rank().over(Window.partitionBy("i", "x").orderBy("amp")), 6).alias("v"))


# --- pairs of traces ---------------------------------------------------------------
_PAIR = "p AS (SELECT a.i, a.x, a.d, a.amp AS a, b.amp AS b FROM vox a JOIN vox b ON b.i = a.i AND b.x = a.x + 1 AND b.d = a.d)"
add("pair_metrics", lambda s, d: _beside(s, d).select("i", "x", *(F.round(f("a", "b"), 6).alias(n) for n, f in (("product", matching.product_correlation), ("pearson", matching.pearson), ("r2", matching.r_squared), ("gain", matching.rms_gain), ("ratio", matching.amplitude_ratio)))), ["vox"], f"""
WITH {_PAIR} SELECT i, x, round(avg(a * b) / (stddev_pop(a) * stddev_pop(b)), 6) AS product, round(corr(a, b), 6) AS pearson, round(1 - sum((a - b) * (a - b)) / (count(*) * var_pop(a)), 6) AS r2, round(sqrt(avg(a * a) / avg(b * b)), 6) AS gain, round(avg(abs(a)) / avg(abs(b)), 6) AS ratio FROM p GROUP BY i, x""")
add("similarity_metrics", lambda s, d: _rounded(matching.trace_quality(_beside(s, d), ["i", "x"]), "mse", "psnr", "uqi", "ssim"), ["vox"], f"""
WITH {_PAIR}, q AS (SELECT i, x, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c, avg((a - b) * (a - b)) AS mse, greatest(max(a), max(b)) - least(min(a), min(b)) AS span FROM p GROUP BY i, x)
SELECT i, x, round(mse, 6) AS mse, round(10 * log10(span * span / mse), 6) AS psnr, round(4 * c * ma * mb / ((va + vb) * (ma * ma + mb * mb)), 6) AS uqi, round((2 * ma * mb + pow(0.01 * span, 2)) * (2 * c + pow(0.03 * span, 2)) / ((ma * ma + mb * mb + pow(0.01 * span, 2)) * (va + vb + pow(0.03 * span, 2))), 6) AS ssim FROM q""")
add("local_correlation_map", lambda s, d: _local_map(s, d), ["vox"], f"WITH {_PAIR} SELECT i, x, d, round(pow(corr(a, abs(a - b)) OVER (PARTITION BY i, x ORDER BY d ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 2), 5) AS v FROM p")
add("shifted_copies", lambda s, d: trc(s, d).select("i", "x", F.posexplode(matching.shifted_copies("samples", [-2, 0, 3])).alias("k", "c")).select("i", "x", F.col("k").cast("long").alias("k"), F.round(F.aggregate(F.transform("c", lambda v, j: v * (j + 1)), F.lit(0.0), lambda a, v: a + v), 5).alias("total")), ["trc"], """
WITH k AS (SELECT unnest([0, 1, 2]) AS k, unnest([-2, 0, 3]) AS m), v AS (SELECT i, x, k, unnest(range(0, len(samples))) AS j, samples, m FROM trc CROSS JOIN k) SELECT i, x, CAST(k AS BIGINT) AS k, round(sum(samples[CAST(least(greatest(j - m, 0), len(samples) - 1) AS BIGINT) + 1] * (j + 1)), 5) AS total FROM v GROUP BY i, x, k""")
add("prepared_traces", lambda s, d: _samples(matching.prepared(trc(s, d).withColumn("x", F.lit(0)), ["i", "x"], 2.0, 3), "samples").drop("x"), ["vox"], """
WITH m AS (SELECT i, d, avg(amp) AS amp FROM vox GROUP BY i, d), n AS (SELECT i, max(d) AS n FROM m GROUP BY i), k AS (SELECT i, n, unnest(range(-3, 2 * n + 4)) AS k FROM n)
SELECT k.i, CAST(k + 3 AS BIGINT) AS d, round(CASE WHEN k < 0 OR k > 2 * n THEN 0 WHEN k % 2 = 0 THEN a.amp ELSE (a.amp + b.amp) / 2 END, 6) AS v FROM k LEFT JOIN m a ON a.i = k.i AND a.d = k // 2 LEFT JOIN m b ON b.i = k.i AND b.d = k // 2 + 1""")
add("best_shifts", lambda s, d: matching.best_shifts(_beside(s, d), ["i", "x"], 5, 2).select("i", "x", F.col("rank").cast("long").alias("rank"), "shift", "corr"), ["vox"], """
WITH k AS (SELECT unnest(range(-5, 6)) AS k), c AS (SELECT a.i, a.x, k, round(corr(a.amp, b.amp), 6) AS c FROM vox a JOIN k ON true JOIN vox b ON b.i = a.i AND b.x = a.x + 1 AND b.d = a.d - k GROUP BY a.i, a.x, k)
SELECT i, x, row_number() OVER w AS rank, CAST(k AS BIGINT) AS shift, c AS corr FROM c WINDOW w AS (PARTITION BY i, x ORDER BY c DESC NULLS LAST, abs(k), k) QUALIFY rank <= 2""")
add("best_rotation", lambda s, d: _rounded(matching.best_rotation(_beside(s, d), ["i", "x"]), "angle", "corr"), ["vox"], f"""
WITH {_HIL}, p AS (SELECT h.i, h.x, h.amp AS a, h.hil AS h, b.amp AS b FROM hi h JOIN vox b ON b.i = h.i AND b.x = h.x + 1 AND b.d = h.d), t AS (SELECT i, x, atan2(-covar_pop(h, b), covar_pop(a, b)) AS t FROM p GROUP BY i, x)
SELECT p.i, p.x, round(t, 6) AS angle, round(corr(cos(t) * a - sin(t) * h, b), 6) AS corr FROM p JOIN t ON t.i = p.i AND t.x = p.x GROUP BY p.i, p.x, t""")


def _rounded(t: DataFrame, *columns: str) -> DataFrame:
    keys = [c for c in ("i", "x") if c in t.columns]
    return t.select(*keys, *(F.round(c, 6).alias(c) for c in columns))


def _local_map(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = _beside(s, d).select("i", "x", F.posexplode(F.arrays_zip("a", "b")).alias("d", "z")).select("i", "x", F.col("d").cast("long").alias("d"), F.col("z.a").alias("a"), F.abs(F.col("z.a") - F.col("z.b")).alias("r"))
    w = Window.partitionBy("i", "x").orderBy("d").rowsBetween(-4, 4)
    return p.select("i", "x", "d", F.round(F.pow(F.corr("a", "r").over(w), 2), 5).alias("v"))


# --- lines ---------------------------------------------------------------------------
def _lines(s: SparkSession, d: str) -> DataFrame:
    """Customers as points of lines, by nation: place by balance and key."""
    c = table(s, d, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("line"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 10.0).alias("y"))


_LINES = "l AS (SELECT CAST(c_nationkey AS BIGINT) AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, c_acctbal AS x, c_custkey * CAST(10 AS DOUBLE) AS y FROM customer), s AS (SELECT line, k, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM l WINDOW w AS (PARTITION BY line ORDER BY k))"


def _numbered(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return _lines(s, d).withColumn("k", (F.row_number().over(Window.partitionBy("line").orderBy("k")) - 1).cast("long"))


add("line_crossings", lambda s, d: matching.crossings(_numbered(s, d), 2000.0, 3).select("a", "b", "ka", "kb", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")), None, f"""
WITH {_LINES}, j AS (SELECT p.line AS a, q.line AS b, p.k AS pk, q.k AS qk, p.ax, p.ay, p.bx - p.ax AS rx, p.by - p.ay AS ry, q.bx - q.ax AS sx, q.by - q.ay AS sy, q.ax - p.ax AS ox, q.ay - p.ay AS oy FROM s p JOIN s q ON p.line < q.line AND p.bx IS NOT NULL AND q.bx IS NOT NULL AND p.ay <= q.by AND q.ay <= p.by),
h AS (SELECT *, (ox * sy - oy * sx) / (rx * sy - ry * sx) AS t, (ox * ry - oy * rx) / (rx * sy - ry * sx) AS u FROM j WHERE abs(rx * sy - ry * sx) > 1e-12),
c AS (SELECT a, b, ax + t * rx AS x, ay + t * ry AS y, pk + CAST(round(t) AS BIGINT) AS ka, qk + CAST(round(u) AS BIGINT) AS kb FROM h WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
g AS (SELECT *, ka - lag(ka) OVER (PARTITION BY a, b ORDER BY ka, kb, x, y) AS gap FROM c) SELECT a, b, ka, kb, round(x, 3) AS x, round(y, 3) AS y FROM g WHERE gap IS NULL OR gap >= 3""")
add("nearest_pick", lambda s, d: matching.nearest_pick(_lines(s, d).withColumnRenamed("k", "id"), table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("line"), F.col("s_suppkey").alias("depth"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 10.0).alias("y")), "line"), None, """
SELECT CAST(c_nationkey AS BIGINT) AS line, c_custkey AS id, s_suppkey AS depth, round(abs(c_acctbal - s_acctbal) + abs(c_custkey * CAST(10 AS DOUBLE) - s_suppkey * CAST(10 AS DOUBLE)), 6) AS distance FROM customer JOIN supplier ON s_nationkey = c_nationkey
QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey ORDER BY abs(c_acctbal - s_acctbal) + abs(c_custkey * CAST(10 AS DOUBLE) - s_suppkey * CAST(10 AS DOUBLE)), s_suppkey) = 1""")
add("adjust_index", lambda s, d: _adjusted(s, d), ["vox"], """
WITH t AS (SELECT i AS line, x AS k, round(stddev_pop(amp), 9) AS std FROM vox GROUP BY i, x) SELECT a.line, a.k, b.k AS "to" FROM t a JOIN t b ON b.line = a.line AND b.k BETWEEN a.k - 1 AND a.k + 1 QUALIFY row_number() OVER (PARTITION BY a.line, a.k ORDER BY b.std DESC, abs(b.k - a.k), b.k) = 1""")


def _adjusted(s: SparkSession, d: str) -> DataFrame:
    t = vox(s, d).groupBy(F.col("i").alias("line"), F.col("x").alias("k")).agg(F.round(F.stddev_pop("amp"), 9).alias("std"))
    return matching.adjusted(t, t.select("line", "k"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).withColumn("corr", 1 - F.abs("m") * 10)


_PAIRS = "pr AS (SELECT a, b, m, 1 - abs(m) * 10 AS corr FROM edges)"
add("line_report", lambda s, d: matching.line_report(_pairs(s, d)), ["edges"], f"""
WITH {_PAIRS}, q AS (SELECT a AS line, m, corr FROM pr UNION ALL SELECT b, -m, corr FROM pr), w AS (SELECT *, corr < 0.5 OR abs(corr - avg(corr) OVER (PARTITION BY line)) > 0.25 AS bad FROM q)
SELECT line, count(*) AS n, round(avg(m), 6) AS mean, round(avg(corr), 6) AS corr_mean, round(stddev_pop(corr), 6) AS corr_std, round(min(corr), 6) AS corr_min, count(*) FILTER (bad) AS bad FROM w GROUP BY line""")
add("remove_crossings", lambda s, d: matching.without_pairs(_pairs(s, d), _pairs(s, d).where("corr < 0.5")), ["edges"], f"WITH {_PAIRS} SELECT a, b, m, corr FROM pr WHERE NOT corr < 0.5")
add("corrected_picks", lambda s, d: _corrected(s, d), ["edges"], "WITH q AS (SELECT a, m FROM edges UNION ALL SELECT b, -m FROM edges), c AS (SELECT a AS line, round(0.75 * avg(m), 6) AS c FROM q GROUP BY a) SELECT CAST(c_nationkey AS BIGINT) AS line, c_custkey AS id, round(c_acctbal - coalesce(c, 0), 6) AS depth FROM customer LEFT JOIN c ON c.line = c_nationkey")


def _corrected(s: SparkSession, d: str) -> DataFrame:
    from ..operators.mistie import jacobi_step

    fix = jacobi_step(edges(s, d), None).withColumn("correction", F.round("correction", 6))
    picks = _lines(s, d).select("line", F.col("k").alias("id"), F.col("x").alias("depth"))
    return matching.corrected(picks, fix).select("line", "id", F.round("depth", 6).alias("depth"))


# --- wells ---------------------------------------------------------------------------
def _dt(s: SparkSession, d: str) -> DataFrame:
    return logs(s, d).select("well", (F.col("t") / 1e9).alias("md"), (F.col("v") + 100).alias("dt"))


_WELL = """l AS (SELECT well, t / CAST(1e9 AS DOUBLE) AS md, v + 100 AS dt FROM logs), p AS (SELECT *, 1e6 / dt * 310 * pow(1e6 / dt, 0.25) AS ai, lag(md) OVER w AS pm FROM l WINDOW w AS (PARTITION BY well ORDER BY md))"""
add("process_well", lambda s, d: matching.process_well(_dt(s, d)).select("well", F.round("md", 4).alias("md"), F.round("density", 4).alias("density"), F.round("r", 6).alias("r"), F.round("twt", 5).alias("twt")), ["logs"], f"""
WITH {_WELL} SELECT well, round(md, 4) AS md, round(310 * pow(1e6 / dt, 0.25), 4) AS density, round(coalesce((ai - lag(ai) OVER w) / (ai + lag(ai) OVER w), 0), 6) AS r, round(sum(2 * coalesce(md - pm, 0) * dt / 1e6) OVER (PARTITION BY well ORDER BY md ROWS UNBOUNDED PRECEDING), 5) AS twt FROM p WINDOW w AS (PARTITION BY well ORDER BY md)""")
_RW = matching.ricker_wavelet(25.0, 0.004, 3)
_SYN = " + ".join(f"{v!r} * coalesce({'lag' if k >= 3 else 'lead'}(r, {abs(k - 3)}) OVER w, 0)" for k, v in enumerate(_RW))
add("synthetic", lambda s, d: matching.synthetic(wells.reflectivity(logs(s, d)), _RW).select("well", "t", "synthetic"), ["logs"], f"""
WITH q AS (SELECT well, t, coalesce(round(CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v + lag(v) OVER w = 0 THEN NULL ELSE (v - lag(v) OVER w) / (v + lag(v) OVER w) END, 6), 0) AS r FROM logs WINDOW w AS (PARTITION BY well ORDER BY t)) SELECT well, t, round({_SYN}, 6) AS synthetic FROM q WINDOW w AS (PARTITION BY well ORDER BY t)""")
add("despiked_log", lambda s, d: matching.despiked(logs(s, d)).select("well", "t", F.round("v", 6).alias("v")), ["logs"], "SELECT well, t, round(median(v) OVER (PARTITION BY well ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM logs")
add("filtered_log", lambda s, d: matching.filtered_log(logs(s, d), 0.3).select("well", "t", F.round("v", 6).alias("v")))
add("stretch_times", lambda s, d: logs(s, d).select("well", "t", F.round(matching.stretched("v", 40.0, 5.0, 10.0, 90.0), 6).alias("v")), ["logs"], "SELECT well, t, round(CASE WHEN v >= 10 AND v <= 40 THEN v + CAST(5 AS DOUBLE) * (v - 10) / 30 WHEN v > 40 AND v <= 90 THEN v + CAST(5 AS DOUBLE) * (90 - v) / 50 ELSE v END, 6) AS v FROM logs")


def _markers(s: SparkSession, d: str) -> DataFrame:
    v = logs(s, d)
    marks = v.where("kind = 'click'").select("well", F.col("t").alias("depth"), F.when(F.col("v") > 50, "TOP").otherwise("base").alias("name"), F.col("v").alias("time"))
    return matching.marker_errors(marks, v.where("kind = 'view'").select("well", F.col("t").alias("depth"), F.col("v").alias("time")))


add("marker_errors", _markers, ["logs"], """
WITH l AS (SELECT well, t, v FROM logs WHERE kind = 'click' AND v > 50), r AS (SELECT well, t, v FROM logs WHERE kind = 'view'), j AS (SELECT l.well, l.t, l.v, a.t AS ta, a.v AS va, b.t AS tb, b.v AS vb FROM l ASOF LEFT JOIN r a ON a.well = l.well AND a.t <= l.t ASOF LEFT JOIN r b ON b.well = l.well AND b.t >= l.t)
SELECT well, 'TOP' AS name, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR t - ta <= tb - t THEN va ELSE vb END - v, 6) AS error FROM j""")
add("well_at_traces", lambda s, d: _at_traces(s, d), ["logs", "vox"], """
WITH w AS (SELECT DISTINCT well, well % 20 AS i, well % 25 AS x FROM logs), l AS (SELECT logs.well, i, x, (t // 1000000) % 64 AS d, v FROM logs JOIN w USING (well)) SELECT well, l.i, l.x, l.d, v, round(amp, 6) AS amp FROM l LEFT JOIN vox ON vox.i = l.i AND vox.x = l.x AND vox.d = l.d""")
add("log_in_boxes", lambda s, d: _in_boxes(s, d), ["logs"], """
WITH l AS (SELECT well % 20 AS i, well % 25 AS x, (t // 1000000) % 64 AS d, v FROM logs), b AS (SELECT k AS loc_id, k * 3 AS i0, k * 4 AS x0, k * 2 AS d0 FROM (SELECT unnest(range(0, 6)) AS k))
SELECT loc_id, i, x, d, v FROM l JOIN b ON i >= i0 AND i < i0 + 7 AND x >= x0 AND x < x0 + 9 AND d >= d0 AND d < d0 + 20""")


def _placed(s: SparkSession, d: str) -> DataFrame:
    return logs(s, d).select("well", (F.col("well") % 20).alias("i"), (F.col("well") % 25).alias("x"), (F.expr("t div 1000000") % 64).alias("d"), "v")


def _at_traces(s: SparkSession, d: str) -> DataFrame:
    p = _placed(s, d)
    return matching.sampled_at(p.select("well", "d", "v"), p.select("well", "i", "x").distinct(), vox(s, d)).select("well", "i", "x", "d", "v", F.round("amp", 6).alias("amp"))


def _in_boxes(s: SparkSession, d: str) -> DataFrame:
    k = s.range(6).select(F.col("id").alias("loc_id"), (F.col("id") * 3).alias("i0"), (F.col("id") * 4).alias("x0"), (F.col("id") * 2).alias("d0"))
    return matching.log_in_boxes(_placed(s, d), k.withColumns({"i1": F.col("i0") + 7, "x1": F.col("x0") + 9, "d1": F.col("d0") + 20}), 8)

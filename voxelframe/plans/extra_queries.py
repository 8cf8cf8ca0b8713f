"""Further operators: synthetic cubes, pseudo-logs, principal components, crops to surfaces, text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import batch, matching, metrics, synthetic, volume
from ..session import new_folder
from ..sources import text
from . import batch_queries as crops
from .registry import add
from .views import srf, table, trc, vox

_WAVE = "CAST(trunc(5 * cos(i * CAST(0.02 AS DOUBLE)) + 5 * sin(x * CAST(0.05 AS DOUBLE))) AS BIGINT)"
_GRID = "g AS (SELECT i, x FROM (SELECT unnest(range(0, 60)) AS i) CROSS JOIN (SELECT unnest(range(0, 50)) AS x))"
add("synthetic_cube", lambda s, d: synthetic.wavy_cube(s, (60, 50, 40)).select("i", "x", F.posexplode("samples").alias("d", "amp")).select("i", "x", F.col("d").cast("long").alias("d"), F.round("amp", 6).alias("amp")), None, f"WITH {_GRID}, v AS (SELECT i, x, d, (d - {_WAVE} + 400) % 40 AS m FROM g CROSS JOIN (SELECT unnest(range(0, 40)) AS d)) SELECT i, x, d, round(sin(m * CAST(0.1 AS DOUBLE)), 6) AS amp FROM v")
add("synthetic_surface", lambda s, d: synthetic.wavy_surface(s, (60, 50, 40)), None, f"WITH {_GRID} SELECT i, x, {_WAVE} + 20 AS d FROM g")
add("pseudo_logs", lambda s, d: matching.pseudo_logs(trc(s, d), 2.0).withColumn("value", F.round("value", 6)), ["vox"], "SELECT i, x, d AS sample, CAST(d * 2 AS DOUBLE) AS time, round(amp, 6) AS value FROM vox")


def _window(s: SparkSession, d: str) -> DataFrame:
    peaks = vox(s, d).where("d between 8 and 40").groupBy("i", "x").agg(F.max_by("d", "amp").alias("d"))
    return volume.along_surface(vox(s, d), peaks, 8, 0)


def _decomposed(s: SparkSession, d: str) -> DataFrame:
    a = _window(s, d).groupBy("i", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "amp"))), lambda c: c["amp"]).alias("a"))
    return a.select("i", "x", F.posexplode(signal.amplitude_spectrum("a")).alias("k", "v")).select("i", "x", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"))


_SURF = "u AS (SELECT i, x, arg_max(d, amp) AS d FROM vox WHERE d BETWEEN 8 AND 40 GROUP BY i, x), win AS (SELECT u.i, u.x, w, round(v.amp, 6) AS amp FROM u CROSS JOIN (SELECT unnest(range(0, 8)) AS w) JOIN vox v ON v.i = u.i AND v.x = u.x AND v.d = u.d - 4 + w)"
add("fourier_decomposition", _decomposed, ["vox"], f"WITH {_SURF} SELECT i, x, CAST(k AS BIGINT) AS k, round(sqrt(pow(sum(amp * cos(2 * pi() * k * w / 8)), 2) + pow(sum(amp * sin(2 * pi() * k * w / 8)), 2)), 6) AS v FROM win CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY i, x, k")


def _components(s: SparkSession, d: str) -> DataFrame:
    w = _window(s, d).groupBy("i", "x").pivot("w", list(range(8))).agg(F.first("amp"))
    w = w.toDF("i", "x", *(f"a{k}" for k in range(8)))
    p = matching.principal_components(w, [f"a{k}" for k in range(8)], 8)
    return p.agg(*(F.round(F.var_pop(f"pc{k}"), 6).alias(f"v{k}") for k in (0, 1)), F.round(sum((F.var_pop(f"pc{k}") for k in range(8)), F.lit(0.0)), 5).alias("total"))


add("principal_components", _components)
add("crop_surfaces", lambda s, d: batch.crop_components(crops._crops(s, d).where("amp > 0.3")).groupBy("loc_id", "c").agg(F.count("*").alias("n"), F.min("d").alias("d_min"), F.max("d").alias("d_max")).drop("c"), ["vox"], f"""
WITH {crops._C}, v AS (SELECT loc_id, ci, cx, cd, ((loc_id * 64 + ci) * 64 + cx) * 64 + cd AS n FROM cr WHERE amp > 0.3), e AS (SELECT p.n AS a, q.n AS b FROM v p JOIN v q ON q.loc_id = p.loc_id AND q.ci BETWEEN p.ci - 1 AND p.ci + 1 AND q.cx BETWEEN p.cx - 1 AND p.cx + 1 AND q.cd BETWEEN p.cd - 1 AND p.cd + 1 AND p.n <> q.n),
r(n, c) AS (SELECT n, n FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), lab AS (SELECT n, min(c) AS c FROM r GROUP BY n), t AS (SELECT loc_id, c, ci, cx, CAST(round_even(avg(cd), 0) AS BIGINT) AS d FROM v JOIN lab USING (n) GROUP BY 1, 2, 3, 4)
SELECT loc_id, count(*) AS n, min(d) AS d_min, max(d) AS d_max FROM t GROUP BY loc_id, c""", True)
add("crop_resize", lambda s, d: crops._summed(batch.resized(crops._crops(s, d), crops.CROP, (5, 5, 32))), ["vox"], f"""
WITH {crops._C}, k AS (SELECT t, least(greatest((t + 0.5) * 16 / 32 - 0.5, 0), 15) AS p FROM (SELECT unnest(range(0, 32)) AS t)), z AS (SELECT a.loc_id, a.ci, a.cx, t, a.amp + (coalesce(b.amp, a.amp) - a.amp) * CAST(p - floor(p) AS DOUBLE) AS amp FROM k JOIN cr a ON a.cd = floor(p) LEFT JOIN cr b ON b.loc_id = a.loc_id AND b.ci = a.ci AND b.cx = a.cx AND b.cd = floor(p) + 1)
SELECT loc_id, count(*) AS n, round(sum(amp * (ci * 100 + cx * 10 + t + 1)), 4) AS total FROM z GROUP BY loc_id""")


def _facies(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").alias("t"), F.col("toxic").alias("p"))
    return metrics.confusion(j, "t", "p", ["lang"]).select("lang", "tp", "tn", "fp", "fn", "dice")


add("facies_by_field", _facies, None, """
SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn,
round(2 * count(*) FILTER (quality = 1 AND toxic = 1) / nullif(2 * count(*) FILTER (quality = 1 AND toxic = 1) + count(*) FILTER (quality <> 1 AND toxic = 1) + count(*) FILTER (quality = 1 AND toxic <> 1), 0), 6) AS dice FROM labels JOIN documents USING (doc_id) GROUP BY lang""")


def _picks(s: SparkSession, d: str) -> DataFrame:
    """A surface written as picks by line values, read back to ordinals inside a cube."""
    path = new_folder(s, "picks")
    text.write_picks(srf(s, d).where("s = 'A'").select("i", "x", "d"), path, (100, 2), (300, 3))
    return text.load_picks(s, path, (100, 2), (300, 3), (80, 45, 45))


add("picks_round_trip", _picks, ["srf"], "SELECT i, x, d FROM srf WHERE s = 'A' AND i < 80 AND x < 45 AND d >= 0 AND d < 45")
add("recovered_lines", lambda s, d: _recovered(s, d), ["srf"], "SELECT i AS inline, x AS crossline, d AS depth FROM srf WHERE s = 'N'")


def _recovered(s: SparkSession, d: str) -> DataFrame:
    """Picks whose line values are lost beyond inline 50, found again by their coordinates."""
    p = srf(s, d).where("s = 'N'").select(F.when(F.col("i") > 5, F.col("i") + 100_000).otherwise(F.col("i")).alias("inline"), F.col("x").alias("crossline"), (F.col("i") * 25.0 + 7).alias("cdp_x"), (F.col("x") * 25.0 - 3).alias("cdp_y"), F.col("d").alias("depth"))
    fit = s.createDataFrame([(25.0, 0.0, 7.0, 0.0, 25.0, -3.0)], "a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    return text.recover_lines(p, fit, (1000, 1000)).select("inline", "crossline", "depth")

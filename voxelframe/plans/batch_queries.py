"""Crops: augmentations, conditions, masks, samplers and location generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, grids, volume
from .registry import add
from .views import pts, srf, table, trc, vox

CROP, STRIDE = (5, 5, 16), (5, 5, 16)


def _grid(s: SparkSession, d: str) -> DataFrame:
    return grids.regular_grid(grids.extent(trc(s, d)), CROP, STRIDE)


def _crops(s: SparkSession, d: str) -> DataFrame:
    return volume.load_crops(vox(s, d), _grid(s, d), CROP).select("loc_id", "ci", "cx", "cd", "amp")


_AX = [f"(SELECT DISTINCT least(v, greatest(hi - {c}, lo)) AS {a}0 FROM (SELECT lo, hi, unnest(range(lo, hi, {c})) AS v FROM (SELECT {lo} AS lo, {hi} AS hi FROM trc)))" for a, c, lo, hi in zip("ixd", CROP, ("min(i)", "min(x)", "0"), ("max(i) + 1", "max(x) + 1", "max(len(samples))"), strict=True)]
_G = f"g AS (SELECT i0, x0, d0, row_number() OVER (ORDER BY i0, x0, d0) - 1 AS loc_id FROM {_AX[0]} CROSS JOIN {_AX[1]} CROSS JOIN {_AX[2]})"
_C = f"{_G}, cr AS (SELECT loc_id, v.i - i0 AS ci, v.x - x0 AS cx, v.d - d0 AS cd, amp FROM g JOIN vox v ON v.i >= i0 AND v.i < i0 + 5 AND v.x >= x0 AND v.x < x0 + 5 AND v.d >= d0 AND v.d < d0 + 16)"


def _u(seed: int, *keys: str) -> str:
    text = " || ',' || ".join([f"'{seed}'", *keys])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296)"


def _n(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(seed, *keys)})) * cos(2 * pi() * {_u(seed + 1, *keys)}))"


def _summed(c: DataFrame) -> DataFrame:
    """Each crop by its number of cells and a sum that tells their places."""
    place = F.col("ci") * 100 + F.col("cx") * 10 + F.col("cd") + 1
    return c.groupBy("loc_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amp") * place), 4).alias("total"))


def _sum_sql(amp: str, ci: str = "ci", cx: str = "cx", cd: str = "cd", where: str = "") -> str:
    return f"WITH {_C} SELECT loc_id, count(*) AS n, round(CAST(sum(({amp}) * (({ci}) * 100 + ({cx}) * 10 + ({cd}) + 1)) AS DOUBLE), 4) AS total FROM cr {where} GROUP BY loc_id"


_ALL = ("loc_id", "ci", "cx", "cd")
for name, f, sql in (
    ("crop_invert", batch.invert, _sum_sql("-amp")),
    ("crop_sign", batch.sign, _sum_sql("sign(amp)")),
    ("crop_binarize", lambda c: batch.binarize(c, 0.1), _sum_sql("CASE WHEN amp > 0.1 THEN 1.0 ELSE 0.0 END")),
    ("crop_smooth_labels", lambda c: batch.smooth_labels(batch.binarize(c, 0.1), 0.05), _sum_sql("CASE WHEN amp > 0.1 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END")),
    ("crop_translate", lambda c: batch.translate(c, 5, 0.3, 7), _sum_sql(f"(amp + ({_u(7, 'loc_id')} * 2 - 1) * 5) * (1 + ({_u(8, 'loc_id')} * 2 - 1) * 0.3)")),
    ("crop_additive_noise", lambda c: batch.additive_noise(c, 0.2, 3), _sum_sql(f"amp + 0.2 * {_n(3, *_ALL)}")),
    ("crop_multiplicative_noise", lambda c: batch.multiplicative_noise(c, 0.2, 5), _sum_sql(f"amp * (1 + 0.2 * {_n(5, *_ALL)})")),
    ("crop_flip", lambda c: batch.flip(c, 1, 5), _sum_sql("amp", cx="4 - cx")),
    ("crop_transpose", lambda c: batch.transpose(c, (1, 0, 2)), _sum_sql("amp", ci="cx", cx="ci")),
    ("crop_center", lambda c: batch.center_crop(c, CROP, (3, 3, 8)), _sum_sql("amp", "ci - 1", "cx - 1", "cd - 4", "WHERE ci BETWEEN 1 AND 3 AND cx BETWEEN 1 AND 3 AND cd BETWEEN 4 AND 11")),
    ("crop_fill_bounds", lambda c: batch.fill_bounds(c, CROP, 0.2), _sum_sql("CASE WHEN ci BETWEEN 1 AND 3 AND cx BETWEEN 1 AND 3 AND cd BETWEEN 3 AND 12 THEN amp ELSE 0 END")),
    ("crop_filter_side", lambda c: batch.filter_side(c, 16, 0.25, "right", 2), _sum_sql("CASE WHEN cd >= 12 THEN 0 ELSE amp END")),
    ("crop_cutout", lambda c: batch.cutout(c, CROP, (2, 4), 2, 0, 11), _sum_sql("CASE WHEN " + " OR ".join(f"(cx >= floor({_u(11 + 2 * k, 'loc_id')} * 4) AND cx < floor({_u(11 + 2 * k, 'loc_id')} * 4) + 2 AND cd >= floor({_u(12 + 2 * k, 'loc_id')} * 13) AND cd < floor({_u(12 + 2 * k, 'loc_id')} * 13) + 4)" for k in (0, 1)) + " THEN 0 ELSE amp END")),
    ("crop_concat", lambda c: batch.concat([c, batch.invert(c)], [16, 16], 2), f"WITH {_C} SELECT loc_id, 2 * count(*) AS n, round(sum(amp * (ci * 100 + cx * 10 + cd + 1)) - sum(amp * (ci * 100 + cx * 10 + cd + 17)), 4) AS total FROM cr GROUP BY loc_id"),
):
    add(name, lambda s, d, f=f: _summed(f(_crops(s, d))), ["vox"], sql)
for kind, low, span in (("int8", -128, 255), ("uint8", 0, 255), ("uint16", 0, 65535)):
    add(f"proba_{kind}", lambda s, d, kind=kind: pts(s, d).select("p", batch.to_integer("p", kind).alias("code")).distinct().withColumn("back", F.round(batch.from_integer("code", kind), 6)).withColumn("p", F.round("p", 6)).distinct(), ["pts"], f"SELECT DISTINCT round(p, 6) AS p, CAST(trunc(p * {span} + {low}) AS BIGINT) AS code, round((trunc(p * {span} + {low}) - {low}) / CAST({span} AS DOUBLE), 6) AS back FROM pts")
add("crop_label_area", lambda s, d: batch.label_area(batch.binarize(_crops(s, d), 0.25)), ["vox"], f"WITH {_C}, t AS (SELECT loc_id, ci, cx, max(CASE WHEN amp > 0.25 THEN 1 ELSE 0 END) AS o FROM cr GROUP BY 1, 2, 3) SELECT loc_id, round(avg(o), 6) AS area FROM t GROUP BY loc_id")
add("crop_discontinuity", lambda s, d: batch.discontinuity(batch.binarize(_crops(s, d), 0.25)), ["vox"], f"""
WITH {_C}, t AS (SELECT loc_id, ci, cx, min(cd) AS lo, max(cd) AS hi FROM cr WHERE amp > 0.25 GROUP BY 1, 2, 3), z AS (SELECT loc_id, CASE WHEN cx - lag(cx) OVER w = 1 THEN greatest(lo, lag(lo) OVER w) - least(hi, lag(hi) OVER w) END AS z FROM t WINDOW w AS (PARTITION BY loc_id, ci ORDER BY cx))
SELECT loc_id, coalesce(max(z), 0) AS size FROM z GROUP BY loc_id""")
add("crop_rebatch", lambda s, d: _summed(batch.rebatch(_crops(s, d), batch.label_area(batch.binarize(_crops(s, d), 0.25)), "area", 0.3)), ["vox"], f"""
WITH {_C}, t AS (SELECT loc_id, ci, cx, max(CASE WHEN amp > 0.25 THEN 1 ELSE 0 END) AS o FROM cr GROUP BY 1, 2, 3), k AS (SELECT loc_id FROM t GROUP BY loc_id HAVING round(avg(o), 6) > 0.3)
SELECT loc_id, count(*) AS n, round(sum(amp * (ci * 100 + cx * 10 + cd + 1)), 4) AS total FROM cr WHERE loc_id IN (SELECT loc_id FROM k) GROUP BY loc_id""")
add("alive_crops", lambda s, d: batch.alive_crops(_grid(s, d), trc(s, d).where("label >= 5"), (5, 5), 12), ["trc"], f"WITH {_G} SELECT loc_id, count(*) AS n FROM g JOIN trc ON label >= 5 AND i >= i0 AND i < i0 + 5 AND x >= x0 AND x < x0 + 5 GROUP BY loc_id HAVING count(*) > 12")
add("acc_noop", lambda s, d: _last(s, d), ["vox"], f"WITH {_G.replace('range(lo, hi, 5)', 'range(lo, hi, 3)').replace('range(lo, hi, 16)', 'range(lo, hi, 12)')}, k AS (SELECT v.i, v.x, v.d, max(loc_id) AS v FROM g JOIN vox v ON v.i >= i0 AND v.i < i0 + 5 AND v.x >= x0 AND v.x < x0 + 5 AND v.d >= d0 AND v.d < d0 + 16 GROUP BY 1, 2, 3) SELECT i, x, d, v FROM k")


def _last(s: SparkSession, d: str) -> DataFrame:
    g = grids.regular_grid(grids.extent(trc(s, d)), CROP, (3, 3, 12))
    c = volume.load_crops(vox(s, d), g, CROP)
    return volume.accumulate(c.withColumn("amp", F.col("loc_id")), "noop").select("i", "x", "d", "v")


_STACK = "SELECT i, x, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, min(d) AS min, max(d) AS max, arg_min(s, (d, s)) AS argmin, arg_max(s, d * 1000 - ascii(s)) AS argmax, count(*) AS n FROM srf GROUP BY i, x"
add("stacked_surfaces", lambda s, d: srf(s, d).groupBy("i", "x").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_pop("d"), 6).alias("std"), F.min("d").alias("min"), F.max("d").alias("max"), F.min_by("s", F.struct("d", "s")).alias("argmin"), F.max_by("s", F.col("d") * 1000 - F.ascii("s")).alias("argmax"), F.count("*").alias("n")), ["srf"], _STACK)

# --- masks -----------------------------------------------------------------------------
_ORD = "CASE s WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
add("label_mask", lambda s, d: batch.label_mask(srf(s, d).withColumn("ordinal", F.expr(_ORD).cast("long"))), ["srf"], f"SELECT i, x, CAST(d + k AS BIGINT) AS d, CAST(max({_ORD}) + 1 AS BIGINT) AS value FROM srf CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) GROUP BY i, x, d + k")
add("regression_masks", lambda s, d: batch.regression_masks(_grid(s, d), _surface(s, d), CROP), ["srf", "trc"], f"""
WITH {_G}, t AS (SELECT loc_id, i0 + ci AS i, x0 + cx AS x, d0, ci, cx FROM g CROSS JOIN (SELECT unnest(range(0, 5)) AS ci) CROSS JOIN (SELECT unnest(range(0, 5)) AS cx))
SELECT loc_id, ci, cx, CASE WHEN d - d0 >= 0 AND d - d0 < 16 THEN d - d0 ELSE -1 END AS depth FROM t LEFT JOIN srf u ON u.s = 'A' AND u.i = t.i AND u.x = t.x""")
add("fault_mask", lambda s, d: batch.fault_mask(pts(s, d).where("p > 0.98").select("i", "x", "d"), "x", 3, pts(s, d).where("i % 2 = 0").select("i").distinct()).withColumn("value", F.col("value").cast("long")), ["pts"], "SELECT DISTINCT i, CAST(x + k AS BIGINT) AS x, d, CAST(CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS value FROM pts CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) WHERE p > 0.98")


def _surface(s: SparkSession, d: str) -> DataFrame:
    return srf(s, d).where("s = 'A'").select("i", "x", "d")


# --- locations --------------------------------------------------------------------------
add("location_batches", lambda s, d: batch.batches(_grid(s, d), 7).groupBy("batch").agg(F.count("*").alias("n"), F.min("loc_id").alias("first")), ["trc"], f"WITH {_G} SELECT CAST(loc_id // 7 AS BIGINT) AS batch, count(*) AS n, min(loc_id) AS first FROM g GROUP BY 1")
add("sample_rows", lambda s, d: batch.sample_rows(_surface(s, d), 200, 9), ["srf"], f"""
WITH a AS (SELECT i, x, d, row_number() OVER (ORDER BY md5(i || ',' || x || ',' || d), i, x, d) - 1 AS n FROM srf WHERE s = 'A'), k AS (SELECT draw, floor({_u(9, 'draw')} * (SELECT count(*) FROM a)) AS n FROM (SELECT unnest(range(0, 200)) AS draw))
SELECT i, x, d, draw FROM a JOIN k USING (n)""")
add("candidate_starts", lambda s, d: batch.candidate_starts(_surface(s, d), (100, 50, 64), (4, 9, 16)), ["srf"], "SELECT DISTINCT CAST(o AS BIGINT) AS orientation, i AS i0, x AS x0, least(greatest(d - 8, 0), 48) AS d0 FROM srf CROSS JOIN (SELECT 0 AS o, 4 AS p, 9 AS q UNION ALL SELECT 1, 9, 4) WHERE s = 'A' AND i + p <= 100 AND x + q <= 50")
for by_size in (False, True):
    share = "CAST(floor(300 * n / sum(n) OVER ()) AS BIGINT)" if by_size else "CAST(floor(300 / count(*) OVER ()) AS BIGINT)"
    add(f"sampler_{'by_size' if by_size else 'uniform'}", lambda s, d, by_size=by_size: batch.mixture(srf(s, d).withColumnRenamed("s", "source"), 300, 4, by_size), ["srf"], f"""
WITH n AS (SELECT s, count(*) AS n FROM srf GROUP BY s), q AS (SELECT s, {share} AS q FROM n), r AS (SELECT s AS source, i, x, d, row_number() OVER (PARTITION BY s ORDER BY md5('4,' || s || ',' || i || ',' || x || ',' || d), i, x, d) AS r FROM srf)
SELECT source, i, x, d FROM r JOIN q ON q.s = source WHERE r <= q""")
add("random_locations", lambda s, d: batch.random_locations(100, (20, 25, 64), 3, 10, s), ["trc"], f"""
WITH k AS (SELECT unnest(range(0, 100)) AS k FROM (SELECT count(*) FROM trc)), z AS (SELECT k, {', '.join(f"3 + CAST(floor({_u(42 + 2 * j, 'k')} * 8) AS BIGINT) AS z{a}" for j, a in enumerate("ixd"))} FROM k), p AS (SELECT *, {', '.join(f"CAST(floor({_u(43 + 2 * j, 'k')} * ({m} - z{a} + 1)) AS BIGINT) AS {a}0" for j, (a, m) in enumerate(zip("ixd", (20, 25, 64), strict=True)))} FROM z)
SELECT k, i0, i0 + zi AS i1, x0, x0 + zx AS x1, d0, d0 + zd AS d1 FROM p""")
add("extension_grid", lambda s, d: batch.extension_grid(_surface(s, d).where("d > 22"), (100, 50), (6, 6), 2, 1), ["srf"], """
WITH u AS (SELECT i, x FROM srf WHERE s = 'A' AND d > 22), b AS (SELECT p.i, p.x FROM u p JOIN u q ON q.i BETWEEN p.i - 1 AND p.i + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.i, p.x HAVING count(*) < 9), m(di, dx) AS (VALUES (-4, 0), (-2, 0), (0, -4), (0, -2)),
e AS (SELECT DISTINCT i, x, least(greatest(i + di, 0), 94) AS i0, least(greatest(x + dx, 0), 44) AS x0 FROM b CROSS JOIN m), l AS (SELECT DISTINCT i0, x0 FROM e), g AS (SELECT i0, x0, 36 - count(u.i) AS gain FROM l LEFT JOIN u ON u.i >= i0 AND u.i < i0 + 6 AND u.x >= x0 AND u.x < x0 + 6 GROUP BY i0, x0)
SELECT i, x, i0, x0, gain FROM e JOIN g USING (i0, x0) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY i, x ORDER BY gain DESC, i0, x0) = 1""")
add("named_ids", lambda s, d: batch.named(table(s, d, "supplier").select(F.col("s_suppkey").alias("loc_id"), F.col("s_nationkey").alias("field_id")), table(s, d, "nation").select(F.col("n_nationkey").alias("field_id"), F.col("n_name").alias("name")), "field_id"), None, "SELECT s_nationkey AS field_id, s_suppkey AS loc_id, n_name AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")

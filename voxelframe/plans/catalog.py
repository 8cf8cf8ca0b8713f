"""Registered queries of the gridded-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, signal
from ..operators import components, grids, metrics, mistie, surface, traces, volume, wells
from ..streaming.surface import windowed_logs
from .registry import ORACLES, QUERIES, add
from .views import edges, fac, logs, pts, srf, table, trc, vox

__all__ = ["ORACLES", "QUERIES"]
CROP, STRIDE = (5, 5, 16), (3, 4, 12)


def _named(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: srf(s, d).where(F.col("s") == name).select("i", "x", "d")


A, N, R = _named("A"), _named("N"), _named("R")
ONE = "a AS (SELECT i, x, d FROM srf WHERE s = 'A'), n AS (SELECT i, x, d FROM srf WHERE s = 'N'), r AS (SELECT i, x, d FROM srf WHERE s = 'R')"

# --- per-trace aggregation -------------------------------------------------
for how, sql in {"mean": "CAST(round_even(avg(d), 0) AS BIGINT)", "min": "min(d)", "max": "max(d)", "prob": "CAST(round_even(sum(d * p) / sum(p), 0) AS BIGINT)"}.items():
    add(f"trace_{how}", lambda s, d, how=how: surface.trace_surface(pts(s, d), how), ["pts"], f"SELECT i, x, {sql} AS d FROM pts GROUP BY i, x")
add("trace_all", lambda s, d: surface.trace_surface(pts(s, d), "all"), ["pts"], "SELECT i, x, count(*) AS n, min(d) AS d_min, max(d) AS d_max, CAST(floor(avg(d)) AS BIGINT) AS d_mean FROM pts GROUP BY i, x")
_STATS = "count(*) AS n, min(amp) AS min, max(amp) AS max, round(avg(amp), 6) AS mean, round(stddev_pop(amp), 6) AS std FROM vox"
add("cube_stats_trace", lambda s, d: volume.stats(vox(s, d), ["i", "x"]), ["vox"], f"SELECT i, x, {_STATS} GROUP BY i, x")
add("cube_stats_depth", lambda s, d: volume.stats(vox(s, d), ["d"]), ["vox"], f"SELECT d, {_STATS} GROUP BY d")
add("cube_stats_global", lambda s, d: volume.stats(vox(s, d), []), ["vox"], f"SELECT {_STATS}")
_Q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
add("cube_quantiles", lambda s, d: volume.quantiles(vox(s, d), _Q), ["vox"], " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(amp, {q}), 6) AS value FROM vox" for q in _Q))
add("surface_stats", lambda s, d: surface.stats(srf(s, d), ["s"]), ["srf"], "SELECT s, count(*) AS n, min(d) AS d_min, max(d) AS d_max, round(avg(d), 6) AS d_mean, round(stddev_pop(d), 6) AS d_std, min(i) AS i_min, max(i) AS i_max, min(x) AS x_min, max(x) AS x_max FROM srf GROUP BY s")
add("prediction_std", lambda s, d: surface.prediction_std(srf(s, d)), ["srf"], "SELECT i, x, count(*) AS n, round(stddev_pop(d), 6) AS std FROM srf GROUP BY i, x")
add("surface_coverage", lambda s, d: surface.coverage(srf(s, d), pts(s, d).select("i", "x").distinct()), ["srf"], "WITH al AS (SELECT DISTINCT i, x FROM pts) SELECT s, count(*) AS n, round(count(*) / (SELECT count(*) FROM al), 5) AS coverage, round(count(*) / ((max(i) - min(i) + 1) * (max(x) - min(x) + 1)), 5) AS solidity FROM srf GROUP BY s")
add("carcass_lines", lambda s, d: surface.carcass_lines(srf(s, d)), ["srf"], "SELECT s, 'i' AS axis, i AS line, count(*) AS n FROM srf GROUP BY s, i HAVING count(*) > 20 UNION ALL SELECT s, 'x', x, count(*) FROM srf GROUP BY s, x HAVING count(*) > 20")
add("facies_confusion", lambda s, d: metrics.confusion(fac(s, d), "t", "p"), ["fac"], """WITH c AS (SELECT count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t <> 1 AND p <> 1) AS tn, count(*) FILTER (t <> 1 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p <> 1) AS fn FROM fac)
SELECT tp, tn, fp, fn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice, round(tp / nullif(tp + fp + fn, 0), 6) AS iou FROM c""")
add("fault_similarity", lambda s, d: metrics.fault_similarity(vox(s, d), vox(s, d).where("amp > 0.3")), ["vox"], """WITH m AS (SELECT i, x, d FROM vox WHERE amp > 0.3), k AS (SELECT unnest([0, -20, -15, -5, 5, 15, 20]) AS k),
t AS (SELECT k.k, sum(1 - v.amp) AS s FROM m CROSS JOIN k JOIN vox v ON v.i = m.i AND v.x = m.x + k.k AND v.d = m.d GROUP BY k.k)
SELECT count(*) AS n, round(avg(least(greatest(ln((SELECT s FROM t WHERE k = 0) / s), -2), 2)), 6) AS similarity FROM t WHERE k <> 0""")
add("fault_sizes", lambda s, d: metrics.sizes(vox(s, d).join(trc(s, d).select("i", "x", F.col("label").cast("long").alias("label")), ["i", "x"]).where("amp > 0.2"), "label"), ["vox"], "SELECT CAST(label AS BIGINT) AS label, count(*) AS voxels, round(sqrt((max(i) - min(i)) * (max(i) - min(i)) + (max(x) - min(x)) * (max(x) - min(x))), 6) AS extent, max(d) - min(d) AS height FROM vox JOIN trc USING (i, x) WHERE amp > 0.2 GROUP BY label")

# --- joins of surfaces -----------------------------------------------------
_CMP = """SELECT round(avg(a.d - n.d), 4) AS mean, round(avg(abs(a.d - n.d)), 4) AS abs_mean, min(a.d - n.d) AS min, max(a.d - n.d) AS max, round(stddev_pop(a.d - n.d), 4) AS std, round(stddev_pop(abs(a.d - n.d)), 4) AS abs_std,
round(avg(CASE WHEN a.d IS NOT NULL AND n.d IS NOT NULL THEN CAST(abs(a.d - n.d) <= 0 AS INT) END), 4) AS accuracy_0, round(avg(CASE WHEN a.d IS NOT NULL AND n.d IS NOT NULL THEN CAST(abs(a.d - n.d) <= 1 AS INT) END), 4) AS accuracy_1,
round(avg(CASE WHEN a.d IS NOT NULL AND n.d IS NOT NULL THEN CAST(abs(a.d - n.d) <= 2 AS INT) END), 4) AS accuracy_2, count(a.d - n.d) AS overlap, round(count(a.d - n.d) / count(a.d), 4) AS coverage,
round(avg(CASE WHEN a.d IS NOT NULL AND n.d IS NOT NULL THEN CAST(abs(a.d - n.d) < 2.5 AS INT) END), 4) AS window_rate, count(*) FILTER (n.d IS NULL) AS only_a, count(*) FILTER (a.d IS NULL) AS only_b FROM a FULL JOIN n ON a.i = n.i AND a.x = n.x"""
add("proximity", lambda s, d: surface.compare(A(s, d), N(s, d)), ["srf"], f"WITH {ONE} {_CMP}")
add("closest_surface", lambda s, d: surface.closest(srf(s, d)), ["srf"], "WITH m AS (SELECT a.s AS s, b.s AS closest, round(avg(abs(a.d - b.d)), 6) AS abs_mean FROM srf a JOIN srf b ON a.i = b.i AND a.x = b.x AND a.s <> b.s GROUP BY a.s, b.s) SELECT s, closest, abs_mean FROM m QUALIFY row_number() OVER (PARTITION BY s ORDER BY abs_mean, closest) = 1")
add("surface_minus", lambda s, d: surface.minus(A(s, d), N(s, d)), ["srf"], f"WITH {ONE} SELECT i, x, d FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.i = a.i AND n.x = a.x)")
add("proportional", lambda s, d: surface.proportional(A(s, d), N(s, d), 0.3), ["srf"], f"WITH {ONE} SELECT a.i, a.x, CAST(ceil(least(a.d, n.d) + CAST(0.3 AS DOUBLE) * (greatest(a.d, n.d) - least(a.d, n.d))) AS BIGINT) AS d FROM a JOIN n ON a.i = n.i AND a.x = n.x")
add("merge_surfaces", lambda s, d: surface.merge(srf(s, d)), ["srf"], "SELECT i, x, CAST(round_even(avg(d), 0) AS BIGINT) AS d FROM srf GROUP BY i, x")
add("overlap_merge", lambda s, d: surface.overlap_merge(A(s, d), N(s, d)), ["srf"], f"WITH {ONE} SELECT coalesce(a.i, n.i) AS i, coalesce(a.x, n.x) AS x, CASE WHEN a.d IS NOT NULL AND n.d IS NOT NULL THEN CAST(floor((a.d + n.d) / 2) AS BIGINT) ELSE coalesce(a.d, n.d) END AS d FROM a FULL JOIN n ON a.i = n.i AND a.x = n.x")
add("merge_status", lambda s, d: surface.merge_status(srf(s, d)), ["srf"], """WITH q AS (SELECT DISTINCT s FROM srf), m AS (SELECT a.s AS a, b.s AS b, count(*) AS overlap, round(avg(abs(a.d - b.d)), 6) AS abs_mean, max(abs(a.d - b.d)) AS abs_max FROM srf a JOIN srf b ON a.i = b.i AND a.x = b.x AND a.s < b.s GROUP BY 1, 2)
SELECT p.s AS a, q.s AS b, coalesce(overlap, 0) AS overlap, abs_mean, abs_max, CAST(CASE WHEN overlap IS NULL THEN 3 WHEN abs_max > 20 THEN 0 WHEN abs_mean > 1 THEN 1 ELSE 4 END AS BIGINT) AS status FROM q p JOIN q ON p.s < q.s LEFT JOIN m ON m.a = p.s AND m.b = q.s""")

# --- filters, sets, grids, projections -------------------------------------
add("anti_filter", lambda s, d: surface.drop_masked(pts(s, d), R(s, d)).groupBy("i", "x").agg(F.count("*").alias("n")), ["srf"], f"WITH {ONE} SELECT i, x, count(*) AS n FROM pts p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = p.i AND r.x = p.x) GROUP BY i, x")
add("subset", lambda s, d: surface.keep_masked(A(s, d), N(s, d).where("d >= 25")), ["srf"], f"WITH {ONE} SELECT i, x, d FROM a WHERE EXISTS (SELECT 1 FROM n WHERE n.i = a.i AND n.x = a.x AND n.d >= 25)")
add("thin_out", lambda s, d: surface.thin_out(srf(s, d)), ["srf"], """WITH li AS (SELECT s, i, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS k FROM (SELECT s, i FROM srf GROUP BY s, i HAVING count(*) > 20)), lx AS (SELECT s, x, row_number() OVER (PARTITION BY s ORDER BY x) - 1 AS k FROM (SELECT s, x FROM srf GROUP BY s, x HAVING count(*) > 20))
SELECT s, i, x, d FROM srf WHERE (s, i) IN (SELECT s, i FROM li WHERE k % 2 = 0) OR (s, x) IN (SELECT s, x FROM lx WHERE k % 2 = 0)""")
add("grid_lines", lambda s, d: surface.on_grid(srf(s, d), (10, 7)), ["srf"], "SELECT s, i, x, d FROM srf WHERE i % 10 = 0 OR x % 7 = 0")
_STARTS = "(SELECT DISTINCT least(v, greatest(hi - {c}, lo)) AS {a}0 FROM (SELECT lo, hi, unnest(range(lo, hi, {t})) AS v FROM (SELECT {lo} AS lo, {hi} AS hi FROM trc)))"
_AX = [_STARTS.format(a=a, c=c, t=t, lo=lo, hi=hi) for a, c, t, lo, hi in zip("ixd", CROP, STRIDE, ("min(i)", "min(x)", "0"), ("max(i) + 1", "max(x) + 1", "max(len(samples))"), strict=True)]
_GRID = f"g AS (SELECT i0, x0, d0, row_number() OVER (ORDER BY i0, x0, d0) - 1 AS loc_id FROM {_AX[0]} CROSS JOIN {_AX[1]} CROSS JOIN {_AX[2]})"


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Over all traces of the table."""
    return grids.regular_grid(grids.extent(trc(s, d)), CROP, STRIDE)


add("regular_grid", lambda s, d: _grid(s, d), ["trc"], f"WITH {_GRID} SELECT loc_id, CAST(i0 AS BIGINT) AS i0, CAST(x0 AS BIGINT) AS x0, CAST(d0 AS BIGINT) AS d0, CAST(i0 + 5 AS BIGINT) AS i1, CAST(x0 + 5 AS BIGINT) AS x1, CAST(d0 + 16 AS BIGINT) AS d1 FROM g")
_points = lambda s, d, name: _named(name)(s, d).select(F.col("i").alias("i0"), F.col("x").alias("x0"), F.col("d").alias("d0"))
add("grid_union", lambda s, d: grids.union(_points(s, d, "A"), _points(s, d, "N")), ["srf"], f"WITH {ONE} SELECT i AS i0, x AS x0, d AS d0 FROM a UNION SELECT i, x, d FROM n")
add("new_locations", lambda s, d: grids.unseen(_points(s, d, "A"), _points(s, d, "N")), ["srf"], f"WITH {ONE} SELECT i AS i0, x AS x0, d AS d0 FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.i = a.i AND n.x = a.x AND n.d = a.d)")
add("grid_chunks", lambda s, d: grids.chunks(_grid(s, d), CROP[:2], (10, 12), (8, 10)), ["trc"], f"""WITH {_GRID}, ki AS (SELECT unnest(range(0, max(i0) // 8 + 1)) AS ki FROM g), kx AS (SELECT unnest(range(0, max(x0) // 10 + 1)) AS kx FROM g)
SELECT loc_id, CAST(ki AS BIGINT) AS ki, CAST(kx AS BIGINT) AS kx FROM g CROSS JOIN ki CROSS JOIN kx WHERE i0 >= ki * 8 AND i0 + 5 <= ki * 8 + 10 AND x0 >= kx * 10 AND x0 + 5 <= kx * 10 + 12""")
add("lines_to_ordinals", lambda s, d: table(s, d, "lineitem").select(F.col("l_suppkey").alias("line"), F.floor((F.col("l_suppkey") - 7) / 3).alias("ordinal")).distinct(), None, None)
ORACLES["lines_to_ordinals"] = "SELECT DISTINCT l_suppkey AS line, CAST(floor((l_suppkey - 7) / 3) AS BIGINT) AS ordinal FROM lineitem"
add("affine_fit", lambda s, d: pts(s, d).agg(*(F.round(f("x", "d"), 6).alias(n) for n, f in (("covar", F.covar_pop), ("slope", lambda a, b: F.regr_slope(F.col(b), F.col(a))), ("intercept", lambda a, b: F.regr_intercept(F.col(b), F.col(a)))))), ["pts"], "SELECT round(covar_pop(d, x), 6) AS covar, round(regr_slope(d, x), 6) AS slope, round(regr_intercept(d, x), 6) AS intercept FROM pts")
add("quantize", lambda s, d: volume.quantize(vox(s, d)), ["vox"], "WITH r AS (SELECT least(abs(quantile_cont(amp, 0.99)), abs(quantile_cont(amp, 0.01))) AS r FROM vox) SELECT i, x, d, CAST(round_even(least(greatest(amp, -r), r) / r * 127, 0) AS BIGINT) AS q FROM vox, r")
for mode, e in {"mean": "amp - m", "std": "amp / s", "meanstd": "(amp - m) / s", "minmax": "(amp - lo) / (hi - lo)"}.items():
    add(f"normalize_{mode}", lambda s, d, mode=mode: volume.normalize(vox(s, d), mode), ["vox"], f"WITH q AS (SELECT avg(amp) AS m, stddev_pop(amp) AS s, min(amp) AS lo, max(amp) AS hi FROM vox) SELECT i, x, d, round({e}, 6) AS amp FROM vox, q")
add("snr", lambda s, d: volume.signal_to_noise(trc(s, d)), ["vox"], "SELECT i, x, round(CASE WHEN var_pop(amp) > 0 THEN ln((avg(amp) * avg(amp) + 1) / (var_pop(amp) + 1)) END, 6) AS snr FROM vox GROUP BY i, x")
add("top_lines", lambda s, d: srf(s, d).groupBy("s", "i").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s", "i").limit(25), ["srf"], "SELECT s, i, count(*) AS n FROM srf GROUP BY s, i ORDER BY n DESC, s, i LIMIT 25")

# --- volume joins ----------------------------------------------------------
_SURF = "u AS (SELECT i, x, CAST(d AS BIGINT) AS d FROM (SELECT i, x, arg_max(d, amp) AS d FROM vox WHERE d BETWEEN 8 AND 40 GROUP BY i, x))"


def _peaks(s: SparkSession, d: str) -> DataFrame:
    """A surface inside the cube: depth of the largest amplitude within 8..40."""
    return vox(s, d).where("d between 8 and 40").groupBy("i", "x").agg(F.max_by("d", "amp").alias("d"))


add("cube_values", lambda s, d: volume.along_surface(vox(s, d), _peaks(s, d), 5, 1), ["vox"], f"WITH {_SURF} SELECT u.i, u.x, u.d, CAST(w AS BIGINT) AS w, round(v.amp, 6) AS amp FROM u CROSS JOIN (SELECT unnest(range(0, 5)) AS w) LEFT JOIN vox v ON v.i = u.i AND v.x = u.x AND v.d = u.d + 1 - 2 + w")
add("layer_values", lambda s, d: volume.between_surfaces(vox(s, d), _peaks(s, d), _peaks(s, d).withColumn("d", F.col("d") + 6)), ["vox"], f"WITH {_SURF} SELECT u.i, u.x, count(*) AS n, round(avg(amp), 6) AS mean FROM u JOIN vox v ON v.i = u.i AND v.x = u.x AND v.d BETWEEN u.d AND u.d + 6 GROUP BY u.i, u.x")
add("zero_crossing", lambda s, d: volume.zero_crossing(vox(s, d), _peaks(s, d)), ["vox"], f"WITH {_SURF}, w AS (SELECT u.i, u.x, u.d AS c, v.d, amp, lead(amp) OVER (PARTITION BY u.i, u.x ORDER BY v.d) AS nx FROM u JOIN vox v ON v.i = u.i AND v.x = u.x AND v.d BETWEEN u.d AND u.d + 15) SELECT i, x, c AS d, round(d + amp / (amp - nx), 6) AS crossing FROM w WHERE amp * nx < 0 QUALIFY row_number() OVER (PARTITION BY i, x ORDER BY w.d) = 1")
_BOX = (5, 5, 10, 60, 40, 40)
_INBOX = "i >= 5 AND i < 60 AND x >= 5 AND x < 40"
add("rasterize", lambda s, d: volume.rasterize(A(s, d), _BOX, 3), ["srf"], f"WITH {ONE} SELECT i, x, CAST(d + k AS BIGINT) AS d FROM a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) WHERE {_INBOX} AND d + k >= 10 AND d + k < 40")
add("regression_mask", lambda s, d: volume.regression_mask(A(s, d), _BOX), ["srf"], f"WITH {ONE} SELECT i, x, round((d - 10) / 30, 6) AS d FROM a WHERE {_INBOX} AND d >= 10 AND d < 40")
_LOADED = f"{_GRID}, cr AS (SELECT loc_id, v.i, v.x, v.d, v.i - i0 AS ci, v.x - x0 AS cx, v.d - d0 AS cd, amp FROM g JOIN vox v ON v.i >= i0 AND v.i < i0 + 5 AND v.x >= x0 AND v.x < x0 + 5 AND v.d >= d0 AND v.d < d0 + 16)"
_crops = lambda s, d: volume.load_crops(vox(s, d), _grid(s, d), CROP)
add("crop_load", lambda s, d: _crops(s, d).groupBy("loc_id").agg(F.count("*").alias("n"), F.round(F.sum("amp"), 6).alias("total")), ["vox"], f"WITH {_LOADED} SELECT loc_id, count(*) AS n, round(sum(amp), 6) AS total FROM cr GROUP BY loc_id")
for how, e in {"max": "max(amp + loc_id)", "mean": "avg(amp + loc_id)", "std": "stddev_pop(amp + loc_id)", "gmean": "exp(avg(ln(abs(amp) + 1 + loc_id)))"}.items():
    value = "abs(amp) + 1 + loc_id" if how == "gmean" else "amp + loc_id"
    add(f"acc_{how}", lambda s, d, how=how, value=value: volume.accumulate(_crops(s, d).withColumn("amp", F.expr(value)), how), ["vox"], f"WITH {_LOADED} SELECT i, x, d, round({e}, 6) AS v FROM cr GROUP BY i, x, d")
add("acc_mode", lambda s, d: volume.accumulate(_crops(s, d).withColumn("amp", F.col("loc_id") % 3), "mode"), ["vox"], f"WITH {_LOADED}, c AS (SELECT i, x, d, loc_id % 3 AS v, count(*) AS n FROM cr GROUP BY 1, 2, 3, 4) SELECT i, x, d, v FROM c QUALIFY row_number() OVER (PARTITION BY i, x, d ORDER BY n DESC, v) = 1")
_W = " * ".join(f"(0.1 + (1 - abs({c} - {h}) / {h}) * 0.95)" for c, h in (("ci", 2.0), ("cx", 2.0), ("cd", 7.5))).replace("0.1 ", "CAST(0.1 AS DOUBLE) ").replace("0.95", "CAST(0.95 AS DOUBLE)")
add("acc_weighted", lambda s, d: volume.accumulate(_crops(s, d).withColumn("amp", F.col("amp") + F.col("loc_id")), "weighted", crop=CROP), ["vox"], f"WITH {_LOADED} SELECT i, x, d, round(sum({_W} * (amp + loc_id)) / sum({_W}), 6) AS v FROM cr GROUP BY i, x, d")
add("spatial_check", lambda s, d: grids.crops_with_labels(_grid(s, d), _peaks(s, d), CROP, 6), ["vox"], f"WITH {_SURF}, {_GRID} SELECT loc_id, count(*) AS n FROM g JOIN u ON u.i >= i0 AND u.i < i0 + 5 AND u.x >= x0 AND u.x < x0 + 5 AND u.d >= d0 AND u.d < d0 + 16 GROUP BY loc_id HAVING count(*) >= 6")

# --- stencils --------------------------------------------------------------
_NB = "SELECT c.s, c.i, c.x, c.d AS c, n.d, n.i - c.i AS di, n.x - c.x AS dx FROM srf c JOIN srf n ON n.s = c.s AND n.i BETWEEN c.i - {r} AND c.i + {r} AND n.x BETWEEN c.x - {r} AND c.x + {r}"
for axis, other in (("i", "x"), ("x", "i")):
    add(f"gradient_{axis}", lambda s, d, axis=axis: surface.gradient(srf(s, d), "s", axis), ["srf"], f"SELECT s, i, x, CASE WHEN {axis} - lag({axis}) OVER w = 1 THEN d - lag(d) OVER w END AS g FROM srf WINDOW w AS (PARTITION BY s, {other} ORDER BY {axis})")
add("boundary", lambda s, d: surface.boundary(srf(s, d), "s"), ["srf"], f"WITH q AS ({_NB.format(r=1)}) SELECT s, i, x, c AS d FROM q GROUP BY s, i, x, c HAVING count(*) < 9")
add("dilate", lambda s, d: surface.dilate(srf(s, d), "s", 2), ["srf"], "SELECT s, CAST(i + a AS BIGINT) AS i, CAST(x + b AS BIGINT) AS x, max(d) AS d FROM srf CROSS JOIN (SELECT unnest(range(-2, 3)) AS a) CROSS JOIN (SELECT unnest(range(-2, 3)) AS b) GROUP BY 1, 2, 3")
_K = [[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]]
_KW = "(2 - abs(di)) * (2 - abs(dx))"
add("smooth", lambda s, d: surface.smooth(srf(s, d), "s", _K, max_difference=10), ["srf"], f"WITH q AS ({_NB.format(r=1)}) SELECT s, i, x, round(sum({_KW} * d) / sum({_KW}), 6) AS d FROM q WHERE abs(d - c) <= 10 GROUP BY s, i, x")
add("bilateral", lambda s, d: surface.smooth(srf(s, d), "s", _K, sigma_range=5.0), ["srf"], f"WITH q AS ({_NB.format(r=1)}), w AS (SELECT *, {_KW} * exp(-((d - c) * (d - c)) / CAST(50 AS DOUBLE)) AS w FROM q) SELECT s, i, x, round(sum(w * d) / sum(w), 6) AS d FROM w GROUP BY s, i, x")
add("median_difference", lambda s, d: surface.median_difference(srf(s, d), "s"), ["srf"], f"WITH q AS ({_NB.format(r=2)}) SELECT s, i, x, max(c) - median(d) FILTER (di <> 0 OR dx <> 0) AS diff FROM q GROUP BY s, i, x")
add("fill_missing", lambda s, d: surface.fill_missing(srf(s, d), "s", 3, 30), ["srf"], "WITH e AS (SELECT s, CAST(i + a AS BIGINT) AS i, CAST(x + b AS BIGINT) AS x, a, b, d FROM srf CROSS JOIN (SELECT unnest(range(-1, 2)) AS a) CROSS JOIN (SELECT unnest(range(-1, 2)) AS b)) SELECT s, i, x, round(avg(d), 6) AS d FROM e GROUP BY s, i, x HAVING count(*) FILTER (a = 0 AND b = 0) = 0 AND count(*) >= 3 AND max(d) - min(d) <= 30")
add("moving_normalization", lambda s, d: traces.local_statistics(vox(s, d), 3), ["vox"], "SELECT i, x, d, round(CASE WHEN stddev_pop(amp) OVER w > 1e-12 THEN (amp - avg(amp) OVER w) / stddev_pop(amp) OVER w END, 6) AS v FROM vox WINDOW w AS (PARTITION BY i, x ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
add("semblance", lambda s, d: traces.semblance(vox(s, d)), ["vox"], "WITH e AS (SELECT CAST(i + a AS BIGINT) AS i, CAST(x + b AS BIGINT) AS x, d, amp FROM vox CROSS JOIN (SELECT unnest(range(-1, 2)) AS a) CROSS JOIN (SELECT unnest(range(-1, 2)) AS b)), g AS (SELECT i, x, d, sum(amp) AS s, sum(amp * amp) AS q, count(*) AS n FROM e GROUP BY i, x, d) SELECT i, x, max(n) AS n, round(sum(s * s) / (max(n) * sum(q)), 6) AS semblance FROM g GROUP BY i, x")

# --- traces ----------------------------------------------------------------
add("support_correlation", lambda s, d: traces.support_correlation(trc(s, d), traces.find_supports(trc(s, d), 50)), ["vox"], """WITH t AS (SELECT i, x, d, amp - avg(amp) OVER (PARTITION BY i, x) AS z FROM vox), k AS (SELECT i, x, sqrt(avg(z * z)) AS sd FROM t GROUP BY i, x),
h AS (SELECT i, x, sd FROM k WHERE sd > 0 ORDER BY md5('0,' || i || ',' || x), i, x LIMIT 50),
c AS (SELECT a.i, a.x, h.i AS j, h.x AS y, avg(a.z * b.z) / (k.sd * h.sd) AS m FROM h JOIN t b ON b.i = h.i AND b.x = h.x JOIN t a ON a.d = b.d JOIN k ON k.i = a.i AND k.x = a.x GROUP BY a.i, a.x, h.i, h.x, k.sd, h.sd)
SELECT i, x, round(avg(m), 6) AS corr FROM c GROUP BY i, x""")
add("local_correlation", lambda s, d: traces.local_correlation(trc(s, d)), ["vox"], "WITH t AS (SELECT i, x, d, amp - avg(amp) OVER (PARTITION BY i, x) AS z FROM vox), k AS (SELECT i, x, sqrt(avg(z * z)) AS sd FROM t GROUP BY i, x), c AS (SELECT a.i, a.x, b.i AS j, b.x AS y, avg(a.z * b.z) AS m FROM t a JOIN t b ON a.d = b.d AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (a.i <> b.i OR a.x <> b.x) GROUP BY 1, 2, 3, 4) SELECT c.i, c.x, round(avg(m / (p.sd * q.sd)), 6) AS corr FROM c JOIN k p ON p.i = c.i AND p.x = c.x JOIN k q ON q.i = c.j AND q.x = c.y GROUP BY c.i, c.x")


def _beside(s: SparkSession, d: str) -> DataFrame:
    """Each trace with the next one along x."""
    t = trc(s, d)
    return t.select("i", "x", F.col("samples").alias("a")).join(t.select("i", (F.col("x") - 1).alias("x"), F.col("samples").alias("b")), ["i", "x"])


add("crosscorrelation_lag", lambda s, d: traces.best_lag(_beside(s, d), "a", "b", 5).select("i", "x", F.col("lag").cast("long")), ["vox"], "WITH l AS (SELECT unnest(range(-5, 6)) AS l), c AS (SELECT a.i, a.x, l.l, round(sum(a.amp * b.amp), 9) AS c FROM vox a JOIN vox b ON b.i = a.i AND b.x = a.x + 1 JOIN l ON b.d = a.d - l.l GROUP BY 1, 2, 3) SELECT i, x, l AS lag FROM c QUALIFY row_number() OVER (PARTITION BY i, x ORDER BY c DESC, l) = 1")
add("envelope", lambda s, d: trc(s, d).select("i", "x", F.transform(signal.envelope("samples"), lambda v: F.round(v, 6)).alias("v")))
add("phase", lambda s, d: trc(s, d).select("i", "x", signal.phase("samples", True).alias("v")))
add("instantaneous_frequency", lambda s, d: trc(s, d).select("i", "x", signal.instantaneous_frequency("samples").alias("v")))
add("spectrum", lambda s, d: trc(s, d).select("i", "x", F.transform(signal.amplitude_spectrum("samples"), lambda v: F.round(v, 6)).alias("v")))
add("wavelet_transform", lambda s, d: trc(s, d).select("i", "x", signal.wavelet("samples", 4.0).alias("v")))
add("lowpass", lambda s, d: trc(s, d).select("i", "x", signal.lowpass("samples", 0.4).alias("v")))
add("modify_trace", lambda s, d: trc(s, d).select("i", "x", signal.modify_trace("samples", 1.5, 30.0, 0.9).alias("v")))
add("match_pair", lambda s, d: _beside(s, d).select("i", "x", signal.match_pair("a", "b").alias("m")).select("i", "x", *(F.col("m")[k].alias(n) for k, n in enumerate(("shift", "angle", "gain", "corr")))))

# --- wells, components, misties, faults, streams ---------------------------
_of = lambda s, d, kind: logs(s, d).where(F.col("kind") == kind).select("well", "t", "v")
add("reflectivity", lambda s, d: wells.reflectivity(logs(s, d)), ["logs"], "SELECT well, t, round(CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v + lag(v) OVER w = 0 THEN NULL ELSE (v - lag(v) OVER w) / (v + lag(v) OVER w) END, 6) AS r FROM logs WINDOW w AS (PARTITION BY well ORDER BY t)")
add("log_interpolate", lambda s, d: wells.interpolate_log(_of(s, d, "click"), _of(s, d, "view")), ["logs"], """WITH l AS (SELECT well, t FROM logs WHERE kind = 'click'), r AS (SELECT well, t, v FROM logs WHERE kind = 'view'),
j AS (SELECT l.well, l.t, a.t AS ta, a.v AS va, b.t AS tb, b.v AS vb FROM l ASOF LEFT JOIN r a ON a.well = l.well AND a.t <= l.t ASOF LEFT JOIN r b ON b.well = l.well AND b.t >= l.t)
SELECT well, t, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) AS v FROM j""")
add("log_trim", lambda s, d: wells.trim_constant_ends(logs(s, d).withColumn("v", F.floor(F.col("v") / 50).cast("double"))), ["logs"], "WITH q AS (SELECT well, t, CAST(floor(v / 50) AS DOUBLE) AS v FROM logs), c AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM q WINDOW w AS (PARTITION BY well ORDER BY t)), k AS (SELECT *, min(CASE WHEN v <> pv THEN pt END) OVER (PARTITION BY well) AS lo, max(CASE WHEN v <> pv THEN t END) OVER (PARTITION BY well) AS hi FROM c) SELECT well, t, CASE WHEN t >= lo AND t <= hi THEN v END AS v FROM k")
_mask = lambda s, d: pts(s, d).where("p >= 0.9999").select("i", "x", "d")
_EXT = (50, 64)
_CC = """WITH v AS (SELECT DISTINCT i, x, d, (i * 50 + x) * 64 + d AS n FROM pts WHERE p >= 0.9999), e AS (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.d BETWEEN a.d - 1 AND a.d + 1 AND a.n <> b.n),
r(n, c) AS (SELECT n, n FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), m AS (SELECT n, min(c) AS c FROM r GROUP BY n), lab AS (SELECT v.i, v.x, v.d, m.c FROM v JOIN m USING (n))"""
add("voxel_components", lambda s, d: components.voxel_components(_mask(s, d), _EXT), ["pts"], f"{_CC} SELECT i, x, d, c FROM lab", True)
add("from_mask", lambda s, d: components.from_mask(pts(s, d), 0.5, "mean", 4, _EXT))
add("components_to_surfaces", lambda s, d: components.surfaces_from_mask(_mask(s, d), 4, _EXT), ["pts"], f"{_CC}, s AS (SELECT c, i, x, CAST(round_even(avg(d), 0) AS BIGINT) AS d FROM lab GROUP BY c, i, x) SELECT c, i, x, d FROM s WHERE c IN (SELECT c FROM s GROUP BY c HAVING count(*) >= 4)", True)
add("largest_component", lambda s, d: components.largest(components.voxel_components(_mask(s, d), _EXT)), ["pts"], f"{_CC} SELECT i, x, d, c FROM lab WHERE c = (SELECT c FROM lab GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)", True)
add("pair_differences", lambda s, d: edges(s, d), ["edges"], "SELECT a, b, m FROM edges")
add("suspicious_pairs", lambda s, d: mistie.suspicious(edges(s, d), "m"), ["edges"], "SELECT a, b, m FROM edges WHERE abs(m) > (SELECT avg(abs(m)) + 3 * stddev_pop(abs(m)) FROM edges)")
add("jacobi_step", lambda s, d: mistie.jacobi_step(edges(s, d), None).withColumn("correction", F.round("correction", 6)), ["edges"], "WITH q AS (SELECT a, m FROM edges UNION ALL SELECT b, -m FROM edges) SELECT a AS node, round(0.75 * avg(m), 6) AS correction FROM q GROUP BY a")
add("mistie_solve", lambda s, d: mistie.mistie_solve(edges(s, d)))


def _sticks(s: SparkSession, d: str) -> DataFrame:
    """Each inline as a stick of two nodes, at the mean crossline of all its
    traces and from their least to their greatest depth; thirty inlines a fault."""
    p = pts(s, d).groupBy("i", "x").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    n = p.groupBy("i").agg(F.avg(F.col("x") * 1.0).alias("x"), F.min("lo").cast("double").alias("a"), F.max("hi").cast("double").alias("b"))
    return n.select(F.floor(F.col("i") / 30).cast("string").alias("fault"), F.col("i").alias("stick"), (F.col("i") * 1.0).alias("i"), "x", F.explode(F.array("a", "b")).alias("d"))


add("sticks_to_points", lambda s, d: geometry.sticks_to_points(_sticks(s, d)))
add("windowed_logs", lambda s, d: windowed_logs(table(s, d, "events")), None, None)
ORACLES["windowed_logs"] = "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2"
from . import batch_queries, cube_queries, extra_queries, fault_queries, signal_queries, surface_queries  # noqa: E402, F401 - these modules register their own queries

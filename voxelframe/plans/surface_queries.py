"""Maps and edits of surfaces, merging and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stencil, surface
from ..operators import surface_maps as maps
from .registry import add
from .views import pts, srf, trc, vox

_A = "a AS (SELECT i, x, d FROM srf WHERE s = 'A'), n AS (SELECT i, x, d FROM srf WHERE s = 'N'), r AS (SELECT i, x, d FROM srf WHERE s = 'R')"


def _one(s: SparkSession, d: str, name: str = "A") -> DataFrame:
    return srf(s, d).where(F.col("s") == name).select("i", "x", "d")


def _deep(s: SparkSession, d: str) -> DataFrame:
    """The part of A below 22: with holes and loose parts."""
    return _one(s, d).where("d > 22")


def _all(s: SparkSession, d: str) -> DataFrame:
    return pts(s, d).select("i", "x").distinct()


_BOX = "b AS (SELECT min(i) AS i0, max(i) AS i1, min(x) AS x0, max(x) AS x1 FROM pts)"
add("from_points", lambda s, d: maps.from_points(pts(s, d).withColumn("d", F.col("d") + F.col("p") / 3), (80, 40, 45), ["s"]), ["pts"], "WITH q AS (SELECT s, CAST(round_even(i, 0) AS BIGINT) AS i, CAST(round_even(x, 0) AS BIGINT) AS x, CAST(round_even(d + p / 3, 0) AS BIGINT) AS d FROM pts) SELECT s, i, x, min(d) AS d FROM q WHERE i >= 0 AND i < 80 AND x >= 0 AND x < 40 AND d >= 0 AND d < 45 GROUP BY s, i, x")
add("to_matrix", lambda s, d: maps.to_matrix(srf(s, d), ["s"]).select("s", "k", F.concat_ws(",", F.transform("depths", lambda v: v.cast("string"))).alias("depths")), ["srf"], """
WITH b AS (SELECT s, min(i) AS i0, min(x) AS x0, max(x) AS x1 FROM srf GROUP BY s), g AS (SELECT b.s, k.i, i - i0 AS k, unnest(range(x0, x1 + 1)) AS x FROM b JOIN (SELECT DISTINCT s, i FROM srf) k ON k.s = b.s)
SELECT g.s, g.k, string_agg(CAST(coalesce(d, -999999) AS VARCHAR), ',' ORDER BY g.x) AS depths FROM g LEFT JOIN srf u ON u.s = g.s AND u.i = g.i AND u.x = g.x GROUP BY g.s, g.k""")
add("from_matrix", lambda s, d: maps.from_matrix(maps.to_matrix(_one(s, d), []), 7, 9), ["srf"], f"WITH {_A} SELECT i - (SELECT min(i) FROM a) + 7 AS i, x - (SELECT min(x) FROM a) + 9 AS x, d FROM a")
add("put_on_full", lambda s, d: maps.put_on_full(srf(s, d), _all(s, d), ["s"]), ["srf"], "WITH g AS (SELECT DISTINCT i, x FROM pts), q AS (SELECT DISTINCT s FROM srf) SELECT q.s, g.i, g.x, coalesce(u.d, -999999) AS d FROM g CROSS JOIN q LEFT JOIN srf u ON u.s = q.s AND u.i = g.i AND u.x = g.x")
add("fill_to_number", lambda s, d: maps.transformed(maps.put_on_full(srf(s, d), _all(s, d), ["s"]), lambda t: maps.fill_to_number(t, 0), lambda t: maps.number_to_fill(t, 25)).withColumn("d", F.col("d").cast("long")), ["srf"], "WITH g AS (SELECT DISTINCT i, x FROM pts), q AS (SELECT DISTINCT s FROM srf) SELECT q.s, g.i, g.x, CASE WHEN u.d IS NULL THEN 0 WHEN u.d = 25 THEN -999999 ELSE u.d END AS d FROM g CROSS JOIN q LEFT JOIN srf u ON u.s = q.s AND u.i = g.i AND u.x = g.x")
for mode, e in {"min-max": "(d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w)", "mean-std": "(d - avg(d) OVER w) / stddev_pop(d) OVER w"}.items():
    add(f"map_{mode.replace('-', '_')}", lambda s, d, mode=mode: maps.normalize_map(srf(s, d), ["s"], mode), ["srf"], f"SELECT s, i, x, round({e}, 6) AS d FROM srf WINDOW w AS (PARTITION BY s)")

# --- filters -------------------------------------------------------------------
_OFF = "(SELECT unnest(range(-{m}, {m} + 1)) AS e) CROSS JOIN (SELECT unnest(range(-{m}, {m} + 1)) AS f)"
add("drop_under_margin", lambda s, d: maps.drop_under(_one(s, d), _one(s, d, "R").where("d > 44"), _all(s, d), 2), ["srf"], f"""
WITH {_A}, {_BOX}, k AS (SELECT DISTINCT i + e AS i, x + f AS x FROM r CROSS JOIN {_OFF.format(m=2)} WHERE d > 44 AND abs(e) + abs(f) <= 2)
SELECT i, x, d FROM a, b WHERE i >= i0 + 2 AND i <= i1 - 2 AND x >= x0 + 2 AND x <= x1 - 2 AND NOT EXISTS (SELECT 1 FROM k WHERE k.i = a.i AND k.x = a.x)""")
_PART = """v AS (SELECT i, x, i * 100000 + x AS n, d FROM a WHERE d > 36), e AS (SELECT p.n AS a, q.n AS b FROM v p JOIN v q ON q.i BETWEEN p.i - 1 AND p.i + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND p.n <> q.n),
t(n, c) AS (SELECT n, n FROM v UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.n), lab AS (SELECT n, min(c) AS c FROM t GROUP BY n)"""
add("main_part", lambda s, d: maps.main_part(_one(s, d).where("d > 36")), ["srf"], f"WITH {_A}, {_PART} SELECT i, x, d FROM v JOIN lab USING (n) WHERE c = (SELECT c FROM lab GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)", True)
add("main_part_eroded", lambda s, d: maps.main_part(_one(s, d), 1))
_GRIDSQL = f"""dead AS (SELECT i, x FROM trc WHERE label = 0), b AS (SELECT min(i) AS i0, max(i) AS i1, min(x) AS x0, max(x) AS x1 FROM trc), k AS (SELECT DISTINCT i + e AS i, x + f AS x FROM dead CROSS JOIN {_OFF.format(m=1)}),
g AS (SELECT i, x FROM trc, b WHERE (i % 5 = 0 OR x % 4 = 0) AND i >= i0 + 1 AND i <= i1 - 1 AND x >= x0 + 1 AND x <= x1 - 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.i = trc.i AND k.x = trc.x))"""


def _grid(s: SparkSession, d: str) -> DataFrame:
    return maps.grid_traces(trc(s, d), (5, 4), trc(s, d).where("label = 0"), 1)


add("grid_traces", _grid, ["trc"], f"WITH {_GRIDSQL} SELECT i, x FROM g")
add("make_carcass", lambda s, d: surface.keep_masked(_one(s, d), _grid(s, d)), ["srf", "trc"], f"WITH {_A}, {_GRIDSQL} SELECT i, x, d FROM a WHERE EXISTS (SELECT 1 FROM g WHERE g.i = a.i AND g.x = a.x)")
add("sparse_coverage", lambda s, d: maps.sparse_coverage(_deep(s, d), _grid(s, d)), ["srf", "trc"], f"WITH {_A}, {_GRIDSQL} SELECT count(*) AS grid, count(a.d) AS covered, round(count(a.d) / count(*), 5) AS share FROM g LEFT JOIN a ON a.i = g.i AND a.x = g.x AND a.d > 22")

# --- holes and edges -------------------------------------------------------------
_HOLES = """u AS (SELECT i, x FROM a WHERE d > 22), b AS (SELECT min(i) AS i0, max(i) AS i1, min(x) AS x0, max(x) AS x1 FROM u),
o AS (SELECT i, x, i * 100000 + x AS n FROM (SELECT unnest(range(i0, i1 + 1)) AS i FROM b) CROSS JOIN (SELECT unnest(range(x0, x1 + 1)) AS x FROM b) WHERE (i, x) NOT IN (SELECT (i, x) FROM u)),
e AS (SELECT p.n AS a, q.n AS b FROM o p JOIN o q ON {near} AND p.n <> q.n), t(n, c) AS (SELECT n, n FROM o UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.n), lab AS (SELECT n, min(c) AS c FROM t GROUP BY n),
hole AS (SELECT i, x, c FROM o JOIN lab USING (n) WHERE c NOT IN (SELECT c FROM o JOIN lab USING (n), b WHERE i IN (i0, i1) OR x IN (x0, x1)))"""
_CROSS = "(q.i = p.i AND abs(q.x - p.x) = 1 OR q.x = p.x AND abs(q.i - p.i) = 1)"
_EIGHT = "q.i BETWEEN p.i - 1 AND p.i + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1"
_FULL = "fu AS (SELECT i, x FROM u UNION ALL SELECT i, x FROM hole)"
_EDGE = "ed AS (SELECT p.i, p.x FROM fu p JOIN fu q ON q.i BETWEEN p.i - 1 AND p.i + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.i, p.x HAVING count(*) < 9)"
add("surface_holes", lambda s, d: maps.holes(_deep(s, d)).select("i", "x"), ["srf"], f"WITH {_A}, {_HOLES.format(near=_CROSS)} SELECT i, x FROM hole", True)
add("filled_traces", lambda s, d: maps.filled_traces(_deep(s, d)), ["srf"], f"WITH {_A}, {_HOLES.format(near=_CROSS)}, {_FULL} SELECT i, x FROM fu", True)
add("surface_borders", lambda s, d: maps.borders(_deep(s, d)), ["srf"], f"WITH {_A}, {_HOLES.format(near=_CROSS)}, {_FULL}, {_EDGE} SELECT i, x FROM ed", True)
add("shape_report", lambda s, d: maps.shape_report(_deep(s, d), _all(s, d)))
add("surface_report", lambda s, d: maps.report(_deep(s, d), _all(s, d)), ["srf"], f"WITH {_A} SELECT count(*) AS n, round(count(*) / (SELECT count(*) FROM (SELECT DISTINCT i, x FROM pts)), 5) AS coverage, min(d) AS d_min, max(d) AS d_max, round(avg(d), 6) AS d_mean, round(stddev_pop(d), 6) AS d_std FROM a WHERE d > 22")

# --- gradients, spikes, passes -----------------------------------------------------
_GR = "q AS (SELECT s, i, x, CASE WHEN i - lag(i) OVER w = 1 THEN d - lag(d) OVER w END AS gi, CASE WHEN x - lag(x) OVER v = 1 THEN d - lag(d) OVER v END AS gx FROM srf WINDOW w AS (PARTITION BY s, x ORDER BY i), v AS (PARTITION BY s, i ORDER BY x))"
add("gradient_map", lambda s, d: maps.gradient_map(srf(s, d), "s"), ["srf"], f"WITH {_GR} SELECT s, i, x, CASE WHEN abs(gi) <= 1 THEN 0 ELSE gi END + CASE WHEN abs(gx) <= 1 THEN 0 ELSE gx END AS g FROM q")
add("max_gradient", lambda s, d: maps.max_gradient(srf(s, d), "s"), ["srf"], f"WITH {_GR} SELECT s, i, x, abs(greatest(gi, gx)) AS of_max, greatest(abs(gi), abs(gx)) AS of_abs FROM q")
add("spikes", lambda s, d: maps.spikes(srf(s, d), "s"), ["srf"], """
WITH dir(a, b) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), j AS (SELECT c.s, c.i, c.x, c.d, a, b FROM srf c CROSS JOIN dir JOIN srf n ON n.s = c.s AND n.i = c.i + 3 * a AND n.x = c.x + 3 * b WHERE abs(n.d - c.d) >= 5),
e AS (SELECT j.s, j.i, j.x, a, b, min(k) AS k FROM j CROSS JOIN (SELECT unnest(range(4, 11)) AS k) JOIN srf n ON n.s = j.s AND n.i = j.i + k * a AND n.x = j.x + k * b WHERE abs(n.d - j.d) <= 2 GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT s, i, x, a, b, unnest(range(1, k)) AS o FROM e) SELECT DISTINCT n.s, n.i, n.x, n.d FROM m JOIN srf n ON n.s = m.s AND n.i = m.i + o * a AND n.x = m.x + o * b""")
add("surface_probabilities", lambda s, d: maps.probabilities(_one(s, d), pts(s, d)), ["srf"], f"WITH {_A}, q AS (SELECT i, x, d, round(avg(p), 6) AS p FROM pts GROUP BY i, x, d) SELECT a.i, a.x, a.d, q.p FROM a LEFT JOIN q ON q.i = a.i AND q.x = a.x AND q.d = a.d")
_K = " + ".join(f"CASE WHEN abs(n.i - c.i) = {a} AND abs(n.x - c.x) = {b} THEN {w!r} ELSE 0 END" for a in (0, 1) for b in (0, 1) for w in [float(stencil.gaussian_kernel()[1 + a, 1 + b])])
_PASS = "SELECT c.s, c.i, c.x, sum(({k}) * n.d) / sum({k}) AS d FROM {t} c JOIN {t} n ON n.s = c.s AND n.i BETWEEN c.i - 1 AND c.i + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 AND abs(n.d - c.d) <= 5 GROUP BY c.s, c.i, c.x"
add("smooth_out", lambda s, d: maps.smooth_out(srf(s, d), "s", 2, whole=False), ["srf"], f"WITH p1 AS ({_PASS.format(k=_K, t='srf')}), p2 AS ({_PASS.format(k=_K, t='p1')}) SELECT s, i, x, round(d, 6) AS d FROM p2")
add("smooth_out_whole", lambda s, d: maps.smooth_out(srf(s, d), "s", 1), ["srf"], f"WITH p1 AS ({_PASS.format(k=_K, t='srf')}) SELECT s, i, x, CAST(round_even(round(d, 6), 0) AS BIGINT) AS d FROM p1")
_FILL = "SELECT s, i, x, sum(k * d) / sum(k) AS d FROM (SELECT s, CAST(i + a AS BIGINT) AS i, CAST(x + b AS BIGINT) AS x, d, a, b, (2 - abs(a)) * (2 - abs(b)) AS k FROM {t} CROSS JOIN (SELECT unnest(range(-1, 2)) AS a) CROSS JOIN (SELECT unnest(range(-1, 2)) AS b)) GROUP BY s, i, x HAVING count(*) FILTER (a = 0 AND b = 0) = 0 AND count(*) >= 4"
add("interpolate_passes", lambda s, d: surface.interpolate(srf(s, d), "s", [[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]], 4, None, 2), ["srf"], f"WITH p1 AS (SELECT s, i, x, CAST(d AS DOUBLE) AS d FROM srf UNION ALL {_FILL.format(t='srf')}), p2 AS (SELECT s, i, x, d FROM p1 UNION ALL {_FILL.format(t='p1')}) SELECT s, i, x, round(d, 6) AS d FROM p2")
add("enlarge_carcass", lambda s, d: maps.enlarge(surface.on_grid(srf(s, d), (10, 7)), "s"), ["srf"], """
WITH g AS (SELECT s, i, x, d FROM srf WHERE i % 10 = 0 OR x % 7 = 0), p AS (SELECT s, CAST(i + k AS BIGINT) AS i, x, max(d) AS p FROM g CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) GROUP BY 1, 2, 3), q AS (SELECT s, i, CAST(x + k AS BIGINT) AS x, max(d) AS q FROM g CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) GROUP BY 1, 2, 3)
SELECT s, i, x, CAST(coalesce(g.d, (p + q) / 2, p, q) AS DOUBLE) AS d FROM p FULL JOIN q USING (s, i, x) LEFT JOIN g USING (s, i, x)""")
add("inpaint", lambda s, d: maps.inpaint(srf(s, d).where("d > 10"), "s"))
add("surfaces_equal", lambda s, d: maps.equal(_one(s, d), _one(s, d, "N"), 5), ["srf"], f"WITH {_A}, j AS (SELECT a.d AS p, n.d AS q FROM a FULL JOIN n ON a.i = n.i AND a.x = n.x) SELECT count(*) FILTER (p IS NULL OR q IS NULL) AS alone, round(avg(abs(p - q)), 6) AS gap, count(*) FILTER (p IS NULL OR q IS NULL) <= 5 AND coalesce(avg(abs(p - q)), 0) = 0 AS equal FROM j")


def _window(s: SparkSession, d: str) -> DataFrame:
    from ..operators import volume

    return volume.along_surface(vox(s, d), _peaks(s, d), 5, 0).where("amp is not null")


def _peaks(s: SparkSession, d: str) -> DataFrame:
    return vox(s, d).where("d between 8 and 40").groupBy("i", "x").agg(F.max_by("d", "amp").alias("d"))


add("float_correction", lambda s, d: maps.float_correction(_window(s, d), _peaks(s, d).select("i", "x", (F.col("d") + (F.col("i") % 5 - 2) / 7).alias("f"))), ["vox"], """
WITH u AS (SELECT i, x, arg_max(d, amp) AS d FROM vox WHERE d BETWEEN 8 AND 40 GROUP BY i, x), w AS (SELECT u.i, u.x, CAST(k AS BIGINT) AS w, round(v.amp, 6) AS amp, (u.i % 5 - 2) / CAST(7 AS DOUBLE) AS t FROM u CROSS JOIN (SELECT unnest(range(0, 5)) AS k) JOIN vox v ON v.i = u.i AND v.x = u.x AND v.d = u.d - 2 + k)
SELECT i, x, w, round(amp * (1 - abs(t)) + coalesce(CASE WHEN t > 0 THEN lead(amp) OVER o ELSE lag(amp) OVER o END, amp) * abs(t), 6) AS amp FROM w WINDOW o AS (PARTITION BY i, x ORDER BY w)""")
add("thin_line", lambda s, d: maps.thin_line(pts(s, d).select("s", "i", "x", "d").distinct(), ["s"], "i", ["d", "x"]), ["pts"], "SELECT s, i, x, d FROM (SELECT DISTINCT s, i, x, d FROM pts) QUALIFY row_number() OVER (PARTITION BY s, i ORDER BY d, x) = 1")
add("dilate_points", lambda s, d: maps.dilate_points(pts(s, d).select("i", "x", "d"), "d", 3, 0, 49), ["pts"], "SELECT DISTINCT i, x, CAST(d + k AS BIGINT) AS d FROM pts CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k) WHERE d + k BETWEEN 0 AND 49")
add("contour", lambda s, d: maps.contour(pts(s, d).where("p > 0.95"), "s", "x"), ["pts"], "WITH q AS (SELECT DISTINCT s, i, d FROM pts WHERE p > 0.95) SELECT c.s, c.i AS u, c.d AS v FROM q c JOIN q n ON n.s = c.s AND n.i BETWEEN c.i - 1 AND c.i + 1 AND n.d BETWEEN c.d - 1 AND c.d + 1 GROUP BY c.s, c.i, c.d HAVING count(*) < 9")
add("longest_run", lambda s, d: maps.longest_run(pts(s, d).where("p > 0.95").withColumn("k", F.col("i") * 50 + F.col("x")), "s", "d", 1), ["pts"], """
WITH u AS (SELECT DISTINCT s, d FROM pts WHERE p > 0.95), g AS (SELECT s, d, CASE WHEN d - lag(d) OVER (PARTITION BY s ORDER BY d) > 1 THEN 1 ELSE 0 END AS j FROM u), k AS (SELECT s, d, sum(j) OVER (PARTITION BY s ORDER BY d) AS k FROM g),
r AS (SELECT s, k, min(d) AS lo, max(d) AS hi, count(*) AS n FROM k GROUP BY s, k) SELECT s, lo, hi, n FROM r QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, lo) = 1""")

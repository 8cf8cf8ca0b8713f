"""Faults and merging of surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import faults, merging
from .registry import add
from .views import pts, srf


def _faults(s: SparkSession, d: str) -> DataFrame:
    """Sure points by slabs of crossline and depth."""
    return pts(s, d).where("p > 0.95").select((F.floor(F.col("x") / 5) * 10 + F.floor(F.col("d") / 10)).cast("long").alias("fault"), "i", "x", "d").distinct()


_F = "f AS (SELECT DISTINCT x // 5 * 10 + d // 10 AS fault, i, x, d FROM pts WHERE p > 0.95), bx AS (SELECT fault, count(*) AS n, min(i) AS i0, max(i) AS i1, min(x) AS x0, max(x) AS x1, min(d) AS d0, max(d) AS d1 FROM f GROUP BY fault)"
add("fault_boxes", lambda s, d: faults.boxes(_faults(s, d)), ["pts"], f"WITH {_F} SELECT * FROM bx")
_OV = {c: f"least(a.{c}1, b.{c}1) - greatest(a.{c}0, b.{c}0) + 1" for c in "ixd"}
_NEAR = " AND ".join(f"{o} >= 1 - {{g}}" for o in _OV.values())
add("box_relations", lambda s, d: faults.box_pairs(faults.boxes(_faults(s, d)), "fault", 2).select(F.col("a.fault").alias("a_name"), F.col("b.fault").alias("b_name"), F.col("a"), F.col("b")).select("a_name", "b_name", faults.intersected().alias("meet"), faults.adjacent(gap=1).alias("touch"), faults.embedded(margin=5).alias("inside")), ["pts"], f"""
WITH {_F} SELECT a.fault AS a_name, b.fault AS b_name, {' AND '.join(f'{o} >= 1' for o in _OV.values())} AS meet, {_NEAR.format(g=1)} AS touch, {' AND '.join(f'a.{c}0 >= b.{c}0 - 5 AND a.{c}1 <= b.{c}1 + 5' for c in 'ixd')} AS inside FROM bx a JOIN bx b ON a.fault < b.fault AND {_NEAR.format(g=2)}""")
add("fault_size_filter", lambda s, d: faults.size_filter(_faults(s, d), length=7, height=8, n=40), ["pts"], f"WITH {_F} SELECT f.fault, i, x, d FROM f JOIN bx USING (fault) WHERE n >= 40 AND d1 - d0 >= 8 AND sqrt((i1 - i0) * (i1 - i0) + (x1 - x0) * (x1 - x0)) >= 7")
_ZONE = f"""z AS (SELECT a.fault AS a, b.fault AS b, {', '.join(f'greatest(a.{c}0, b.{c}0) - 1 AS {c}0, least(a.{c}1, b.{c}1) + 1 AS {c}1' for c in 'ixd')} FROM bx a JOIN bx b ON a.fault < b.fault AND {_NEAR.format(g=1)}),
np AS (SELECT a, b FROM z WHERE {' AND '.join(f'(SELECT count(*) FROM f WHERE f.fault = z.{k} AND i BETWEEN i0 AND i1 AND x BETWEEN x0 AND x1 AND d BETWEEN d0 AND d1) >= 8' for k in 'ab')})"""
add("fault_neighbours", lambda s, d: faults.near_pairs(_faults(s, d), gap=1, least=8), ["pts"], f"WITH {_F}, {_ZONE} SELECT a, b FROM np")
add("without_lone_faults", lambda s, d: faults.without_lone(_faults(s, d), height=20, width=200, gap=1, least=8), ["pts"], f"WITH {_F}, {_ZONE} SELECT fault, i, x, d FROM f WHERE fault IN (SELECT a FROM np UNION SELECT b FROM np UNION SELECT fault FROM bx WHERE d1 - d0 >= 20 OR greatest(i1 - i0, x1 - x0) >= 200)")
_GROUP = "e AS (SELECT a, b FROM np UNION SELECT b, a FROM np), r(n, c) AS (SELECT fault, fault FROM bx UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), gr AS (SELECT n AS fault, min(c) AS grp FROM r GROUP BY n)"
add("fault_groups", lambda s, d: faults.groups(_faults(s, d), gap=1, least=8), ["pts"], f"WITH {_F}, {_ZONE}, {_GROUP} SELECT fault, grp AS group FROM gr".replace("AS group", 'AS "group"'), True)
add("biggest_fault_groups", lambda s, d: faults.biggest_groups(_faults(s, d), top=3, gap=1, least=8), ["pts"], f"""
WITH {_F}, {_ZONE}, {_GROUP}, h AS (SELECT grp, max(d) - min(d) AS height FROM f JOIN gr USING (fault) GROUP BY grp), k AS (SELECT *, row_number() OVER (ORDER BY height DESC, grp) AS rank FROM h) SELECT fault, grp AS "group", height, rank FROM gr JOIN k USING (grp) WHERE rank <= 3""", True)
add("fault_direction", lambda s, d: faults.direction(_faults(s, d)), ["pts"], f"WITH {_F}, m AS (SELECT fault, quantile_disc(d, 0.5) AS m FROM f GROUP BY fault) SELECT fault, CAST(CASE WHEN max(i) - min(i) >= max(x) - min(x) THEN 0 ELSE 1 END AS BIGINT) AS axis FROM f JOIN m USING (fault) WHERE d = m GROUP BY fault")
_STICK = """mm AS (SELECT fault, i, d, avg(x) AS x FROM f GROUP BY fault, i, d), ww AS (SELECT *, min(i) OVER (PARTITION BY fault) AS a, min(d) OVER s AS d0, max(d) OVER s AS d1, count(*) OVER s AS n FROM mm WINDOW s AS (PARTITION BY fault, i)),
st AS (SELECT fault, i AS stick, CAST(i AS DOUBLE) AS i, round(x, 6) AS x, d FROM ww WHERE (i - a) % 3 = 0 AND n >= 3 AND ((d - d0) % 4 = 0 OR d = d1))"""


def _sticks(s: SparkSession, d: str) -> DataFrame:
    return faults.points_to_sticks(_faults(s, d), step=3, nodes=4, least=3)


add("points_to_sticks", _sticks, ["pts"], f"WITH {_F}, {_STICK} SELECT fault, stick, i, x, d FROM st")
add("stick_report", lambda s, d: faults.stick_faults(_sticks(s, d)), ["pts"], f"WITH {_F}, {_STICK}, q AS (SELECT fault, stick, count(*) AS n, count(DISTINCT d) AS u FROM st GROUP BY 1, 2) SELECT fault, count(*) AS sticks, count(*) FILTER (n = 1) AS one_node, count(*) FILTER (u < n) AS level FROM q GROUP BY fault")
add("nodes_on_lines", lambda s, d: faults.nodes_on_lines(_sticks(s, d)), ["pts"], f"WITH {_F}, {_STICK}, k AS (SELECT fault, stick, lead(stick) OVER (PARTITION BY fault ORDER BY stick) AS nx FROM (SELECT DISTINCT fault, stick FROM st)) SELECT fault, stick, unnest(range(stick, coalesce(nx, stick + 1))) AS line, x, d FROM st JOIN k USING (fault, stick)")
add("fault_contact", lambda s, d: faults.contact(_faults(s, d)), ["pts"], f"WITH {_F} SELECT a.fault AS a, b.fault AS b, count(*) AS n FROM f a JOIN f b ON b.i = a.i AND b.x = a.x AND b.d = a.d + 1 AND a.fault <> b.fault GROUP BY 1, 2")
_CON = "q AS (SELECT DISTINCT fault, i, d FROM f), c AS (SELECT p.fault, p.i AS u, p.d AS v FROM q p JOIN q n ON n.fault = p.fault AND n.i BETWEEN p.i - 1 AND p.i + 1 AND n.d BETWEEN p.d - 1 AND p.d + 1 GROUP BY 1, 2, 3 HAVING count(*) < 9)"
_OVER = f"{_CON}, o AS (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT a.fault AS a, b.fault AS b, a.u, a.v FROM c a JOIN c b ON b.v = a.v AND b.u BETWEEN a.u - 1 AND a.u + 1 AND a.fault < b.fault) GROUP BY a, b), z AS (SELECT fault, count(*) AS z FROM c GROUP BY fault), ov AS (SELECT o.a, o.b, n, round(n / least(p.z, q.z), 6) AS share FROM o JOIN z p ON p.fault = o.a JOIN z q ON q.fault = o.b)"
add("contour_overlap", lambda s, d: faults.contour_overlap(_faults(s, d)), ["pts"], f"WITH {_F}, {_OVER} SELECT a, b, n, share FROM ov")
add("connected_contours", lambda s, d: faults.connected_groups(faults.contour_overlap(_faults(s, d)), 0.75), ["pts"], f"WITH {_F}, {_OVER}, e AS (SELECT a, b FROM ov WHERE share > 0.75 UNION SELECT b, a FROM ov WHERE share > 0.75), r(n, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n) SELECT n, min(c) AS c FROM r GROUP BY n", True)
add("split_faults", lambda s, d: faults.split_at(_faults(s, d).where("d % 10 = d % 7"), "fault", "i", [4, 30, 70]), ["pts"], f"""
WITH {_F}, p AS (SELECT *, CAST(i >= 4 AS INT) + CAST(i >= 30 AS INT) + CAST(i >= 70 AS INT) AS p FROM f WHERE d % 10 = d % 7), u AS (SELECT fault, p, x, CASE WHEN x - lag(x) OVER w > 1 THEN 1 ELSE 0 END AS j FROM (SELECT DISTINCT fault, p, x FROM p) WINDOW w AS (PARTITION BY fault, p ORDER BY x)),
g AS (SELECT fault, p, x, sum(j) OVER (PARTITION BY fault, p ORDER BY x) AS g FROM u) SELECT fault, p || '-' || g AS part, i, x, d FROM p JOIN g USING (fault, p, x)""")
add("horseshoe_cuts", lambda s, d: faults.horseshoe_cuts(pts(s, d).where("p > 0.98").select(F.col("x").alias("fault"), "i", "d"), "fault", 0.7, 5), ["pts"], "WITH h AS (SELECT x AS fault, i, max(d) - min(d) + 1 AS h FROM pts WHERE p > 0.98 GROUP BY x, i), k AS (SELECT *, lag(h) OVER w AS a, lead(h) OVER w AS b FROM h WINDOW w AS (PARTITION BY fault ORDER BY i)) SELECT fault, i FROM k WHERE h <= 0.7 * a AND h <= 0.7 * b AND a - h > 5 AND b - h > 5")
add("restore_projection", lambda s, d: faults.restore(_faults(s, d).select("i", "d").where("d > 20").distinct(), _faults(s, d)), ["pts"], f"WITH {_F} SELECT i, min(x) AS x, d FROM f WHERE d > 20 GROUP BY i, d")
add("skeleton_depths", lambda s, d: faults.skeleton_depths(_faults(s, d)), ["pts"], f"WITH {_F} SELECT fault, i, d, quantile_disc(x, 0.5) AS x FROM f GROUP BY fault, i, d")
_SLICE = "v AS (SELECT DISTINCT i, x, d, (i * 2000 + x) * 2000 + d AS n FROM pts WHERE p >= 0.9999), e AS (SELECT p.n AS a, q.n AS b FROM v p JOIN v q ON q.i = p.i AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.d BETWEEN p.d - 1 AND p.d + 1 AND p.n <> q.n), r(n, c) AS (SELECT n, n FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), lab AS (SELECT n, min(c) AS c FROM r GROUP BY n), sl AS (SELECT i, x, d, c FROM v JOIN lab USING (n))"


def _thin(s: SparkSession, d: str) -> DataFrame:
    return pts(s, d).where("p >= 0.9999").select("i", "x", "d")


def _sized(parts: DataFrame) -> DataFrame:
    """Parts by place and size: their names differ between Spark and SQL."""
    return parts.groupBy("c").agg(F.min("i").alias("i0"), F.min("x").alias("x0"), F.min("d").alias("d0"), F.count("*").alias("n")).drop("c")


add("slide_components", lambda s, d: _sized(faults.slide_components(_thin(s, d))), ["pts"], f"WITH {_SLICE} SELECT min(i) AS i0, min(x) AS x0, min(d) AS d0, count(*) AS n FROM sl GROUP BY c", True)
add("slide_links", lambda s, d: faults.slide_links(faults.slide_components(_thin(s, d))).groupBy("contact").agg(F.count("*").alias("n")), ["pts"], f"WITH {_SLICE}, k AS (SELECT p.c AS a, q.c AS b, count(DISTINCT (p.x, p.d)) AS contact FROM sl p JOIN sl q ON q.i = p.i + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.d BETWEEN p.d - 1 AND p.d + 1 GROUP BY 1, 2) SELECT contact, count(*) AS n FROM k GROUP BY contact", True)
add("line_lengths", lambda s, d: merging.line_lengths(faults.slide_components(_thin(s, d))).select("length", F.col("rank")), ["pts"], f"WITH {_SLICE}, n AS (SELECT c, count(DISTINCT x) AS length FROM sl GROUP BY c) SELECT length, row_number() OVER (ORDER BY length DESC, c) AS rank FROM n", True)
add("line_prototypes", lambda s, d: merging.line_prototypes(faults.slide_components(_thin(s, d), "i").withColumn("c", F.col("c") * 2), faults.slide_components(_thin(s, d), "x").withColumn("c", F.col("c") * 2 + 1)))
add("extract_faults", lambda s, d: faults.extract(pts(s, d).where("p >= 0.97"), "i", 2, 2, 4))

# --- merging --------------------------------------------------------------------------------
_PARTS = "CASE WHEN x < 12 THEN 'a' WHEN x < 25 THEN 'b' WHEN x < 31 THEN 'c' ELSE 'd' END || s"


def _parts(s: SparkSession, d: str) -> DataFrame:
    """The surfaces cut into strips along x, overlapping by two traces, smoothed by halving depths."""
    u = srf(s, d)
    t = u.select(F.expr(_PARTS).alias("s"), "i", "x", F.floor(F.col("d") / 16).cast("long").alias("d"))
    more = u.where("x in (12, 13, 25, 26)").select(F.expr("case when x < 20 then 'a' else 'b' end || s").alias("s"), "i", "x", F.floor(F.col("d") / 16).cast("long").alias("d"))
    return t.union(more)


_PSQL = f"pa AS (SELECT {_PARTS} AS s, i, x, d // 16 AS d FROM srf UNION ALL SELECT CASE WHEN x < 20 THEN 'a' ELSE 'b' END || s, i, x, d // 16 FROM srf WHERE x IN (12, 13, 25, 26)), bo AS (SELECT s, min(i) AS i0, max(i) AS i1, min(x) AS x0, max(x) AS x1 FROM pa GROUP BY s)"
add("merge_compare", lambda s, d: merging.compared(_parts(s, d), 0.8, 2, 1, 40), ["srf"], f"""
WITH {_PSQL}, m AS (SELECT p.s AS a, q.s AS b, count(*) AS n, avg(abs(p.d - q.d)) AS m, max(abs(p.d - q.d)) AS w FROM pa p JOIN pa q ON q.i = p.i AND q.x = p.x AND p.s < q.s GROUP BY 1, 2)
SELECT p.s AS a, q.s AS b, coalesce(n, 0) AS overlap, round(m, 6) AS gap_mean, CAST(CASE WHEN n IS NULL THEN 3 WHEN w > 2 OR m > 0.8 THEN 0 WHEN n < 40 THEN 1 ELSE 4 END AS BIGINT) AS status
FROM bo p JOIN bo q ON p.s < q.s AND least(p.i1, q.i1) - greatest(p.i0, q.i0) + 1 >= 0 AND least(p.x1, q.x1) - greatest(p.x0, q.x0) + 1 >= 0 LEFT JOIN m ON m.a = p.s AND m.b = q.s""")
add("adjacent_links", lambda s, d: merging.adjacent_links(_parts(s, d), 0.9, 2), ["srf"], f"""
WITH {_PSQL}, e AS (SELECT s AS b, CAST(i + p AS BIGINT) AS i, CAST(x + q AS BIGINT) AS x, max(d) AS o FROM pa CROSS JOIN (SELECT unnest(range(-2, 3)) AS p) CROSS JOIN (SELECT unnest(range(-2, 3)) AS q) GROUP BY 1, 2, 3)
SELECT DISTINCT least(s, b) AS a, greatest(s, b) AS b FROM (SELECT s, b FROM pa JOIN e ON e.i = pa.i AND e.x = pa.x AND s <> b GROUP BY s, b HAVING avg(abs(d - o)) < 0.9)""")
add("merge_into", lambda s, d: merging.merge_into(_parts(s, d).where("s = 'aA'").select("i", "x", "d"), _parts(s, d).where("s <> 'aA'"), 1.0, 3, 1, 5))
add("merge_list", lambda s, d: merging.merge_list(_parts(s, d), 0.8, 2.2, 1, 5))
add("extract_from_mask", lambda s, d: merging.extract_from_mask(pts(s, d).where("p >= 0.98").select("i", "x", "d"), 3))

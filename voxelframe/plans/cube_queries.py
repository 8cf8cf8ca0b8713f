"""Cubes: SEG-Y files written from the traces and read back, access, headers, coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cube, volume
from ..operators.cube import Cube
from ..session import new_folder
from ..sources import segy
from .registry import add
from .views import pts, trc, vox

_FILES: dict[tuple[str, str, str], str] = {}


def _cube(s: SparkSession, d: str) -> Cube:
    """The traces with lines 100, 102, ... and 300, 303, ..., delay 8 ms, interval 2 ms."""
    c = Cube.of(trc(s, d), i_shift=100, i_step=2, x_shift=300, x_step=3, delay=8.0, interval=2.0)
    i, x = F.col("i"), F.col("x")
    return Cube(c.traces.withColumns({"cdp_x": (100_000 + 25 * i + 5 * x).cast("int"), "cdp_y": (300_000 - 5 * i + 25 * x).cast("int")}), c.meta)


def _written(s: SparkSession, d: str, kind: str, write) -> str:
    """The folder that ``write`` fills, once a session and table."""
    key = s.sparkContext.applicationId, d, kind
    if key not in _FILES:
        _FILES[key] = new_folder(s, kind)
        write(_FILES[key])
    return _FILES[key]


def _segy(s: SparkSession, d: str) -> str:
    return _written(s, d, "segy", lambda p: _cube(s, d).export_segy(p))


def _open(s: SparkSession, d: str) -> Cube:
    return Cube.new(s, _segy(s, d))


def _total(t: DataFrame, *keys: str) -> DataFrame:
    """Traces by their number of samples and weighted sum."""
    weighted = F.aggregate(F.transform("samples", lambda v, k: v.cast("double") * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return t.select(*(F.col(k).cast("long").alias(k) for k in keys), F.size("samples").cast("long").alias("n"), F.round(weighted, 5).alias("total"))


_LINES = "100 + 2 * i AS inline, 300 + 3 * x AS crossline"
_CDP = "100000 + 25 * i + 5 * x AS cdp_x, 300000 - 5 * i + 25 * x AS cdp_y"
_W = "CAST(len(samples) AS BIGINT) AS n, round(coalesce(list_sum(list_transform(samples, lambda v, k: v * k)), 0), 5) AS total"
_PART = "samples[{a}:{b}]"


def _cut(a: int, b: int) -> str:
    return f"SELECT i, x, samples[{a + 1}:{b}] AS samples FROM trc"


add("segy_traces", lambda s, d: _total(segy.read_segy(s, _segy(s, d)), "inline", "crossline"), ["trc"], f"SELECT {_LINES}, {_W} FROM trc")
add("segy_headers", lambda s, d: segy.read_segy(s, _segy(s, d), samples=False, chunk=100).select(*(F.col(c).cast("long").alias(c) for c in segy.HEADERS)), ["trc"], f"""
SELECT {_LINES}, {_CDP}, CAST(8 AS BIGINT) AS delay, row_number() OVER (PARTITION BY (100 + 2 * i) // 20 ORDER BY i, x) AS trace_id FROM trc""")
add("segy_header", lambda s, d: segy.read_segy(s, _segy(s, d), ("cdp_x",), samples=False).groupBy(F.col("cdp_x").cast("long").alias("cdp_x")).agg(F.count("*").alias("n")), ["trc"], f"WITH h AS (SELECT {_CDP} FROM trc) SELECT cdp_x, count(*) AS n FROM h GROUP BY cdp_x")
add("segy_quantized", lambda s, d: _total(segy.read_segy(s, _written(s, d, "qsegy", lambda p: _cube(s, d).repack(p, volume.quantization(vox(s, d))))), "inline", "crossline"), ["vox"], f"""
WITH r AS (SELECT least(abs(quantile_cont(amp, 0.99)), abs(quantile_cont(amp, 0.01))) AS r FROM vox), q AS (SELECT i, x, list(round_even(least(greatest(amp, -r), r) / r * 127, 0) ORDER BY d) AS samples FROM vox, r GROUP BY i, x)
SELECT {_LINES}, {_W} FROM q""")
add("cube_meta", lambda s, d: s.createDataFrame([tuple(_open(s, d).meta.__dict__[k] for k in ("i_shift", "i_step", "i_length", "x_shift", "x_step", "x_length", "depth", "delay", "interval"))], "i_shift long, i_step long, i_length long, x_shift long, x_step long, x_length long, depth long, delay double, `interval` double"), ["trc"], """
SELECT min(100 + 2 * i) AS i_shift, CAST(2 AS BIGINT) AS i_step, max(i) - min(i) + 1 AS i_length, min(300 + 3 * x) AS x_shift, CAST(3 AS BIGINT) AS x_step, max(x) - min(x) + 1 AS x_length, CAST(max(len(samples)) AS BIGINT) AS depth, CAST(8 AS DOUBLE) AS delay, CAST(2 AS DOUBLE) AS interval FROM trc""")
add("load_traces", lambda s, d: _total(_open(s, d).load_traces(segy.read_segy(s, _segy(s, d), ("trace_id", "delay"), samples=False), (5, 25)), "i", "x"), ["trc"], f"WITH c AS ({_cut(5, 25)}) SELECT i, x, {_W} FROM c")
add("load_by_places", lambda s, d: _total(_open(s, d).load_by_places(pts(s, d).select("i", "x").distinct()), "i", "x"), ["pts", "trc"], f"""
WITH n AS (SELECT max(len(samples)) AS n FROM trc), p AS (SELECT DISTINCT i, x FROM pts), c AS (SELECT p.i, p.x, coalesce(samples, list_resize(CAST([] AS DOUBLE[]), n.n, CAST(0 AS DOUBLE))) AS samples FROM p CROSS JOIN n LEFT JOIN trc t ON t.i = p.i AND t.x = p.x) SELECT i, x, {_W} FROM c""")
add("load_slide_i", lambda s, d: _total(_open(s, d).load_slide(3, 0, (10, 40)), "i", "x"), ["trc"], f"WITH c AS ({_cut(10, 40)}) SELECT i, x, {_W} FROM c WHERE i = 3")
add("load_slide_x", lambda s, d: _total(_open(s, d).load_slide("#306", 1), "i", "x"), ["trc"], f"SELECT i, x, {_W} FROM trc WHERE x = 2")
add("load_slide_d", lambda s, d: _open(s, d).load_slide(17, 2).select("i", "x", F.round(F.col("amp").cast("double"), 6).alias("amp")), ["trc"], "SELECT i, x, round(samples[18], 6) AS amp FROM trc")
add("cube_item", lambda s, d: _total(_open(s, d)[2:9, -10:, 5:1000], "i", "x"), ["trc"], f"WITH m AS (SELECT max(x) AS m FROM trc), c AS (SELECT i, x, samples[6:] AS samples FROM trc, m WHERE i >= 2 AND i < 9 AND x > m - 10) SELECT i, x, {_W} FROM c")
add("load_depth_slices", lambda s, d: _open(s, d).load_depth_slices([0, 10, 63]).select("i", "x", "d", F.round("amp", 6).alias("amp")), ["trc"], """
WITH gi AS (SELECT unnest(range(0, max(i) + 1)) AS i FROM trc), gx AS (SELECT unnest(range(0, max(x) + 1)) AS x FROM trc), gd AS (SELECT CAST(unnest([0, 10, 63]) AS BIGINT) AS d)
SELECT gi.i, gx.x, gd.d, round(coalesce(samples[gd.d + 1], CAST(0 AS DOUBLE)), 6) AS amp FROM gi CROSS JOIN gx CROSS JOIN gd LEFT JOIN trc t ON t.i = gi.i AND t.x = gx.x""")
add("load_subset", lambda s, d: _total(_open(s, d).load_subset(100, 42), "i", "x"), ["trc"], f"SELECT i, x, {_W} FROM (SELECT * FROM trc WHERE list_min(samples) < list_max(samples) ORDER BY md5('42,' || i || ',' || x), i, x LIMIT 100)")
add("header_matrix", lambda s, d: _open(s, d).header_matrix("cdp_y"), ["trc"], f"""
WITH gi AS (SELECT unnest(range(0, max(i) + 1)) AS i FROM trc), gx AS (SELECT unnest(range(0, max(x) + 1)) AS x FROM trc), h AS (SELECT i, x, {_CDP} FROM trc)
SELECT gi.i, gx.x, coalesce(cdp_y, CAST(-1 AS BIGINT)) AS value FROM gi CROSS JOIN gx LEFT JOIN h ON h.i = gi.i AND h.x = gx.x""")
add("trace_chunks", lambda s, d: _open(s, d).chunks(64).groupBy("chunk").agg(F.count("*").alias("n")), ["trc"], "WITH n AS (SELECT row_number() OVER (PARTITION BY (100 + 2 * i) // 20 ORDER BY i, x) AS k FROM trc) SELECT CAST((k - 1) // 64 AS BIGINT) AS chunk, count(*) AS n FROM n GROUP BY 1")
_NODES = [(1.0, 2.0), (9.0, 17.5), (15.0, 3.0)]
add("section", lambda s, d: _open(s, d).section(_NODES).select("k", "d", F.round("amp", 5).alias("amp")), ["vox"], """
WITH legs(a, b, c, e, k0, n) AS (SELECT CAST(1 AS DOUBLE), CAST(2 AS DOUBLE), CAST(9 AS DOUBLE), CAST(17.5 AS DOUBLE), 0, 18 UNION ALL SELECT 9, 17.5, 15, 3, 18, 16),
p AS (SELECT k0 + k AS k, a + (c - a) * k / n AS pi, b + (e - b) * k / n AS px FROM (SELECT *, unnest(range(0, n)) AS k FROM legs) UNION ALL SELECT 34, 15, 3),
c AS (SELECT DISTINCT k, pi, px, CAST(i AS BIGINT) AS i, CAST(x AS BIGINT) AS x FROM (SELECT k, pi, px, unnest([floor(pi), ceil(pi)]) AS i FROM p) JOIN (SELECT k, unnest([floor(px), ceil(px)]) AS x FROM p) USING (k)),
w AS (SELECT k, i, x, 1 / greatest(sqrt((i - pi) * (i - pi) + (x - px) * (x - px)), 1e-9) AS w FROM c)
SELECT CAST(k AS BIGINT) AS k, v.d, round(sum(w * amp) / sum(w), 5) AS amp FROM w JOIN vox v ON v.i = w.i AND v.x = w.x GROUP BY k, v.d""")
add("index_attributes", lambda s, d: cube.index_attributes(segy.read_segy(s, _segy(s, d), samples=False)), ["trc"], " UNION ALL ".join(f"""
SELECT '{h}' AS header, min(v) AS shift, max(v) AS last, count(*) AS uniques, coalesce(min(g), 1) AS step, coalesce(min(g) = max(g), true) AS regular FROM (SELECT v, v - lag(v) OVER (ORDER BY v) AS g FROM (SELECT DISTINCT {e} AS v FROM trc))""" for h, e in (("inline", "100 + 2 * i"), ("crossline", "300 + 3 * x"))))
add("ordinals_to_lines", lambda s, d: trc(s, d).select("i", "x", cube.line("i", 100, 2).alias("inline"), cube.line("x", 300, 3).alias("crossline")), ["trc"], f"SELECT i, x, {_LINES} FROM trc")
add("lines_to_grid", lambda s, d: segy.read_segy(s, _segy(s, d), samples=False).select("inline", "crossline", cube.ordinal("inline", 100, 2).alias("i"), cube.ordinal("crossline", 300, 3).alias("x")).select(*(F.col(c).cast("long").alias(c) for c in ("inline", "crossline", "i", "x"))), ["trc"], f"SELECT {_LINES}, i, x FROM trc")
add("time_of_samples", lambda s, d: _hz(s, d).select("i", "x", cube.sample_to_time("d", 8.0, 2.0).alias("ms"), cube.time_to_sample("d", 8.0, 2.0).alias("sample")), ["srf"], "SELECT i, x, CAST(d * 2 + 8 AS DOUBLE) AS ms, CAST((d - 8) / 2 AS DOUBLE) AS sample FROM srf WHERE s = 'A'")


def _hz(s: SparkSession, d: str) -> DataFrame:
    from .views import srf

    return srf(s, d).where("s = 'A'")


def _heads(s: SparkSession, d: str) -> DataFrame:
    return segy.read_segy(s, _segy(s, d), samples=False)


_FIT = """m AS (SELECT var_pop(inline) AS uu, var_pop(crossline) AS vv, covar_pop(inline, crossline) AS uv, avg(inline) AS u, avg(crossline) AS v, covar_pop(inline, cdp_x) AS u0, covar_pop(crossline, cdp_x) AS v0, covar_pop(inline, cdp_y) AS u1, covar_pop(crossline, cdp_y) AS v1, avg(cdp_x) AS t0, avg(cdp_y) AS t1 FROM h),
f AS (SELECT (u0 * vv - v0 * uv) / (uu * vv - uv * uv) AS a0, (v0 * uu - u0 * uv) / (uu * vv - uv * uv) AS a1, (u1 * vv - v1 * uv) / (uu * vv - uv * uv) AS b0, (v1 * uu - u1 * uv) / (uu * vv - uv * uv) AS b1, u, v, t0, t1 FROM m)"""
add("rotation_fit", lambda s, d: cube.affine_fit(_heads(s, d)).select(*(F.round(c, 4).alias(c) for c in ("a0", "a1", "a2", "b0", "b1", "b2"))), ["trc"], f"WITH h AS (SELECT {_LINES}, {_CDP} FROM trc), {_FIT} SELECT round(a0, 4) AS a0, round(a1, 4) AS a1, round(t0 - a0 * u - a1 * v, 4) AS a2, round(b0, 4) AS b0, round(b1, 4) AS b1, round(t1 - b0 * u - b1 * v, 4) AS b2 FROM f")
add("lines_to_cdp", lambda s, d: cube.lines_to_cdp(_heads(s, d).select("inline", "crossline"), cube.affine_fit(_heads(s, d))).select(F.col("inline").cast("long").alias("inline"), F.col("crossline").cast("long").alias("crossline"), F.round("cdp_x", 3).alias("cdp_x"), F.round("cdp_y", 3).alias("cdp_y")), ["trc"], f"WITH h AS (SELECT {_LINES}, {_CDP} FROM trc) SELECT inline, crossline, CAST(cdp_x AS DOUBLE) AS cdp_x, CAST(cdp_y AS DOUBLE) AS cdp_y FROM h")
add("cdp_to_lines", lambda s, d: cube.cdp_to_lines(_heads(s, d).select("cdp_x", "cdp_y"), cube.affine_fit(_heads(s, d))).select(F.col("cdp_x").cast("long").alias("cdp_x"), F.col("cdp_y").cast("long").alias("cdp_y"), "inline", "crossline"), ["trc"], f"SELECT {_CDP}, {_LINES} FROM trc")
add("cube_area", lambda s, d: cube.area(_open(s, d).traces, 10), ["trc"], "SELECT round(sqrt(25.0 * 25 + 5 * 5) * sqrt(25.0 * 25 + 5 * 5) * count(*) FILTER (list_min(samples) < list_max(samples)) / 1000000, 2) AS km2, count(*) FILTER (list_min(samples) < list_max(samples)) AS alive FROM trc")


def _muted(s: SparkSession, d: str) -> DataFrame:
    """Traces of label 0 and 1 made constant, as dead traces are."""
    return trc(s, d).withColumn("samples", F.when(F.col("label") < 2, F.transform("samples", lambda _: F.lit(0.0))).otherwise(F.col("samples")))


add("dead_traces", lambda s, d: cube.dead_traces(_muted(s, d)), ["trc"], "SELECT i, x FROM trc WHERE label < 2")
add("dead_traces_sparse", lambda s, d: cube.dead_traces(_muted(s, d), 10), ["trc"], "SELECT i, x FROM trc WHERE label < 2")
add("slide_bounds", lambda s, d: Cube.of(_muted(s, d)).slide_bounds(0), ["trc"], "SELECT i AS line, min(x) AS first, max(x) AS last FROM trc WHERE label >= 2 GROUP BY i")
add("cube_resample", lambda s, d: _total(Cube.of(trc(s, d)).resample(1.5).traces, "i", "x"), ["trc"], f"""
WITH k AS (SELECT i, x, samples, CAST(len(samples) AS BIGINT) AS n, unnest(range(0, CAST(len(samples) * 3 // 2 AS BIGINT))) AS k FROM trc), p AS (SELECT *, least(greatest((k + CAST(0.5 AS DOUBLE)) / CAST(1.5 AS DOUBLE) - CAST(0.5 AS DOUBLE), 0), n - 1) AS p FROM k),
v AS (SELECT i, x, k, samples[CAST(floor(p) AS BIGINT) + 1] AS a, samples[least(CAST(floor(p) AS BIGINT) + 2, n)] AS b, p - floor(p) AS f FROM p), r AS (SELECT i, x, list(a + (b - a) * f ORDER BY k) AS samples FROM v GROUP BY i, x) SELECT i, x, {_W} FROM r""")


def _copies(s: SparkSession, d: str) -> str:
    def write(p: str) -> None:
        c = _cube(s, d)
        c.convert(p, "ixd")
        c.convert(f"{p}/quantized", "i", volume.quantization(vox(s, d)))

    return _written(s, d, "copies.cube", write)


add("converted_sections", lambda s, d: _total(Cube.open(s, _copies(s, d), "x").load_slide(4, 1), "i", "x"), ["trc"], f"SELECT i, x, {_W} FROM trc WHERE x = 4")
add("converted_depths", lambda s, d: s.read.parquet(f"{_copies(s, d)}/d").groupBy(F.col("d").cast("long").alias("d")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("amp").cast("double")), 5).alias("total")), ["vox"], "SELECT d, count(*) AS n, round(sum(amp), 5) AS total FROM vox GROUP BY d")
add("converted_quantized", lambda s, d: _total(Cube.open(s, f"{_copies(s, d)}/quantized").traces, "i", "x"), ["vox"], f"""
WITH r AS (SELECT least(abs(quantile_cont(amp, 0.99)), abs(quantile_cont(amp, 0.01))) AS r FROM vox), q AS (SELECT i, x, list(round_even(least(greatest(amp, -r), r) / r * 127, 0) ORDER BY d) AS samples FROM vox, r GROUP BY i, x) SELECT i, x, {_W} FROM q""")
add("cubes_equal", lambda s, d: _open(s, d).equal(_cube(s, d)), ["trc"], "SELECT CAST(0 AS BIGINT) AS only_here, CAST(0 AS BIGINT) AS only_there, CAST(0 AS BIGINT) AS differ FROM (SELECT count(*) FROM trc)")
add("amplitude_histogram", lambda s, d: cube.histogram(vox(s, d)), ["vox"], "WITH e AS (SELECT min(amp) AS a, max(amp) AS b FROM vox) SELECT CAST(least(floor((amp - a) / (b - a) * 50), 49) AS BIGINT) AS bin, round(a + (b - a) * bin / 50, 6) AS lo, count(*) AS n FROM vox, e GROUP BY 1, a, b")
_DFT = """w AS (SELECT unnest(range(0, 33)) AS k), s AS (SELECT i, x, k, sqrt(pow(sum(amp * cos(2 * pi() * k * d / 64)), 2) + pow(sum(amp * sin(2 * pi() * k * d / 64)), 2)) AS a FROM vox CROSS JOIN w GROUP BY i, x, k)"""
add("mean_spectrum", lambda s, d: cube.mean_spectrum(trc(s, d)).select("k", F.round("amplitude", 6).alias("amplitude")), ["vox"], f"WITH {_DFT} SELECT CAST(k AS BIGINT) AS k, round(avg(a), 6) AS amplitude FROM s GROUP BY k")
add("estimate_impulse", lambda s, d: cube.estimate_impulse(trc(s, d), 40).select("t", F.round("value", 6).alias("value")), ["vox"], f"""
WITH {_DFT}, m AS (SELECT k, avg(a) AS a FROM s GROUP BY k), t AS (SELECT unnest(range(-20, 21)) AS t), v AS (SELECT t, sum(CASE WHEN k IN (0, 32) THEN a ELSE 2 * a END * cos(2 * pi() * k * t / 64)) AS v FROM m CROSS JOIN t GROUP BY t)
SELECT CAST(t AS BIGINT) AS t, round(v / (SELECT v FROM v WHERE t = 0), 6) AS value FROM v""")
_STATS = "st AS (SELECT avg(amp) AS mean, stddev_pop(amp) AS std, min(amp) AS lo, max(amp) AS hi, quantile_cont(amp, 0.01) AS q_01, quantile_cont(amp, 0.05) AS q_05, quantile_cont(amp, 0.95) AS q_95, quantile_cont(amp, 0.99) AS q_99 FROM vox)"
add("normalization_stats", lambda s, d: volume.normalization_stats(vox(s, d)).select(*(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "q_01", "q_05", "q_95", "q_99"))), ["vox"], f"WITH {_STATS} SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, round(q_01, 6) AS q_01, round(q_05, 6) AS q_05, round(q_95, 6) AS q_95, round(q_99, 6) AS q_99 FROM st")
add("normalize_clipped", lambda s, d: volume.normalize(vox(s, d), "meanstd", True), ["vox"], f"WITH {_STATS} SELECT i, x, d, round((least(greatest(amp, q_01), q_99) - mean) / std, 6) AS amp FROM vox, st")
add("denormalize", lambda s, d: volume.denormalize(vox(s, d), volume.normalization_stats(vox(s, d)), "minmax"), ["vox"], f"WITH {_STATS} SELECT i, x, d, round(amp * (hi - lo) + lo, 6) AS amp FROM vox, st")
_QUANT = "r AS (SELECT least(abs(quantile_cont(amp, 0.99) - avg(amp)), abs(quantile_cont(amp, 0.01) - avg(amp))) AS r, avg(amp) AS c FROM vox), q AS (SELECT i, x, d, amp, r, c, round_even(least(greatest(amp - c, -r), r) / r * 127, 0) AS q FROM vox, r)"
add("quantize_centered", lambda s, d: volume.quantize(vox(s, d), center=True), ["vox"], f"WITH {_QUANT} SELECT i, x, d, CAST(q AS BIGINT) AS q FROM q")
add("dequantize", lambda s, d: _back(s, d), ["vox"], f"WITH {_QUANT} SELECT i, x, d, round(q / 127 * r + c, 6) AS amp FROM q")
add("quantization_error", lambda s, d: volume.quantization_error(vox(s, d), volume.quantization(vox(s, d), center=True)), ["vox"], f"WITH {_QUANT} SELECT round(avg(abs(q / 127 * r + c - amp)) / stddev_pop(amp), 6) AS error FROM q")


def _back(s: SparkSession, d: str) -> DataFrame:
    how = volume.quantization(vox(s, d), center=True)
    return volume.dequantize(volume.quantize(vox(s, d), how=how), how).select("i", "x", "d", F.round("amp", 6).alias("amp"))

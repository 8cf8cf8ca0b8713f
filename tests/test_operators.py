import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import geometry, signal
from voxelframe.operators import components, mistie, surface
from voxelframe.sources import segy, text


def test_mistie_worked_example():
    """Four lines, six crossings; node values 0, -1, 20, 1 up to noise of the edges."""
    a, b, m = np.array([1, 0, 0, 0, 1, 2]), np.array([2, 2, 1, 3, 3, 3]), np.array([21.0, 1, -19, 1, 20, -2])
    x, rms, _ = mistie.distribute(a, b, m, np.arange(4))
    best = np.linalg.lstsq(np.eye(4)[a] - np.eye(4)[b], m, rcond=None)[0]
    assert np.allclose(x - x.mean(), best - best.mean(), atol=0.05)
    assert rms < np.sqrt(np.mean(m**2))


def test_jacobi_matches_solver(spark):
    e = spark.createDataFrame([(1, 2, 21.0), (0, 2, 1.0), (0, 1, -19.0), (0, 3, 1.0), (1, 3, 20.0), (2, 3, -2.0)], "a long, b long, m double")
    c = None
    for _ in range(12):
        c = spark.createDataFrame(mistie.jacobi_step(e, c).collect())
    got = {r["node"]: r["correction"] for r in c.collect()}
    ref = {r["node"]: r["correction"] for r in mistie.mistie_solve(e).collect()}
    assert all(abs((got[k] - got[0]) - (ref[k] - ref[0])) < 0.1 for k in got)


def test_split_and_merge(spark):
    """A surface cut into parts and merged again is itself; the four statuses."""
    s = spark.range(400).select((F.col("id") / 20).cast("long").alias("i"), (F.col("id") % 20).alias("x"), (50 + F.col("id") % 3).alias("d"))
    a, b = s.where("i < 12"), s.where("i >= 8")
    assert sorted(surface.overlap_merge(a, b).collect()) == sorted(s.collect())
    named = lambda df, n: df.withColumn("s", F.lit(n))
    all_ = named(a, "a").union(named(b, "b")).union(named(s.where("i < 4").withColumn("d", F.col("d") + 50), "c")).union(named(s.where("i < 8").withColumn("d", F.col("d") + 2), "d"))
    st = {(r["a"], r["b"]): r["status"] for r in surface.merge_status(all_).collect()}
    assert (st["a", "b"], st["b", "c"], st["a", "d"], st["a", "c"]) == (4, 3, 1, 0)


def test_long_thin_component(spark):
    v = spark.range(300).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("d")).union(spark.createDataFrame([(5, 9, 9)], "i long, x long, d long"))
    got = components.voxel_components(v, (16, 16))
    assert got.select("c").distinct().count() == 2
    assert components.largest(got).count() == 300


def test_signal(spark):
    t = np.arange(128)
    x = np.cos(2 * np.pi * 8 * t / 128)
    assert np.allclose(np.abs(signal.analytic(x)), 1)
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [])], "k long, samples array<double>")
    got = {r["k"]: r["e"] for r in df.select("k", signal.envelope("samples").alias("e")).collect()}
    assert np.allclose(got[1], 1) and got[2] is None and list(got[3]) == []
    w = np.convolve(np.random.default_rng(1).normal(size=128), np.hanning(9), "same")
    shift, _, gain, corr = signal.match(w, 0.5 * np.roll(w, -3))
    assert abs(shift - 3) < 0.3 and abs(gain - 2) < 0.3 and corr > 0.9


def test_triangle():
    t = np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0]], float)
    got = {tuple(p) for p in geometry.triangle_voxels(t, 1.0).tolist()}
    assert got == {(i, x, 0) for i in range(5) for x in range(5) if i + x <= 4}


def test_segy_round_trip(spark, tmp_path):
    rng = np.random.default_rng(42)
    rows = [{"inline": 10 + k // 5, "crossline": 20 + k % 5, "trace_id": k + 1, "cdp_x": k, "cdp_y": -k, "delay": 4, "samples": rng.normal(0, 1000, 50).astype(np.float32).tolist()} for k in range(30)]
    (tmp_path / "a.sgy").write_bytes(segy.encode_segy(rows))
    got = {r["trace_id"]: r for r in segy.read_segy(spark, str(tmp_path / "a.sgy")).collect()}
    assert len(got) == 30 and all(got[r["trace_id"]][c] == r[c] for r in rows for c in r)
    traces = segy.read_segy(spark, str(tmp_path / "a.sgy"))
    segy.write_segy(traces, str(tmp_path / "b"), lines_per_file=3)
    assert len(segy.files_of(str(tmp_path / "b"))) == 3
    key = lambda df: sorted((r["inline"], r["crossline"], r["delay"], tuple(r["samples"])) for r in df.collect())
    assert key(segy.read_segy(spark, str(tmp_path / "b"), chunk=4)) == key(traces)
    heads = segy.read_segy(spark, str(tmp_path / "a.sgy"), ("inline", "offset"), samples=False)
    assert heads.columns == ["inline", "offset", "file"] and heads.count() == 30


def test_segy_faults(spark, tmp_path):
    """A file that ends within a trace, heads that disagree, and an unknown header are errors."""
    whole = segy.encode_segy([{"inline": 1, "crossline": 1, "samples": [1.0, 2.0]}])
    (tmp_path / "cut.sgy").write_bytes(whole[:-3])
    with pytest.raises(ValueError, match="whole number of traces"):
        segy.file_head(str(tmp_path / "cut.sgy"))
    (tmp_path / "two.sgy").write_bytes(whole[: segy.TEXT + 16] + b"\x03\xe8" + whole[segy.TEXT + 18 :])
    with pytest.raises(ValueError, match="disagree"):
        segy.file_head(str(tmp_path / "two.sgy"))
    with pytest.raises(Exception, match="no such trace header"):
        segy.read_segy(spark, str(tmp_path / "two.sgy"), ("nothing",)).count()


@pytest.mark.parametrize("value", [0.0, 1.0, -118.625, 1e-3])
def test_ibm(value):
    m, e = abs(value), 64
    while m and m < 1 / 16:
        m, e = m * 16, e - 1
    while m >= 1:
        m, e = m / 16, e + 1
    word = (value < 0) << 31 | (e << 24 if m else 0) | round(m * (1 << 24))
    assert segy.ibm_to_ieee(np.array([word], ">u4"))[0] == pytest.approx(value, rel=1e-6)


def test_text_formats(spark, tmp_path):
    s = spark.createDataFrame([(2, 1, 5), (1, 1, 4), (1, 2, 7)], "i long, x long, d long")
    text.write_picks(s, str(tmp_path / "p"))
    assert sorted(map(tuple, text.read_picks(spark, str(tmp_path / "p")).collect())) == [(1, 1, 4), (1, 2, 7), (2, 1, 5)]
    (tmp_path / "w.txt").write_text("INLINE : 7 XLINE : 9 100.0 200.0 33.5\nbad line\n")
    assert text.read_picks(spark, str(tmp_path / "w.txt")).collect()[0][2] == 33.5
    n = spark.createDataFrame([("f", 1, 1.0, 2.0, 3.0), ("f", 2, 4.0, 5.0, 6.0)], "fault string, stick long, i double, x double, d double")
    text.write_sticks(n, str(tmp_path / "s"))
    assert sorted(map(tuple, text.read_sticks(spark, str(tmp_path / "s")).select("fault", "stick", "i", "x", "d").collect())) == sorted(map(tuple, n.collect()))
    (tmp_path / "a.las").write_text("~Version\nVERS. 2.0\n~Well\nNULL. -999.25 : null\n~Curve\nDEPT.M :\nGR.API :\n~A\n1.0 50\n2.0 -999.25\n")
    assert sorted(map(tuple, text.read_las(spark, str(tmp_path / "a.las")).collect())) == [("a", 1.0, "GR", 50.0), ("a", 2.0, "GR", None)]


def test_stream_equals_batch(spark, tmp_path):
    from voxelframe.streaming.surface import windowed_logs

    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed_logs(stream).writeStream.format("memory").queryName("logs_by_hour").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("logs_by_hour").collect())) == sorted(map(tuple, windowed_logs(batch).collect()))

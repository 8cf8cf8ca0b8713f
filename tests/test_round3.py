"""Findings of round 3: results at sizes and on values where they differed."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from voxelframe.operators import matching
from voxelframe.plans.catalog import ORACLES, QUERIES
from voxelframe.sources import segy


def rows_made(df):
    """The most rows that a node of the plan put out, once ``df`` was collected."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def nearest(points, picks, far):
    """By all pairs, as the SQL has it: NaN after numbers, unknown distances and depths last."""
    out = {}
    for key, n, px, py in points:
        for k, depth, x, y in picks:
            if k is not None and k == key:
                f = None if None in (px, py, x, y) else far(abs(px - x), abs(py - y))
                rank = f is None, f is not None and math.isnan(f), 0.0 if f is None or math.isnan(f) else f, depth is None, depth or 0
                if (key, n) not in out or rank < out[key, n][0]:
                    out[key, n] = rank, depth, f if f is None else round(f, 6)
    return {(*k, v[1], repr(v[2])) for k, v in out.items()}


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_nearest_pick_brute_force(spark, metric):
    """Clusters, copies, ties, several rows of an id, one strip and many, and places that aren't finite."""
    rng = np.random.default_rng(3)
    odd = [None, math.nan, math.inf, -math.inf]
    spread = {0: (9.0, 3000.0), 1: (3000.0, 9.0), 2: (0.0, 50.0), 3: (6.0, 6.0)}
    place = lambda k: tuple(float(v) for v in np.rint(rng.normal(size=2) * spread[k]))
    picks = [(k, int(d), *place(k)) for k in spread for d in rng.integers(0, 500, 400)]
    points = [(k, int(n), *place(k)) for k in spread for n in rng.integers(0, 60, 80)] + [(k, 100 + n, 1e4 * n, -1e4) for k in spread for n in range(3)]
    picks += [(k, None, 0.0, 0.0) for k in spread] + [(3, 1, v, 0.0) for v in odd] + [(None, 7, 0.0, 0.0)]
    picks += [(k, d, *v) for k, d, v in zip((4, 4, 5, 5, 6, 6, 7), (9, 8, 7, 6, None, 5, 4), ((None, 0.0), (math.nan, 0.0), (math.inf, 0.0), (math.nan, 1.0), (None, 0.0), (0.0, None), (1.0, -math.inf)), strict=True)]
    points += [(k, 200 + n, v, w) for k in range(8) for n, (v, w) in enumerate([*((o, 2.0) for o in odd), *((1.0, o) for o in odd), (0.0, 0.0)])] + [(None, 1, 0.0, 0.0), (99, 1, 0.0, 0.0)]
    a = spark.createDataFrame(points, "line long, id long, x double, y double")
    b = spark.createDataFrame(picks, "line long, depth long, x double, y double")
    got = [(r["line"], r["id"], r["depth"], repr(r["distance"])) for r in matching.nearest_pick(a, b, "line", metric).collect()]
    want = nearest(points, picks, (lambda x, y: x + y) if metric == "l1" else lambda x, y: math.sqrt(x * x + y * y))
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_pick_forms_no_pairs(spark):
    """A line of 20 000 points and 4 000 picks has 80 million pairs."""
    place = lambda n: spark.range(n).selectExpr("1L as line", "id", "id as depth", "double(pmod(id * 7919, 11000)) as x", "id * 10.0D as y")
    df = matching.nearest_pick(place(20_000).drop("depth"), place(4_000).drop("id"), "line")
    assert len(df.collect()) == 20_000
    assert rows_made(df) < 200_000


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """(vector ids of each 20 inlines, folder): traces that a range partitioning by a sample can't deal out evenly."""
    out = str(tmp_path_factory.mktemp("sf"))
    parts = [range(k * 250, k * 250 + n) for k, n in ((0, 10), (1, 10), (2, 10), (3, 250), (4, 250), (7, 5))]
    spark.createDataFrame([(v, [float(v), 1.0], 0) for p in parts for v in p], "vec_id long, embedding array<double>, label int").write.parquet(f"{out}/embeddings.parquet")
    return parts, out


def test_segy_file_of_each_20_inlines(spark, uneven):
    """Trace numbers begin anew with each 20 inlines, wherever partitions end."""
    parts, folder = uneven
    want = {(100 + 2 * (v // 25), 300 + 3 * (v % 25), k) for p in parts for k, v in enumerate(p, 1)}
    got = [(r["inline"], r["crossline"], r["trace_id"]) for r in QUERIES["segy_headers"](spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want


def test_trace_chunks_of_uneven_files(spark, uneven):
    """Chunks of 64 trace numbers, counted over files of 10, 10, 10, 250, 250 and 5 traces."""
    got = [tuple(r) for r in QUERIES["trace_chunks"](spark, uneven[1]).collect()]
    assert sorted(got) == sorted(Counter(k // 64 for p in uneven[0] for k in range(len(p))).items())


@pytest.mark.parametrize("name", ["trace_chunks", "segy_headers"])
def test_trace_numbers_about_line_0(spark, tmp_path, name):
    """The SQL's quotient of lines is cut towards zero: lines -18 to 18 are of one file."""
    spark.createDataFrame([(v, [float(v), 1.0], 0) for v in range(-2000, -500)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())


def test_segy_writer_splits_a_partition(spark, tmp_path):
    """One partition with three files' lines, and traces without a line in one of their own."""
    lines = [None, -1, 0, 1, 2, 5]
    t = spark.createDataFrame([(v, x, [float(v or 0), float(x)]) for v in lines for x in range(3)], "inline int, crossline int, samples array<float>").coalesce(1).sortWithinPartitions("inline", "crossline")
    spark.dataSource.register(segy.SegySource)
    t.write.format("segy").options(lines="3").mode("overwrite").save(f"{tmp_path}/a")
    got = {}
    for r in segy.read_segy(spark, f"{tmp_path}/a").orderBy("trace_id").collect():
        got.setdefault(r["file"], []).append((r["inline"], r["crossline"], list(r["samples"])))
    assert sorted(got.values()) == sorted([(v or 0, x, [float(v or 0), float(x)]) for v in part for x in range(3)] for part in ([None], [-1], [0, 1, 2], [5]))

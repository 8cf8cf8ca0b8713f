"""Operators without SQL against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import components, cube, faults, merging, mistie, stencil, volume, wells
from voxelframe.operators import surface_maps as maps


def voxels(spark, cells, names="i long, x long, d long"):
    return spark.createDataFrame([tuple(int(v) for v in c) for c in cells], names)


def brute_components(cells):
    left, out = set(cells), {}
    while left:
        todo = [left.pop()]
        body = set(todo)
        while todo:
            c = todo.pop()
            for n in list(left):
                if all(abs(a - b) <= 1 for a, b in zip(c, n, strict=True)):
                    left.discard(n)
                    body.add(n)
                    todo.append(n)
        out |= {c: min(body) for c in body}
    return out


@pytest.mark.parametrize("side", [4, 48])
def test_components(spark, side):
    """Bodies over many tiles (side 4) and within one; named by the least cell."""
    rng = np.random.default_rng(1)
    cells = {tuple(int(v) for v in c) for c in rng.integers(-6, 14, (420, 3))}
    want = brute_components(cells)
    got = components.grid_components(voxels(spark, cells), ["i", "x", "d"], "(i * 1000 + x) * 1000 + d", side).collect()
    code = lambda c: (c[0] * 1000 + c[1]) * 1000 + c[2]
    least = {}
    for c, b in want.items():
        least[b] = min(least.get(b, code(c)), code(c))
    assert {(r["i"], r["x"], r["d"]): r["c"] for r in got} == {c: least[b] for c, b in want.items()}


def test_from_mask(spark):
    rng = np.random.default_rng(2)
    cells = {tuple(int(v) for v in c): float(p) for c, p in zip(rng.integers(0, 12, (300, 3)), rng.random(300), strict=True)}
    rows = [(*c, p) for c, p in cells.items()]
    want = brute_components([c for c, p in cells.items() if p >= 0.5])
    bodies = {}
    for (i, x, d), b in want.items():
        bodies.setdefault(b, {}).setdefault((i, x), []).append(d)
    got = {}
    for r in components.from_mask(spark.createDataFrame(rows, "i long, x long, d long, p double"), 0.5, "mean", 3, (1000, 1000)).collect():
        got.setdefault(r["rank"], {})[r["i"], r["x"]] = r["d"]
    kept = [{t: int(np.rint(np.mean(d))) for t, d in b.items()} for b in bodies.values() if len(b) >= 3]
    assert sorted(map(lambda b: sorted(b.items()), got.values())) == sorted(map(lambda b: sorted(b.items()), kept))
    assert [len(got[k]) for k in sorted(got)] == sorted(map(len, kept), reverse=True)


def test_extract_from_mask(spark):
    """Two crossing sheets: every voxel is in one surface, each with one depth a trace."""
    cells = {(i, x, 5) for i in range(8) for x in range(8)} | {(i, x, 2 + i) for i in range(8) for x in range(8)} | {(20, 20, 3), (20, 21, 3)}
    out = merging.extract_from_mask(voxels(spark, cells), 1).collect()
    assert {(r["i"], r["x"], r["d"]) for r in out} == cells and len(out) == len(cells)
    assert len({(r["s"], r["i"], r["x"]) for r in out}) == len(out)
    assert all(len({r["s"] for r in merging.extract_from_mask(voxels(spark, {c for c in cells if c[0] == 20}), 2).collect()}) == 1 for _ in range(1))


@pytest.mark.parametrize("split, shift, want", [(30, 0, 3), (25, 0, 4), (25, 1.5, 0), (25, 50, 0)])
def test_merge_statuses(spark, split, shift, want):
    """Two halves of a flat surface: touching, overlapping, and moved in depth."""
    rows = [("a", i, x, 100) for i in range(40) for x in range(30)] + [("b", i, x, int(100 + shift)) for i in range(40) for x in range(split, 60)]
    s = spark.createDataFrame(rows, "s string, i long, x long, d long")
    r = merging.compared(s, 0.5, 2, 1).collect()
    assert [x["status"] for x in r] == [want]
    assert len({x["s"] for x in merging.merge_list(s, 0.5, 2, 1).select("s").distinct().collect()}) == (1 if want in (3, 4) else 2)
    one = merging.merge_into(s.where("s = 'a'").select("i", "x", "d"), s.where("s = 'b'"), 0.5, 2, 1).count()
    assert one == (40 * 60 if want == 4 else 40 * 30)


def test_merge_far(spark):
    s = spark.createDataFrame([("a", 0, 0, 5), ("b", 50, 50, 5)], "s string, i long, x long, d long")
    assert merging.compared(s).count() == 0 and merging.merge_list(s).count() == 2


def test_holes_and_main_part(spark):
    """A ring with a hole, a loose part, and dead traces."""
    ring = {(i, x) for i in range(7) for x in range(7)} - {(3, 3), (3, 4)}
    loose = {(20, 20), (20, 21)}
    p = spark.createDataFrame([(i, x, 9) for i, x in ring | loose], "i long, x long, d long")
    assert {(r["i"], r["x"]) for r in maps.main_part(p).collect()} == ring
    one = maps.main_part(p)
    assert {(r["i"], r["x"]) for r in maps.holes(one).collect()} == {(3, 3), (3, 4)}
    r = maps.shape_report(one, one).first()
    assert (r["n"], r["filled"], r["holes"], r["perimeter"], r["is_carcass"]) == (47, 49, 1, 24, False)
    thin = p.union(spark.createDataFrame([(i, 3, 9) for i in range(7, 20)], "i long, x long, d long")).union(spark.createDataFrame([(20, x, 9) for x in range(3, 20)], "i long, x long, d long"))
    assert maps.main_part(thin, 0).count() == thin.count()  # a bridge of one trace
    assert {(r["i"], r["x"]) for r in maps.main_part(thin, 1).collect()} <= {(i, x) for i in range(9) for x in range(9)}


def test_inpaint(spark):
    """A plane with a hole is filled with the plane; far traces stay absent."""
    rows = [("a", i, x, float(i + 2 * x)) for i in range(40) for x in range(40) if not (18 <= i <= 20 and 18 <= x <= 20)]
    out = {(r["i"], r["x"]): r["d"] for r in maps.inpaint(spark.createDataFrame(rows, "s string, i long, x long, d double"), "s", 2, 200).collect()}
    assert all(abs(out[i, x] - (i + 2 * x)) < 1e-3 for i in range(18, 21) for x in range(18, 21))
    assert all(out[i, x] == i + 2 * x for _, i, x, _ in rows) and (60, 60) not in out


def test_tiles_agree(spark):
    """A stencil over small tiles is that over one large tile."""
    rng = np.random.default_rng(4)
    rows = [("a", int(i), int(x), float(rng.integers(0, 50))) for i in range(-5, 30) for x in range(20) if rng.random() < 0.8]
    s = spark.createDataFrame(rows, "s string, i long, x long, d double")
    f = lambda a: stencil.kernel_mean(stencil.kernel_mean(a, np.ones((3, 3)), 20), np.ones((3, 3)), 20)
    small, large = ({(r["i"], r["x"]): round(r["d"], 9) for r in stencil.by_tiles(s, ["s"], f, 2, side=n).collect()} for n in (5, 128))
    assert small == large and len(large) == len(rows)


def test_quantiles(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=500), np.full(300, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "amp double")
    q = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    assert np.allclose(volume.exact_quantiles(df, "amp", q), np.quantile(v, q), rtol=0, atol=1e-9)
    assert volume.exact_quantiles(df.where("amp is null"), "amp", q) == [None] * len(q)


def test_interpolate_many_rows_of_one_well(spark):
    """One well of 80 000 rows: linear, not quadratic."""
    t = spark.range(40_000)
    left = t.select(F.lit(1).alias("well"), (F.col("id") * 2 + 1).alias("t"))
    right = t.select(F.lit(1).alias("well"), (F.col("id") * 2).alias("t"), F.col("id").cast("double").alias("v"))
    out = wells.interpolate_log(left, right)
    r = out.agg(F.count("v").alias("n"), F.max(F.abs(F.col("v") - F.least((F.col("t") / 2), F.lit(39_999.0)))).alias("e")).first()
    assert (r["n"], round(r["e"], 6)) == (40_000, 0)


def test_mistie_by_updates(spark):
    """The distributed updates end where those of one task do."""
    e = spark.createDataFrame([(1, 2, 21.0), (0, 2, 1.0), (0, 1, -19.0), (0, 3, 1.0), (1, 3, 20.0), (2, 3, -2.0)], "a long, b long, m double")
    a = {r["node"]: r["correction"] for r in mistie.mistie_solve(e).collect()}
    b = {r["node"]: r["correction"] for r in mistie.mistie_solve(e, most=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_extract_faults(spark):
    """Two planes through the slides, apart along x, come out as two faults."""
    cells = {(i, 10 + d // 4, d) for i in range(6) for d in range(24)} | {(i, 40 - d // 4, d) for i in range(6) for d in range(24)} | {(2, 70, 1)}
    out = faults.extract(voxels(spark, cells), "i", 20, 5, 100).collect()
    bodies = {}
    for r in out:
        bodies.setdefault(r["fault"], set()).add((r["i"], r["x"], r["d"]))
    assert sorted(map(len, bodies.values())) == [144, 144] and (2, 70, 1) not in set().union(*bodies.values())


def test_cube_limits(spark):
    c = cube.Cube.of(spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0])], "i long, x long, samples array<double>"))
    with pytest.raises(ValueError, match="no depth limits"):
        c.load_slide(0, 2, (0, 1))
    with pytest.raises(IndexError):
        c.load_slide(4, 0)
    with pytest.raises(ValueError, match="begins with #"):
        c.slide_index("244")
    assert [r["samples"] for r in c[0, :, -2:].collect()] == [[2.0, 3.0]]
    with pytest.raises(TypeError):
        cube.Cube.new(spark, __file__)


def test_principal_components(spark):
    """Against a singular value decomposition; rows with a null are left out."""
    from voxelframe.operators.matching import principal_components

    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(1.0, None, 2.0, 3.0)], "a double, b double, c double, d double")
    got = np.array([[r[f"pc{k}"] for k in range(3)] for r in principal_components(df, list("abcd"), 3).collect()])
    z = x - x.mean(0)
    v = np.linalg.svd(z, full_matrices=False)[2][:3].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(3)])
    assert np.allclose(np.sort(got, axis=0), np.sort(z @ v, axis=0))


def test_picks_kind(tmp_path):
    from voxelframe.sources import text

    (tmp_path / "a.txt").write_text("1 2 3\n" * 30_000)
    (tmp_path / "b.txt").write_text("1 2 3 4\n" * 30_000)
    (tmp_path / "c.txt").write_text("1 2 3\n")
    (tmp_path / "d.segy").write_text("1 2 3\n" * 30_000)
    assert [text.is_picks(str(tmp_path / n)) for n in ("a.txt", "b.txt", "c.txt", "d.segy", "none")] == [True, False, False, False, False]


def test_checkshot(spark, tmp_path):
    from voxelframe.sources import text

    (tmp_path / "w.txt").write_text("head line\n" * 14 + "1.5 2.5 -100 -80 120 W1 2000 2100\n3 4 -200 -160 240 W1 2001 2101\n")
    got = sorted(map(tuple, text.read_checkshot(spark, str(tmp_path / "w.txt")).collect()))
    assert got == [("W1", 1.5, 2.5, 100.0, 80.0, 120.0), ("W1", 3.0, 4.0, 200.0, 160.0, 240.0)]

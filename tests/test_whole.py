"""Queries over tables larger than the driver's small ones, against brute force."""

import numpy as np
import pytest

from voxelframe.functions import geometry, signal
from voxelframe.operators import grids
from voxelframe.plans.catalog import CROP, QUERIES, STRIDE
from voxelframe.sources import segy

VECTORS, DEPTH = 710, 70


@pytest.fixture(scope="module")
def cube():
    v = np.random.default_rng(8).normal(size=(VECTORS, DEPTH))
    return {(k // 25, k % 25): v[k] for k in range(VECTORS)}


@pytest.fixture(scope="module")
def folder(spark, cube, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rows = [(i * 25 + x, v.tolist(), 0) for (i, x), v in cube.items()]
    spark.createDataFrame([*rows, (99_999, None, 0), (None, [1.0], 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{out}/embeddings.parquet")
    return out


def test_grid_covers_table(spark, folder, cube):
    """29 inlines of 70 samples: crops begin past inline 20 and sample 64 too."""
    ends = max(i for i, _ in cube) + 1, 25, DEPTH
    axes = [grids.starts(n, c, t) for n, c, t in zip(ends, CROP, STRIDE, strict=True)]
    want = [(i, x, d) for i in axes[0] for x in axes[1] for d in axes[2]]
    got = sorted((r["loc_id"], r["i0"], r["x0"], r["d0"]) for r in QUERIES["regular_grid"](spark, folder).collect())
    assert got == [(k, *w) for k, w in enumerate(want)]
    crops, values = {}, {}
    for k, (i0, x0, d0) in enumerate(want):
        for i in range(i0, i0 + CROP[0]):
            for x in range(x0, x0 + CROP[1]):
                for d in range(d0, d0 + CROP[2]):
                    if (i, x) in cube:
                        crops.setdefault(k, []).append(cube[i, x][d])
                        values.setdefault((i, x, d), []).append(cube[i, x][d] + k)
    load = {r["loc_id"]: (r["n"], r["total"]) for r in QUERIES["crop_load"](spark, folder).collect()}
    assert load.keys() == crops.keys()
    assert all(load[k][0] == len(v) and abs(load[k][1] - sum(v)) < 1e-5 for k, v in crops.items())
    assert len(values) == VECTORS * DEPTH
    for how, f in (("max", max), ("mean", np.mean)):
        acc = {(r["i"], r["x"], r["d"]): r["v"] for r in QUERIES[f"acc_{how}"](spark, folder).collect()}
        assert acc.keys() == values.keys() and all(abs(acc[k] - f(v)) < 1e-5 for k, v in values.items())


def test_sticks_from_all_inlines(spark, tmp_path):
    """No inline here is a multiple of ten; one has a single trace with a single hit."""
    rng = np.random.default_rng(4)
    hits = [(int(i), int(x), float(d)) for i in (1, 2, 4, 33, 34, 37) for x, d in zip(rng.integers(11, 17, 9), rng.integers(1, 20, 9), strict=True)] + [(35, 13, 7.0)]
    spark.createDataFrame([(i, x, d, 0.0, "A") for i, x, d in hits], "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    stick = {}
    for i in {h[0] for h in hits}:
        depths = [d for k, _, d in hits if k == i]
        x = np.mean(sorted({x for k, x, _ in hits if k == i}))
        stick[i] = np.array([(i, x, min(depths)), (i, x, max(depths))])
    want = set()
    for fault, inlines in (("0", (1, 2, 4)), ("1", (33, 34, 35, 37))):
        for u, v in zip(inlines[:-1], inlines[1:], strict=True):
            for t in geometry.strip(stick[u], stick[v]):
                for p in np.ndindex(40, 20, 22):
                    if geometry.distance_to_triangle(np.array([p], float), t)[0] <= 0.5:
                        want.add((fault, *p))
    got = [tuple(r) for r in QUERIES["sticks_to_points"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {1, 2, 4, 33, 34, 35, 37} <= {p[1] for p in got}


@pytest.mark.parametrize("lag", [40, -35, 25])
def test_match_finds_far_shifts(lag):
    """Traces of 64 samples that overlap in a part; beyond 20 samples nothing was found."""
    w = np.random.default_rng(5).normal(size=200)
    shift, _, gain, _ = signal.match(w[70:134], 2 * w[70 + lag : 134 + lag])
    assert abs(shift - lag) < 0.5 and 0.3 < gain < 0.8


def test_match_brute_force():
    """All shifts of -100..100 by interpolation, traces 0 outside, and the taper of 10 %."""
    rng = np.random.default_rng(6)
    for n in (64, 150):
        for _ in range(5):
            a, b = rng.normal(size=n), rng.normal(size=n)
            shifts = np.linspace(-100, 100, 2001)
            moved = np.stack([np.interp(np.arange(n) - s, np.arange(-1, n + 1), np.pad(b, 1)) for s in shifts])
            norm = np.sqrt((a * a).sum() * (moved * moved).sum(axis=1))
            z = signal.analytic(moved @ a / np.where(norm > 1e-9, norm, 1))
            e, w = np.abs(z), np.hanning(200)
            tapered = e.copy()
            tapered[:100] *= w[:100]
            tapered[-100:] *= w[-100:]
            k = int(np.argmax(tapered))
            got = signal.match(a, b)
            assert np.allclose((got[0], got[1], got[3]), (shifts[k], np.rad2deg(np.angle(z[k])), e[k]), atol=1e-6)


def test_segy_files_of_other_heads(spark, tmp_path):
    """Files of several formats and lengths under one path, each by its own head."""
    import struct

    kinds = {6: ">f8", 9: ">i8", 10: ">u4", 11: ">u2", 12: ">u8", 16: "u1", 5: ">f4"}
    want = {}
    for k, (code, kind) in enumerate(kinds.items()):
        n = 5 + 3 * k
        data = np.arange(2 * n).reshape(2, n) + code
        head = bytearray(segy.BINARY)
        struct.pack_into(">H", head, 20, n)
        struct.pack_into(">H", head, 24, code)
        out = b" " * segy.TEXT + bytes(head)
        for t, row in enumerate(data):
            trace = bytearray(segy.HEAD)
            struct.pack_into(">i", trace, segy.FIELDS["inline"][0] - 1, code)
            struct.pack_into(">i", trace, segy.FIELDS["crossline"][0] - 1, t)
            out += bytes(trace) + row.astype(kind).tobytes()
            want[code, t] = row.astype(float).tolist()
        (tmp_path / f"{code}.sgy").write_bytes(out)
    got = {(r["inline"], r["crossline"]): list(r["samples"]) for r in segy.read_segy(spark, str(tmp_path)).collect()}
    assert got == want

"""Neighbourhood functions of surfaces by tiles with a halo.

Rows (by, i, x, value) are dealt to square tiles; those within ``reach`` of a
border go to the neighbouring tile too, so that one shuffle moves little more
than each row once. A tile is a small dense array (absent cells are NaN) on
which NumPy works; only its inner cells are answered, so that borders of tiles
don't show. Several passes need a halo of as many reaches, but no more shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 128


def shifted(a: np.ndarray, di: int, dx: int) -> np.ndarray:
    """b[i, x] = a[i + di, x + dx], NaN outside."""
    out = np.full_like(a, np.nan)
    n, m = a.shape
    i0, i1, x0, x1 = max(0, -di), min(n, n - di), max(0, -dx), min(m, m - dx)
    if i0 < i1 and x0 < x1:
        out[i0:i1, x0:x1] = a[i0 + di : i1 + di, x0 + dx : x1 + dx]
    return out


def neighbourhood(a: np.ndarray, reach_i: int, reach_x: int) -> np.ndarray:
    """All shifted copies, offset by offset."""
    return np.stack([shifted(a, di, dx) for di in range(-reach_i, reach_i + 1) for dx in range(-reach_x, reach_x + 1)])


def by_tiles(rows: DataFrame, by: list[str], f: Callable[[np.ndarray], np.ndarray], reach: int, value: str = "d", name: str = "d", side: int = SIDE) -> DataFrame:
    """(by, i, x, name: double): the finite cells of ``f`` of the surface's array."""
    side = max(side, reach)
    near = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    dealt = rows.select(*by, F.col("i").cast("long").alias("i"), F.col("x").cast("long").alias("x"), F.col(value).cast("double").alias("_v"), F.explode(near("i")).alias("_ti")).select("*", F.explode(near("x")).alias("_tx"))
    kinds = {c.name: c.dataType for c in rows.schema}
    schema = ", ".join([*(f"`{b}` {kinds[b].simpleString()}" for b in by), f"i bigint, x bigint, `{name}` double"])

    def run(t: pa.Table) -> pa.Table:
        ti, tx = t.column("_ti")[0].as_py() * side, t.column("_tx")[0].as_py() * side
        a = np.full((side + 2 * reach, side + 2 * reach), np.nan)
        a[t.column("i").to_numpy() - ti + reach, t.column("x").to_numpy() - tx + reach] = t.column("_v").to_numpy(zero_copy_only=False)
        b = f(a)[reach : reach + side, reach : reach + side]
        i, x = np.nonzero(np.isfinite(b))
        keys = {k: pa.array([t.column(k)[0].as_py()] * len(i), t.schema.field(k).type) for k in by}
        return pa.table(keys | {"i": pa.array(i + ti), "x": pa.array(x + tx), name: pa.array(b[i, x])})

    return dealt.groupBy(*by, "_ti", "_tx").applyInArrow(run, schema)


def kernel_mean(a: np.ndarray, kernel: np.ndarray, max_difference: float | None = None, sigma_range: float | None = None) -> np.ndarray:
    """Normalised kernel over present neighbours of present cells; those farther
    than ``max_difference`` from the cell are left out; ``sigma_range`` adds a
    Gaussian weight of the difference."""
    ri, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    top, weight = np.zeros_like(a), np.zeros_like(a)
    for di in range(-ri, ri + 1):
        for dx in range(-rx, rx + 1):
            b = shifted(a, di, dx)
            gap = b - a
            w = np.where(np.isfinite(gap), kernel[di + ri, dx + rx], 0.0)
            if max_difference is not None:
                w = np.where(np.abs(gap) <= max_difference, w, 0.0)
            if sigma_range:
                w = w * np.exp(-np.nan_to_num(gap) ** 2 / (2.0 * sigma_range * sigma_range))
            top += w * np.nan_to_num(b)
            weight += w
    return np.where(np.isfinite(a) & (weight > 0), top / np.where(weight > 0, weight, 1), np.nan)


def filled(a: np.ndarray, kernel: np.ndarray, least: int = 1, max_ptp: float | None = None) -> np.ndarray:
    """Absent cells with enough present neighbours become their weighted mean."""
    ri, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    n = neighbourhood(a, ri, rx)
    here = np.isfinite(n)
    count = here.sum(axis=0)
    k = kernel.ravel()[:, None, None]
    weight = (here * k).sum(axis=0)
    ok = ~np.isfinite(a) & (count >= least) & (weight > 0)
    if max_ptp is not None:
        ptp = np.where(here, n, -np.inf).max(axis=0) - np.where(here, n, np.inf).min(axis=0)
        ok &= ptp <= max_ptp
    mean = (np.nan_to_num(n) * k).sum(axis=0) / np.where(weight > 0, weight, 1)
    return np.where(ok, mean, a)


def median_of_others(a: np.ndarray, reach: int) -> np.ndarray:
    """Median of the present neighbours without the cell itself."""
    n = neighbourhood(a, reach, reach)
    n[len(n) // 2] = np.nan
    n = np.sort(n, axis=0)
    count = np.isfinite(n).sum(axis=0)
    lo = np.take_along_axis(n, np.maximum((count - 1) // 2, 0)[None], 0)[0]
    hi = np.take_along_axis(n, np.minimum(count // 2, len(n) - 1)[None], 0)[0]
    return np.where(count > 0, (lo + hi) / 2, np.nan)


def gaussian_kernel(sides: tuple[int, int] = (3, 3), sigma: float = 0.8) -> np.ndarray:
    i, x = (np.arange(n) - n // 2 for n in sides)
    k = np.exp(-(i[:, None] ** 2 + x[None, :] ** 2) / (2 * sigma * sigma))
    return k / k.sum()

"""Faults: sticks and triangles to voxels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def triangle_voxels(t: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Whole points within width / 2 of a triangle (3 x 3), by exact distance."""
    t = np.asarray(t, float)
    lo, hi = np.floor(t.min(0) - width), np.ceil(t.max(0) + width)
    grid = np.stack(np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)), indexing="ij"), -1).reshape(-1, 3)
    return grid[distance_to_triangle(grid, t) <= width / 2].astype(np.int64)


def _to_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    s = np.clip((p - a) @ d / max(d @ d, 1e-300), 0, 1)
    return np.linalg.norm(p - a - s[:, None] * d, axis=1)


def distance_to_triangle(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b, c = t
    edges = np.minimum(np.minimum(_to_segment(p, a, b), _to_segment(p, b, c)), _to_segment(p, c, a))
    n = np.cross(b - a, c - a)
    area = n @ n
    if area < 1e-12:
        return edges
    u = np.cross(b - a, p - a) @ n / area
    v = np.cross(p - a, c - a) @ n / area
    inside = (u >= 0) & (v >= 0) & (u + v <= 1)
    return np.where(inside, np.abs((p - a) @ n) / np.sqrt(area), edges)


def strip(s0: np.ndarray, s1: np.ndarray) -> list[np.ndarray]:
    """Triangles between two neighbouring sticks, walking down both by depth share."""
    out, i, j = [], 0, 0
    while i < len(s0) - 1 or j < len(s1) - 1:
        down = j == len(s1) - 1 or i < len(s0) - 1 and (i + 1) / max(len(s0) - 1, 1) <= (j + 1) / max(len(s1) - 1, 1)
        out.append(np.array([s0[i], s1[j], s0[i + 1] if down else s1[j + 1]], float))
        i, j = i + down, j + (not down)
    return out


def sticks_to_points(nodes: DataFrame, width: float = 1.0) -> DataFrame:
    """(fault, i, x, d) from stick nodes (fault, stick, i, x, d): each fault is
    one group (its sticks are few), neighbouring sticks are joined by triangles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sticks = [g.sort_values("d")[["i", "x", "d"]].to_numpy(float) for _, g in pdf.groupby("stick", sort=True)]
        found = [triangle_voxels(t, width) for a, b in zip(sticks[:-1], sticks[1:], strict=True) for t in strip(a, b)]
        pts = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
        return pd.DataFrame({"fault": pdf["fault"].iloc[0], "i": pts[:, 0], "x": pts[:, 1], "d": pts[:, 2]})

    return nodes.groupBy("fault").applyInPandas(run, "fault string, i long, x long, d long")

"""From a point cloud to a raster: gridding, outliers out, gaps filled, and the working cell size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators.grid import despike, distance, fill_nearest
from orogen.operators.morphology import components, spread
from orogen.operators.points import Window, grid_points, scan_stats
from orogen.operators.resample import resample
from orogen.shared import materialise

SPIKE_METRES, GAP_CELLS, RING = 5.0, 50, 2


def require_points(points: DataFrame, window: Window, select: str = "ground") -> dict:
    """The scan's counts; an error tells whether no point lies in the window or none there is usable."""
    s = scan_stats(points, window, select).first().asDict()
    if not s["n_in_window"]:
        raise ValueError("no point of the cloud lies in the window")
    if not s["n_used"]:
        raise ValueError(f"none of the window's {s['n_in_window']} points is usable ({select})")
    return s


def on_window(cells: DataFrame, window: Window) -> DataFrame:
    """(i, j, z) of all the window's cells from gridded points."""
    spark = cells.sparkSession
    rows = spark.range(window.height).select(F.col("id").alias("i")).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(window.width - 1).cast("long"))).alias("j"))
    return rows.join(cells.select(F.col("iy").cast("long").alias("i"), F.col("ix").cast("long").alias("j"), "z"), ["i", "j"], "left")


def _triangulated(points: np.ndarray, values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Linear interpolation over the Delaunay triangles of the points; NaN outside their hull.

    Triangles are made by flipping: points go in one by one, left to right, each joined with the hull's sides that it
    sees, and sides whose opposite corners lie in each other's circle are turned.
    """
    order = np.lexsort((points[:, 1], points[:, 0]))
    p = points[order]
    cross = lambda a, b, c: (p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])
    first = next((k for k in range(2, len(p)) if cross(0, 1, k) != 0), None)
    out = np.full(len(targets), np.nan)
    if first is None:
        return out
    across: dict[tuple[int, int], int] = {}  # directed side -> the third corner of its triangle, to its left

    def add(a, b, c):
        across[a, b], across[b, c], across[c, a] = c, a, b

    def settle(sides):
        while sides:
            a, b = sides.pop()
            c, d = across.get((a, b)), across.get((b, a))
            if c is None or d is None:
                continue
            m = np.array([[*(p[k] - p[d]), ((p[k] - p[d]) ** 2).sum()] for k in (a, b, c)], float)
            if np.linalg.det(m) > 1e-9:
                del across[a, b], across[b, a]
                add(c, a, d)
                add(d, b, c)
                sides += [(a, d), (d, b), (b, c), (c, a)]

    # The points before the first that is off their line: a fan from it.
    for k in range(first - 1):
        add(*((k, k + 1, first) if cross(k, k + 1, first) > 0 else (k + 1, k, first)))
    line = list(range(first))
    hull = [*line, first] if cross(0, 1, first) > 0 else [*line[::-1], first]
    for k in range(first + 1, len(p)):
        n = len(hull)
        seen = [cross(hull[s], hull[(s + 1) % n], k) < 0 for s in range(n)]
        if not any(seen):
            continue
        begin = next(s for s in range(n) if seen[s] and not seen[s - 1])
        run = []
        s = begin
        while seen[s % n] and len(run) < n:
            run.append(s % n)
            s += 1
        todo = []
        for s in run:
            a, b = hull[s], hull[(s + 1) % n]
            add(b, a, k)
            todo.append((a, b))
        inner = {hull[s] for s in run[1:]}
        at = hull.index(hull[begin])
        hull = [*hull[at:], *hull[:at]]
        hull = [hull[0], k, *[h for h in hull[1:] if h not in inner]]
        settle(todo)
    done = set()
    for (a, b), c in across.items():
        key = frozenset((a, b, c))
        if key in done:
            continue
        done.add(key)
        t = p[[a, b, c]]
        near = np.flatnonzero((targets >= t.min(0) - 1e-9).all(1) & (targets <= t.max(0) + 1e-9).all(1))
        if len(near):
            area = cross(a, b, c)
            q = targets[near]
            u = ((t[1][0] - q[:, 0]) * (t[2][1] - q[:, 1]) - (t[1][1] - q[:, 1]) * (t[2][0] - q[:, 0])) / area
            v = ((t[2][0] - q[:, 0]) * (t[0][1] - q[:, 1]) - (t[2][1] - q[:, 1]) * (t[0][0] - q[:, 0])) / area
            ok = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
            z = values[order][[a, b, c]]
            out[near[ok]] = (u * z[0] + v * z[1] + (1 - u - v) * z[2])[ok]
    return out


def fill_linear(grid: DataFrame, gap_cells: int, width: int) -> DataFrame:
    """Holes within gap_cells of data take the linear interpolation over the Delaunay triangles of the valid cells within
    RING cells of their hole; nothing is filled outside those cells' hull.

    A hole is an 8-connected component of cells without data: holes and their rims are apart, and a task's own.
    """
    grid = materialise(grid, "cloud-grid")
    of = materialise(components(grid.filter(F.col("z").isNull()).select("i", "j"), width), "cloud-holes")
    near = [(a, b) for a in range(-RING, RING + 1) for b in range(-RING, RING + 1) if 0 < a * a + b * b <= RING * RING]
    rim = spread(of, near, "component").select("component", "i", "j").distinct().join(grid.filter(F.col("z").isNotNull()), ["i", "j"])
    target = of.join(distance(grid, gap_cells).select("i", "j"), ["i", "j"]).select("component", "i", "j", F.lit(None).cast("double").alias("z"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["z"].notna().to_numpy()
        at = rows[["i", "j"]].to_numpy(float)
        z = _triangulated(at[known], rows["z"].to_numpy()[known], at[~known]) if known.sum() >= 3 else np.full((~known).sum(), np.nan)
        good = ~np.isnan(z)
        return pd.DataFrame({"i": at[~known][good, 0].astype("int64"), "j": at[~known][good, 1].astype("int64"), "f": z[good]})

    both = rim.select("component", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "z").unionByName(target.select("component", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "z"))
    filled = both.groupBy("component").applyInPandas(run, "i long, j long, f double")
    return grid.join(filled, ["i", "j"], "left").select("i", "j", F.coalesce("z", "f").alias("z"))


def clean(grid: DataFrame, width: int, spike: float = SPIKE_METRES, method: str = "linear", gap_cells: int = GAP_CELLS) -> DataFrame:
    """Outliers out, then gaps filled: linear, nearest or none."""
    if method not in ("linear", "nearest", "none"):
        raise ValueError(f"no method {method!r}")
    grid = despike(grid, spike)
    if method == "none" or gap_cells <= 0:
        return grid
    return fill_linear(grid, gap_cells, width) if method == "linear" else fill_nearest(grid, gap_cells)


def to_pixels(grid: DataFrame, cell: float, pixel: float, height: int, width: int) -> DataFrame:
    """A grid of ``cell`` brought to ``pixel``: bilinear if its cells are coarser, by shared area if they are finer."""
    if cell == pixel:
        return grid
    return resample(grid, pixel / cell, "bilinear" if cell > pixel else "average", height, width)


def surface(points: DataFrame, window: Window, select: str = "ground", **cleaning) -> DataFrame:
    """The whole chain: checked points, gridded, cleaned."""
    require_points(points, window, select)
    return clean(on_window(grid_points(points, window, select), window), window.width, **cleaning)



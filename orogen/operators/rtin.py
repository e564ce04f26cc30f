"""Tops of few triangles: right-triangulated irregular networks within a tolerance, block by block.

A block of 2**n cells a side is covered by two right triangles; a triangle is cut at the middle of its longest side as
long as the height there, or anywhere below it in the hierarchy, differs by more than the tolerance from the line between
the side's ends.  Nodes of the mask's boundary and of a block's border must stay, so that walls and neighbouring blocks
fit without cracks; nodes off the mask ask for nothing.

Errors are kept per middle node.  They grow towards the root, so that whether a triangle is a leaf follows from two
nodes alone: its own middle is within the tolerance, its parent's isn't.  Both passes are therefore slices of arrays, one
per level, without lists of triangles.  A block is bounded, whatever the raster's size, and a task's own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators.mesh import COORDS

BLOCK = 256


def errors(z: np.ndarray, must: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Per node, the error of the triangles whose longest side it halves, with all below them; must: infinite, free: zero by itself."""
    size = z.shape[0] - 1
    out = np.zeros_like(z)

    def own(y, x, dy, dx):
        e = np.abs(z[y, x] - (z[y - dy, x - dx] + z[y + dy, x + dx]) / 2)
        return np.where(must[y, x], np.inf, np.where(free[y, x], 0.0, e))

    def worst(y, x, steps):
        """The largest error at these steps from the nodes, as far as the grid goes."""
        found = np.zeros(np.broadcast(y, x).shape)
        for dy, dx in steps:
            v, u = y + dy, x + dx
            ok = (v >= 0) & (v <= size) & (u >= 0) & (u <= size)
            found = np.maximum(found, np.where(ok, out[np.clip(v, 0, size), np.clip(u, 0, size)], 0.0))
        return found

    half = 1
    while 2 * half <= size:
        odd, even = np.arange(half, size, 2 * half), np.arange(0, size + 1, 2 * half)
        inner = [(a * half // 2, b * half // 2) for a in (-1, 1) for b in (-1, 1)] if half > 1 else []
        for y, x, dy, dx in ((odd[:, None], even[None, :], half, 0), (even[:, None], odd[None, :], 0, half)):
            out[y, x] = np.maximum(own(y, x, dy, dx), worst(y, x, inner))
        y, x = odd[:, None], odd[None, :]
        e = np.where(_main(y, x, half, size), own(y, x, half, half), own(y, x, half, -half))
        out[y, x] = np.maximum(e, worst(y, x, [(half, 0), (-half, 0), (0, half), (0, -half)]))
        half *= 2
    return out


def _parent(c: np.ndarray, half: int) -> np.ndarray:
    """Of the two corners at c - half and c + half the one that is the middle of the square of twice the side."""
    return np.where((c - half) // (2 * half) % 2 == 1, c - half, c + half)


def _main(y: np.ndarray, x: np.ndarray, half: int, size: int) -> np.ndarray:
    """Whether the square about (y, x) is cut from its north-west to its south-east corner: through its parent's middle."""
    if 2 * half == size:
        return np.ones(np.broadcast(y, x).shape, bool)
    return np.broadcast_to((_parent(y, half) < y) == (_parent(x, half) < x), np.broadcast(y, x).shape)


def leaves(e: np.ndarray, tolerance: float) -> np.ndarray:
    """Triangles (n, 3, 2) of node positions (row, column), the right angle last."""
    size = e.shape[0] - 1
    out: list[np.ndarray] = []

    def add(keep, *nodes):
        keep = np.broadcast_to(keep, np.broadcast(*[c for n in nodes for c in n]).shape)
        if keep.any():
            out.append(np.stack([np.stack([np.broadcast_to(c, keep.shape)[keep] for c in n], axis=-1) for n in nodes], axis=1))

    mid = size // 2
    if size > 1:
        whole = np.array([[e[mid, mid] <= tolerance]])
        o, t, m = np.array([[0]]), np.array([[size]]), np.array([[mid]])
        add(whole, (o, o), (t, t), (t, o))
        add(whole, (t, t), (o, o), (o, t))
    half = size // 2
    while half >= 1:
        odd = np.arange(half, size, 2 * half)
        y, x = odd[:, None], odd[None, :]
        cut = e[y, x] > tolerance
        # Triangles over the sides of the squares: the right angle is in the middle, which is cut.
        for ey, ex, a, b in ((y - half, x, (0, -1), (0, 1)), (y + half, x, (0, -1), (0, 1)), (y, x - half, (-1, 0), (1, 0)), (y, x + half, (-1, 0), (1, 0))):
            add(cut & (e[ey, ex] <= tolerance), (ey + a[0] * half, ex + a[1] * half), (ey + b[0] * half, ex + b[1] * half), (y, x))
        # Triangles over the diagonals of the quarters: from the middle to a corner; the right angle halves a cut side.
        for sy in (-1, 1):
            for sx in (-1, 1):
                corner = (y + sy * half, x + sx * half)
                within = e[y + sy * half // 2, x + sx * half // 2] <= tolerance if half > 1 else np.ones(cut.shape, bool)
                for apex in ((y + sy * half, x), (y, x + sx * half)):
                    add(within & cut & (e[apex] > tolerance), (y, x), corner, apex)
        half //= 2
    return np.concatenate(out) if out else np.zeros((0, 3, 2), np.int64)


def block_top(kept: np.ndarray, z: np.ndarray, tolerance: float) -> np.ndarray:
    """Triangles (n, 3, 2) of node positions over the kept cells of a block; z has a row and a column more than kept."""
    h, w = kept.shape
    size = 2
    while size < max(h, w):
        size *= 2
    cells = np.zeros((size, size), bool)
    cells[:h, :w] = kept
    z = np.pad(z, ((0, size - h), (0, size - w)), mode="edge")
    near = np.pad(cells, 1).astype(np.int8)
    count = near[:-1, :-1] + near[1:, :-1] + near[:-1, 1:] + near[1:, 1:]
    t = leaves(errors(np.where(np.isnan(z), 0.0, z), (count > 0) & (count < 4), count == 0), tolerance)
    centre = t.sum(axis=1) // 3
    t = t[cells[centre[:, 0], centre[:, 1]]]
    # Facing up with rows running south: the turn from the first over the second to the third corner is made one way.
    (ay, ax), (by, bx), (cy, cx) = (t[:, k].T for k in range(3))
    flip = (bx - ax) * -(cy - ay) - -(by - ay) * (cx - ax) < 0
    t[flip, 1], t[flip, 2] = t[flip, 2].copy(), t[flip, 1].copy()
    return t


def adaptive_top(heights: DataFrame, tolerance: float, step: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Triangles (part, i, j, k, ax .. cz) of the top within the tolerance at the nodes that stay out of the mesh.

    heights: kept cells with the heights of their corners, as ``mesh.corner_heights`` gives them; i and j of a triangle
    are of its block's first cell.
    """
    if tolerance < 0 or block < 2 or block & (block - 1):
        raise ValueError("no negative tolerance, and blocks of a power of two")
    corners = ["z00", "z01", "z10", "z11"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].to_numpy() - key[0] * block, rows["j"].to_numpy() - key[1] * block
        kept, z = np.zeros((block, block), bool), np.full((block + 1, block + 1), np.nan)
        kept[i, j] = True
        for c in corners:
            z[i + int(c[1]), j + int(c[2])] = rows[c].to_numpy()
        t = block_top(kept, z, tolerance)
        out = {"part": "top", "i": np.full(len(t), key[0] * block), "j": np.full(len(t), key[1] * block), "k": np.arange(len(t), dtype=np.int32)}
        for k, v in enumerate("abc"):
            y, x = t[:, k, 0], t[:, k, 1]
            out |= {f"{v}x": (x + key[1] * block) * float(step), f"{v}y": -(y + key[0] * block) * float(step), f"{v}z": z[y, x]}
        return pd.DataFrame(out)

    schema = "part string, i long, j long, k int, " + ", ".join(f"{c} double" for c in COORDS)
    rows = heights.select(F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj"), "i", "j", *corners)
    return rows.groupBy("bi", "bj").applyInPandas(run, schema)

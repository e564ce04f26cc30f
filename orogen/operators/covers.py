"""Flat bottoms of few triangles: cells covered by rectangles, each cut into a fan over the nodes that its neighbours need.

A rectangle is a row (i0, i1, j0, j1) of cells, bounds included.  Nodes that must stay are those of the mask's boundary,
where walls stand, and every rectangle's corners, so that neighbouring rectangles see the same nodes along a common side
and no crack or T-junction arises.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.operators.graph import connected_components
from orogen.operators.mesh import COORDS
from orogen.operators.morphology import balanced, quadtree, required_nodes
from orogen.shared import materialise


def graded_cover(cells: DataFrame, levels: int = 10) -> DataFrame:
    """Aligned squares of sides 2**k, of which those that share a side differ by a factor of two at most."""
    leaves = balanced(quadtree(cells, levels), levels)
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    return leaves.select((F.col("i") * side).alias("i0"), (F.col("i") * side + side - 1).alias("i1"), (F.col("j") * side).alias("j0"), (F.col("j") * side + side - 1).alias("j1"))


def runs(cells: DataFrame) -> DataFrame:
    """(i, a, b): the longest horizontal runs of cells."""
    g = F.col("j") - F.row_number().over(Window.partitionBy("i").orderBy("j"))
    return cells.withColumn("g", g).groupBy("i", "g").agg(F.min("j").cast("long").alias("a"), F.max("j").cast("long").alias("b")).select(F.col("i").cast("long").alias("i"), "a", "b")


def _extend(rows: pd.DataFrame, most: int | None) -> list[tuple[int, int, int, int]]:
    """Rectangles from a component's runs, from the top row down; what a rectangle takes from lower rows splits their runs."""
    free: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in rows.sort_values(["i", "a"])[["i", "a", "b"]].itertuples(index=False):
        free.setdefault(int(i), []).append((int(a), int(b)))
    out = []
    for i in sorted(free):
        for a, b in free.pop(i):
            step = most or b - a + 1
            for left in range(a, b + 1, step):
                right, last = min(left + step - 1, b), i
                while (own := free.get(last + 1)) is not None and (most is None or last - i + 1 < most):
                    k = bisect_right(own, (left, right + (1 << 62))) - 1
                    if k < 0 or own[k][1] < right:
                        break
                    lo, hi = own.pop(k)
                    own[k:k] = [x for x in ((lo, left - 1), (right + 1, hi)) if x[0] <= x[1]]
                    last += 1
                out.append((i, last, left, right))
    return out


def row_cover(cells: DataFrame, most: int | None = None) -> DataFrame:
    """Rectangles taken greedily row by row: each run, cut at ``most`` cells, goes down as long as all cells below are free.

    A rectangle lies within a side-connected component, so components are worked on apart, as runs and not as cells.
    """
    if most is not None and most < 1:
        raise ValueError("a cell or more")
    own = materialise(runs(cells).withColumn("id", F.xxhash64("i", "a")), "runs")
    # Runs of neighbouring rows share a side if they overlap; the end of either lies in the other.
    up = own.select((F.col("i") + 1).alias("i"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("id").alias("uid"))
    touch = own.join(up, "i").filter((F.col("ua") <= F.col("b")) & (F.col("a") <= F.col("ub"))).select(F.col("id").alias("a"), F.col("uid").alias("b"))
    of = connected_components(touch.unionByName(own.select(F.col("id").alias("a"), F.col("id").alias("b"))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_extend(rows, most), columns=["i0", "i1", "j0", "j1"], dtype="int64")

    return own.join(of, own["id"] == of["node"]).select("component", "i", own["a"], own["b"]).groupBy("component").applyInPandas(run, "i0 long, i1 long, j0 long, j1 long")


def fan(cells: DataFrame, rectangles: DataFrame, base: float, step: float = 1.0) -> DataFrame:
    """Triangles (part, i, j, k, ax .. cz) of the rectangles at -base, facing down; i and j are of a rectangle's first cell.

    A rectangle whose corners alone are needed is two triangles, any other a fan from its centre.
    """
    r = rectangles.select(*[F.col(c).cast("long").alias(c) for c in ("i0", "i1", "j0", "j1")])
    h, w = F.col("i1") - F.col("i0") + 1, F.col("j1") - F.col("j0") + 1
    # Clockwise seen from above: along the top eastwards, then down, back west, and up; p counts steps from the first corner.
    way = F.explode(F.sequence(F.lit(0).cast("long"), 2 * (h + w) - 1)).alias("p")
    ring = r.select("i0", "i1", "j0", "j1", h.alias("h"), w.alias("w"), way)
    p, hh, ww = F.col("p"), F.col("h"), F.col("w")
    ni = F.when(p <= ww, F.col("i0")).when(p <= ww + hh, F.col("i0") + p - ww).when(p <= 2 * ww + hh, F.col("i1") + 1).otherwise(F.col("i0") + 2 * (hh + ww) - p)
    nj = F.when(p <= ww, F.col("j0") + p).when(p <= ww + hh, F.col("j1") + 1).when(p <= 2 * ww + hh, F.col("j0") + 2 * ww + hh - p).otherwise(F.col("j0"))
    ring = ring.withColumn("ni", ni).withColumn("nj", nj)
    corner = r.select(F.explode(F.array(*[F.struct((F.col(a) + int(a == "i1")).alias("i"), (F.col(b) + int(b == "j1")).alias("j")) for a in ("i0", "i1") for b in ("j0", "j1")])).alias("n"))
    needed = required_nodes(cells).select(F.col("i").cast("long").alias("ni"), F.col("j").cast("long").alias("nj")).unionByName(corner.select(F.col("n.i").alias("ni"), F.col("n.j").alias("nj"))).distinct()
    ring = ring.join(needed, ["ni", "nj"])
    own = Window.partitionBy("i0", "j0")
    ring = ring.withColumn("n", F.count("*").over(own)).withColumn("first", F.first(F.struct("ni", "nj")).over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = own.orderBy("p")
    ring = ring.withColumn("next", F.coalesce(F.lead(F.struct("ni", "nj")).over(after), F.col("first"))).withColumn("k", (F.row_number().over(after) - 1).cast("int"))
    at = lambda i, j: (j.cast("double") * step, -i.cast("double") * step, F.lit(-float(base)))
    mid = at((F.col("i0") + F.col("i1") + 1) / 2, (F.col("j0") + F.col("j1") + 1) / 2)
    here, there, start = at(F.col("ni"), F.col("nj")), at(F.col("next.ni"), F.col("next.nj")), at(F.col("first.ni"), F.col("first.nj"))
    plain = F.col("n") == 4
    apex = tuple(F.when(plain, a).otherwise(b) for a, b in zip(start, mid, strict=True))
    rows = ring.filter(~plain | F.col("k").isin(1, 2))
    return rows.select(F.lit("bottom").alias("part"), F.col("i0").alias("i"), F.col("j0").alias("j"), "k", *[v.alias(n) for v, n in zip((*apex, *here, *there), COORDS, strict=True)])


def merged_bottom(cells: DataFrame, base: float, step: float = 1.0, cover: str = "graded", most: int | None = None) -> DataFrame:
    """The bottom of the cells in few triangles; cover: "graded" squares, or "rows" for greedy rectangles of at most ``most`` cells a side."""
    if cover not in ("graded", "rows"):
        raise ValueError(f"no cover {cover!r}")
    cells = materialise(cells, "cells")
    return fan(cells, materialise(graded_cover(cells) if cover == "graded" else row_cover(cells, most), "cover"), base, step)

"""Point clouds: filters, duplicates, gridding by cell, and scan statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE_CLASSES = (7, 18)
GROUND_CLASS = 2


@dataclass(frozen=True)
class Window:
    """A square window: west and north edges, cell size, cells across and down."""

    xmin: float
    ymax: float
    cell: float
    width: int
    height: int

    @staticmethod
    def around(cx: float, cy: float, radius: float, pixel: float, cell: float) -> Window:
        w = max(1, int((2 * radius + pixel / 2) / pixel))
        n = max(1, math.ceil(w * pixel / cell - 1e-9))
        return Window(cx - w * pixel / 2, cy + w * pixel / 2, cell, n, n)

    @property
    def ix(self) -> Column:
        return F.floor((F.col("x") - self.xmin) / self.cell)

    @property
    def iy(self) -> Column:
        return F.floor((self.ymax - F.col("y")) / self.cell)

    @property
    def box(self) -> Column:
        """Plain comparisons of x and y, which a columnar scan can use to skip row groups."""
        return F.col("x").between(self.xmin, self.xmin + self.cell * self.width) & F.col("y").between(self.ymax - self.cell * self.height, self.ymax)

    @property
    def inside(self) -> Column:
        return (self.ix >= 0) & (self.ix < self.width) & (self.iy >= 0) & (self.iy < self.height)


def usable(select: str = "ground") -> Column:
    """Finite, not withheld, not noise; "ground" keeps the ground class only."""
    z = F.col("z")
    ok = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")) & ~F.col("withheld") & ~F.col("cls").isin(*NOISE_CLASSES)
    return ok & (F.col("cls") == GROUND_CLASS) if select == "ground" else ok


def distinct_points(points: DataFrame) -> DataFrame:
    """Exact (x, y, z) duplicates are removed over the whole cloud."""
    return points.dropDuplicates(["x", "y", "z"])


def grid_points(points: DataFrame, window: Window, select: str = "ground") -> DataFrame:
    """(iy, ix, z, n): mean of ground points, or the lowest or highest usable point of each cell.

    One shuffle for the duplicates and one for partial sums, whose size is that of the occupied cells.
    """
    rows = distinct_points(points.filter(window.box & window.inside & usable(select)).select("x", "y", "z"))
    agg = {"ground": F.avg("z"), "lowest": F.min("z"), "highest": F.max("z")}[select]
    return rows.groupBy(window.iy.alias("iy"), window.ix.alias("ix")).agg(agg.alias("z"), F.count("*").alias("n"))


def top_classes(points: DataFrame, k: int) -> DataFrame:
    """The k most frequent classes; ties by class."""
    return points.groupBy("cls").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls").limit(k)


def scan_stats(points: DataFrame, window: Window, select: str = "ground") -> DataFrame:
    """Points read, in the window, dropped, used and duplicated, in one row."""
    inside, ok = window.box & window.inside, usable(select)
    rows = points.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.count_if(inside).alias("in_window"), F.count_if(inside & ok).alias("ok"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(s("n").alias("n_read"), s("in_window").alias("n_in_window"), s(F.col("in_window") - F.col("ok")).alias("n_dropped"), s(F.least("ok", F.lit(1))).alias("n_used"), s(F.col("ok") - F.least("ok", F.lit(1))).alias("n_duplicates"))


def density(cells: DataFrame, window: Window) -> DataFrame:
    """Occupied cells, their share, points per square unit and whether under half of the cells are occupied."""
    total, area = window.width * window.height, window.width * window.height * window.cell**2
    return cells.agg(
        F.count("*").alias("occupied"), (F.count("*") / F.lit(float(total))).alias("share"), (F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(area))).alias("density"), (F.count("*") * 2 < total).alias("sparse"),
    )


def prune_files(points: DataFrame, window: Window) -> DataFrame:
    """Files (with their box) that may have points in the window; the rest needn't be read."""
    box = points.groupBy("file").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    east, south = window.xmin + window.cell * window.width, window.ymax - window.cell * window.height
    return box.filter((F.col("x0") <= east) & (F.col("x1") >= window.xmin) & (F.col("y0") <= window.ymax) & (F.col("y1") >= south))

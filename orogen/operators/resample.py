"""Rasters (i, j, z) brought to another cell size: mean, bilinear and cubic, at any ratio.

The weights are products of one for the row and one for the column, and each is a function of two indices alone.  So a
source cell goes out to the few target cells that it weighs in, and sums over those combine on the map side; no
window around a target cell is ever gathered.

``ratio`` is the target's cell size in source cells, ``offset`` the distance of its first edge from the source's, in source
cells.  Cells without data carry no weight, and the other weights are taken relative to their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = {"average": 0.0, "bilinear": 1.0, "cubic": 2.0}


def _targets(source: str, ratio: float, offset: float, reach: float) -> Column:
    """The target indices that a source index may weigh in."""
    s = F.col(source)
    if reach == 0.0:
        low, high = F.floor((s - offset) / ratio), F.ceil((s + 1 - offset) / ratio) - 1
    else:
        # The centre of target t lies at (t + 1/2) * ratio + offset - 1/2 among the source's centres.
        low, high = F.ceil((s - reach + 0.5 - offset) / ratio - 0.5), F.floor((s + reach + 0.5 - offset) / ratio - 0.5)
    return F.when(high >= low, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _weight(target: str, source: str, ratio: float, offset: float, method: str) -> Column:
    t, s = F.col(target), F.col(source)
    if method == "average":
        low, high = t * ratio + offset, (t + 1) * ratio + offset
        return F.greatest(F.least(high, s + 1.0) - F.greatest(low, s.cast("double")), F.lit(0.0))
    d = F.abs((t + 0.5) * ratio + offset - 0.5 - s)
    if method == "bilinear":
        return F.greatest(1 - d, F.lit(0.0))
    near, far = (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2  # the convolution that passes through the values, slope -1/2
    return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)


def _summed(grid: DataFrame, ratio: float, offset: tuple[float, float], method: str) -> DataFrame:
    reach = SUPPORT[method]
    rows = grid.select("i", "j", "z", F.explode(_targets("i", ratio, offset[0], reach)).alias("ti"))
    rows = rows.select("i", "j", "z", "ti", F.explode(_targets("j", ratio, offset[1], reach)).alias("tj"))
    w = _weight("ti", "i", ratio, offset[0], method) * _weight("tj", "j", ratio, offset[1], method)
    rows = rows.withColumn("w", w).filter(F.col("w") != 0)
    known = F.col("z").isNotNull()
    return rows.groupBy(F.col("ti").alias("i"), F.col("tj").alias("j")).agg(
        F.sum(F.when(known, F.col("w") * F.col("z"))).alias("zw"), F.sum(F.when(known, F.col("w"))).alias("w"), F.count_if(~known).alias("n_missing"), F.sum("w").alias("whole"),
    )


def resample(grid: DataFrame, ratio: float, method: str, height: int, width: int, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(i, j, z) of the height x width target cells that some data weighs in.

    average: by shared area.  bilinear: between the four nearest centres.  cubic: over sixteen; where one of them is missing
    or outside, the bilinear value.  A target cell whose centre lies outside the source's cells that are there is left out
    by bilinear and cubic.
    """
    if method not in SUPPORT:
        raise ValueError(f"no method {method!r}")
    if not ratio > 0:
        raise ValueError("a positive ratio")
    inside = F.col("i").between(0, height - 1) & F.col("j").between(0, width - 1)
    flat = _summed(grid, ratio, offset, "average" if method == "average" else "bilinear").filter(inside & (F.col("w") > 1e-9))
    value = (F.col("zw") / F.col("w")).alias("z")
    if method == "average":
        return flat.select("i", "j", value)
    centre = lambda t, o: F.floor((F.col(t) + 0.5) * ratio + o).alias(t)
    flat = flat.select("i", "j", value, centre("i", offset[0]).alias("ci"), centre("j", offset[1]).alias("cj"))
    there = grid.select(F.col("i").cast("long").alias("ci"), F.col("j").cast("long").alias("cj"))
    flat = flat.join(there, ["ci", "cj"], "left_semi").select("i", "j", "z")
    if method == "bilinear":
        return flat
    # The sixteen weights sum to one just when all of them are there; some may be zero.
    full = _summed(grid, ratio, offset, "cubic").filter((F.col("n_missing") == 0) & (F.abs(F.col("whole") - 1) < 1e-9)).select("i", "j", (F.col("zw") / F.col("w")).alias("c"))
    return flat.join(full, ["i", "j"], "left").select("i", "j", F.coalesce("c", "z").alias("z"))

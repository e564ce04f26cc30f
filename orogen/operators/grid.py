"""Rasters as rows (i, j, z) with NULL for no data: windows, masks, overlays, resampling, filling, comparison, shading."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.operators.morphology import EIGHT, components, spread


def disc(ci: float, cj: float, r: float, rows: int | None = None) -> Column:
    """Closed disc about a grid position; one in every ``rows`` rows if given."""
    di, dj = (F.col("i") if rows is None else F.col("i") % rows) - F.lit(float(ci)), F.col("j") - F.lit(float(cj))
    return di * di + dj * dj <= F.lit(float(r * r))


def plausible(min_elevation: float = -50.0) -> Column:
    return F.col("z").isNotNull() & (F.col("z") > min_elevation)


def zone_counts(grid: DataFrame, zone: Column, min_elevation: float) -> DataFrame:
    """Cells of the zone: all, without data, too low, kept."""
    low = F.col("z").isNotNull() & (F.col("z") <= min_elevation)
    g = grid.filter(zone)
    return g.agg(F.count("*").alias("n_zone"), F.count_if(F.col("z").isNull()).alias("n_missing"), F.count_if(low).alias("n_low"), F.count_if(plausible(min_elevation)).alias("n_kept"))


def valid_stats(grid: DataFrame) -> DataFrame:
    return grid.agg(F.coalesce(F.bool_or(F.col("z").isNotNull()), F.lit(False)).alias("any_valid"), F.coalesce(F.bool_and(F.col("z") == 0), F.lit(False)).alias("all_zero"))


def disc_coverage(grid: DataFrame, zone: Column) -> DataFrame:
    return grid.filter(zone).agg(F.avg(F.col("z").isNotNull().cast("int").cast("double")).alias("coverage"))


def neighbour_stats(grid: DataFrame) -> DataFrame:
    """(i, j, n, low, high) over the valid cells among each cell's eight neighbours."""
    return spread(grid.filter(F.col("z").isNotNull()), EIGHT, "z").groupBy("i", "j").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


def despike(grid: DataFrame, tolerance: float, least: int = 5) -> DataFrame:
    """A cell beyond its valid neighbours by more than their spread and the tolerance loses its value; none does if the tolerance isn't positive."""
    if tolerance <= 0:
        return grid.select("i", "j", "z")
    near = neighbour_stats(grid)
    z, margin = F.col("z"), F.col("high") - F.col("low") + tolerance
    spike = (F.col("n") >= least) & ((z > F.col("high") + margin) | (z < F.col("low") - margin))
    return grid.join(near, ["i", "j"], "left").select("i", "j", F.when(~F.coalesce(spike, F.lit(False)), z).alias("z"))


def _along_rows(grid: DataFrame) -> DataFrame:
    """Cells with the nearest valid cells (j, z) of their own row: l west of them, o where they are, r east of them."""
    order = Window.partitionBy("i").orderBy("j")
    known = F.when(F.col("z").isNotNull(), F.struct("j", "z"))
    left = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(known, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return grid.withColumn("l", left).withColumn("o", known).withColumn("r", right).select("i", "j", "z", "l", "o", "r")


def _meet_rows(grid: DataFrame, radius: int) -> DataFrame:
    """Holes (hi, hj) with the nearest valid cells in each row within the radius: rows of (i, l, o, r).

    A hole goes out to the 2 * radius + 1 cells above and below it, which know their row; not to all cells around.
    """
    rows = _along_rows(grid)
    holes = rows.filter(F.col("z").isNull()).select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("di"))
    holes = holes.select("hi", "hj", (F.col("hi") + F.col("di")).alias("i"), F.col("hj").alias("j"))
    return holes.join(rows.select("i", "j", "l", "o", "r").filter("coalesce(l, o, r) is not null"), ["i", "j"])


def _candidates(met: DataFrame, radius: int) -> DataFrame:
    """(hi, hj, si, sj, z, d2) of the cells that _meet_rows found within the radius."""
    both = F.explode(F.array("l", "o", "r")).alias("s")
    rows = met.select("hi", "hj", F.col("i").alias("si"), both).filter("s is not null").select("hi", "hj", "si", F.col("s.j").alias("sj"), F.col("s.z").alias("z"))
    di, dj = F.col("si") - F.col("hi"), F.col("sj") - F.col("hj")
    return rows.withColumn("d2", (di * di + dj * dj).cast("long")).filter(F.col("d2") <= radius * radius)


def fill_nearest(grid: DataFrame, radius: int) -> DataFrame:
    """Holes take the value of the nearest valid cell within the radius; of equally near ones the first in (i, j) order."""
    near = _candidates(_meet_rows(grid, radius), radius)
    best = near.groupBy(F.col("hi").alias("i"), F.col("hj").alias("j")).agg(F.min_by("z", F.struct("d2", "si", "sj")).alias("f"))
    return grid.join(best, ["i", "j"], "left").select("i", "j", F.coalesce("z", "f").alias("z"))


def fill_idw(grid: DataFrame, radius: int) -> DataFrame:
    """Holes take the mean of the nearest valid cell of each quadrant within the radius, weighted by the inverse distance.

    Quadrants turn about the hole: north-west to the north and strictly west of it, north-east strictly north, and so on.
    Of equally near cells of a quadrant the first in (i, j) order counts.

    A tile of cells and what lies within the radius of it goes to one task, so that the shuffle follows the cells and not
    the holes times the radius; the tile grows with the radius, so that a cell goes to few tiles.
    """
    side = max(256, 2 * radius)
    near = lambda c: F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side))
    kinds = dict(grid.dtypes)
    cells = grid.select("i", "j", F.col("z").cast("double").alias("z"))
    tiles = cells.withColumn("ti", F.explode(near("i"))).withColumn("tj", F.explode(near("j")))

    def run(tile: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ti, tj = (int(x.as_py()) * side - radius for x in tile)
        at = rows["i"].to_numpy().astype(np.int64) - ti, rows["j"].to_numpy().astype(np.int64) - tj
        z = np.full((side + 2 * radius, side + 2 * radius), np.nan)
        known = rows["z"].is_valid().to_numpy()
        z[at[0][known], at[1][known]] = rows["z"].to_numpy(zero_copy_only=False)[known]
        held = np.zeros(z.shape, bool)
        held[at[0][known], at[1][known]] = True
        inner = ~known & (at[0] >= radius) & (at[0] < side + radius) & (at[1] >= radius) & (at[1] < side + radius)
        hi, hj = np.divmod(np.unique(at[0][inner] * z.shape[1] + at[1][inner]), z.shape[1])
        filled, found = _fill_holes(z, held, hi, hj, radius)
        return pa.table({"i": pa.array(hi[found] + ti, pa.int64()), "j": pa.array(hj[found] + tj, pa.int64()), "f": pa.array(filled[found])})

    filled = tiles.groupBy("ti", "tj").applyInArrow(run, "i long, j long, f double")
    filled = filled.select(F.col("i").cast(kinds["i"]).alias("i"), F.col("j").cast(kinds["j"]).alias("j"), "f")
    return grid.join(filled, ["i", "j"], "left").select("i", "j", F.coalesce("z", "f").alias("z"))


def _fill_holes(z: np.ndarray, held: np.ndarray, hi: np.ndarray, hj: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values for the holes (hi, hj) of a tile, all radius or more within its border, and whether there are any."""
    width, far = z.shape[1], np.int64(1) << 40
    column = np.arange(width)
    last = np.maximum.accumulate(np.where(held, column, -far), axis=1)  # the nearest held column up to here
    first = np.minimum.accumulate(np.where(held, column, far)[:, ::-1], axis=1)[:, ::-1]  # and from here
    up, down = range(-radius, 0), range(1, radius + 1)
    # A quadrant's rows and whether it looks west, in ascending order of rows; its own column belongs to the eastern one
    # above and to the western one below.
    total, weights = np.zeros(len(hi)), np.zeros(len(hi))
    for rows, west in (([*up, 0], True), (up, False), ([0, *down], False), (down, True)):
        best, value = np.full(len(hi), far), np.zeros(len(hi))
        for d in rows:
            r = hi + d
            c = (last if west else first)[r, hj]
            if d < 0 and west or d > 0 and not west:  # strictly beside the hole
                c = last[r, hj - 1] if west else first[r, hj + 1]
            d2 = np.where(np.abs(c) < far, (c - hj) ** 2 + d * d, far)
            nearer = (d2 < best) & (d2 <= radius * radius)
            best[nearer], value[nearer] = d2[nearer], z[r[nearer], c[nearer]]
        found = best < far
        w = 1.0 / np.sqrt(best[found].astype(np.float64))
        total[found] += value[found] * w
        weights[found] += w
    return total / np.where(weights > 0, weights, 1.0), weights > 0


def block_mean(grid: DataFrame, f: int) -> DataFrame:
    """Mean of the valid cells of f x f blocks; a block without any is NULL."""
    return grid.groupBy(F.floor(F.col("i") / f).alias("i"), F.floor(F.col("j") / f).alias("j")).agg(F.avg("z").alias("z"), F.count("z").alias("n_valid"))


def bilinear(grid: DataFrame, f: int) -> DataFrame:
    """Enlarged f times; cell centres between four known ones; NULL if any of the four is missing or outside."""
    corners = spread(grid, [(-a, -b) for a in (0, 1) for b in (0, 1)], "z").groupBy("i", "j").agg(
        F.max(F.when((F.col("di") == 0) & (F.col("dj") == 0), F.col("z"))).alias("z00"), F.max(F.when((F.col("di") == 0) & (F.col("dj") == -1), F.col("z"))).alias("z01"),
        F.max(F.when((F.col("di") == -1) & (F.col("dj") == 0), F.col("z"))).alias("z10"), F.max(F.when((F.col("di") == -1) & (F.col("dj") == -1), F.col("z"))).alias("z11"),
    )
    sub = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(f) for b in range(f)]))
    u, v = F.col("s.a") / F.lit(float(f)), F.col("s.b") / F.lit(float(f))
    z = F.col("z00") * (1 - u) * (1 - v) + F.col("z01") * (1 - u) * v + F.col("z10") * u * (1 - v) + F.col("z11") * u * v
    return corners.withColumn("s", sub).select((F.col("i") * f + F.col("s.a")).alias("i"), (F.col("j") * f + F.col("s.b")).alias("j"), z.alias("z")).filter("z is not null")


def overlay(*layers: DataFrame) -> DataFrame:
    """The last layer that has a value at a cell wins."""
    rows = None
    for k, layer in enumerate(layers):
        part = layer.select("i", "j", "z", F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("i", "j").agg(F.max_by("z", F.when(F.col("z").isNotNull(), F.col("k"))).alias("z"))


def compare(a: DataFrame, b: DataFrame, zone: Column) -> DataFrame:
    """Counts, relief of a, and statistics of b - a over the cells that both have, in one row."""
    rows = a.filter(zone).select("i", "j", F.col("z").alias("za")).join(b.filter(zone).select("i", "j", F.col("z").alias("zb")), ["i", "j"], "full")
    d, ad = F.col("zb") - F.col("za"), F.abs(F.col("zb") - F.col("za"))
    has_a, has_b = F.col("za").isNotNull(), F.col("zb").isNotNull()
    return rows.agg(
        F.count("*").alias("n_zone"), F.count_if(has_a).alias("n_a"), F.count_if(has_b).alias("n_b"), F.count_if(has_a & has_b).alias("n_both"), F.count_if(has_a & ~has_b).alias("only_a"), F.count_if(~has_a & has_b).alias("only_b"),
        (F.max("za") - F.min("za")).alias("relief_a"), F.avg(d).alias("mean"), F.round(F.stddev_pop(d), 9).alias("sd"), F.round(F.sqrt(F.avg(d * d)), 9).alias("rms"), F.avg(ad).alias("mean_abs"),
        F.percentile(ad, 0.95).alias("p95"), F.max(ad).alias("max_abs"), F.avg((ad > 1).cast("int").cast("double")).alias("over_1m"), F.avg((ad > 5).cast("int").cast("double")).alias("over_5m"),
    )


def secondary_fill(main: DataFrame, second: DataFrame, zone: Column | None = None, coverage: float = 0.999, common: int = 100, limit: float = 50.0) -> DataFrame:
    """Gaps of the main raster inside the zone (everywhere if None) take the second one's values plus the median difference.

    The difference is measured over the zone's cells that both have; with fewer than ``common`` of them it counts as 0.
    Nothing is filled if the main raster covers enough of the zone or if the difference is beyond the limit.
    """
    inside = F.lit(True) if zone is None else zone
    both = main.select("i", "j", F.col("z").alias("za"), inside.alias("in")).join(second.filter(inside).select("i", "j", F.col("z").alias("zb")), ["i", "j"], "left")
    own, d = F.col("in"), F.col("za") - F.col("zb")
    known = F.when(own, F.col("za").isNotNull().cast("int").cast("double"))
    s = both.agg(F.percentile(F.when(own, d), 0.5).alias("offset"), F.count(F.when(own, d)).alias("n"), F.avg(known).alias("share"))
    offset = F.when(F.col("n") >= common, F.col("offset")).otherwise(0.0)
    s = s.select(F.when((F.col("share") < coverage) & (F.abs(offset) <= limit), offset).alias("offset"))  # one row
    return both.join(F.broadcast(s)).select("i", "j", F.coalesce("za", F.when(own, F.col("zb") + F.col("offset"))).alias("z"))


def hillshade(grid: DataFrame, pixel: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Light in [0, 1] from central differences, one-sided at borders; NULL where a needed cell is missing."""
    cross = {"c": (0, 0), "e": (0, -1), "w": (0, 1), "s": (-1, 0), "n": (1, 0)}  # a cell reaches its neighbours by the opposite way
    own = lambda k: (F.col("di") == cross[k][0]) & (F.col("dj") == cross[k][1])
    near = spread(grid, list(cross.values()), "z").groupBy("i", "j").agg(
        *[F.max(F.when(own(k), F.col("z"))).alias(k) for k in cross], *[F.coalesce(F.bool_or(own(k)), F.lit(False)).alias(f"has_{k}") for k in cross]
    ).filter("has_c")

    def slope(before: str, after: str) -> Column:
        z, a, b = F.col("c"), F.col(before), F.col(after)
        return F.when(~F.col(f"has_{before}"), (b - z) / pixel).when(~F.col(f"has_{after}"), (z - a) / pixel).otherwise((b - a) / (2 * pixel))

    rows = near.withColumn("gx", slope("w", "e")).withColumn("gy", -slope("n", "s"))
    az, alt = math.radians(azimuth), math.radians(altitude)
    sx, sy, sz = math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt), math.sin(alt)
    light = (sz - F.col("gx") * sx - F.col("gy") * sy) / F.sqrt(F.lit(1.0) + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    lit = F.col("gx").isNotNull() & F.col("gy").isNotNull()
    return rows.select("i", "j", F.when(lit, F.round(F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)), 9)).alias("light"))


def distance(grid: DataFrame, limit: int) -> DataFrame:
    """(i, j, d2) for missing cells: squared distance to the nearest valid cell, within the limit."""
    near = _candidates(_meet_rows(grid, limit), limit)
    return near.groupBy(F.col("hi").alias("i"), F.col("hj").alias("j")).agg(F.min("d2").alias("d2"))


def closed_gaps(missing: DataFrame, height: int, width: int, d2: DataFrame, limit: int) -> DataFrame:
    """Missing cells whose component is a hole: all within the limit of data, and off the border or on it in two runs or more.

    Runs are along the border taken as a ring.
    """
    of = components(missing, width)
    i, j, h, w = F.col("i"), F.col("j"), height - 1, width - 1
    ring = F.when(i == 0, j).when(j == w, w + i).when(i == h, w + h + (w - j)).when(j == 0, 2 * w + h + (h - i))
    total = 2 * (w + h)
    edge = of.select("component", ring.alias("p")).filter("p is not null")
    ahead = edge.select("component", ((F.col("p") + 1) % total).alias("p"))
    ends = edge.join(ahead, ["component", "p"], "left_anti").groupBy("component").agg(F.count("*").alias("runs"))  # a run begins where the place before isn't the component's
    around = edge.select("component").distinct()
    reach = of.join(d2, ["i", "j"], "left").groupBy("component").agg(F.max(F.coalesce(F.col("d2"), F.lit(limit * limit + 1))).alias("far"))
    fine = reach.filter(F.col("far") <= limit * limit).join(around.join(ends, "component", "left").filter(F.coalesce("runs", F.lit(0)) < 2), "component", "left_anti")
    return of.join(fine.select("component"), "component", "left_semi").select("i", "j")

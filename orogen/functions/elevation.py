"""Column expressions of elevation values, units and print dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentinel_to_null(z: Column) -> Column:
    """Values no terrain has, and everything that isn't finite, are no data."""
    return F.when((z < -9000) | (z > 1e5) | F.isnan(z), F.lit(None)).otherwise(z)


def unpack(raw: Column, scale: float = 1.0, offset: float = 0.0, factor: float = 1.0, down: bool = False) -> Column:
    """Metres from a packed value: scale and offset, then the unit's factor, negative where depths are stored."""
    sign = -1.0 if down else 1.0
    return raw * F.lit(scale * factor * sign) + F.lit(offset * factor * sign)


def print_height(z: Column, low: Column, scale: float, exaggeration: float) -> Column:
    return (z - low) * F.lit(float(scale)) * F.lit(float(exaggeration))


def relief_stats(grid: DataFrame, scale: float, exaggeration: float, diameter: float) -> DataFrame:
    """Lowest, highest, relief in metres and print millimetres, its percentage of the diameter, and a suggested exaggeration."""
    lo, hi = F.col("min_m"), F.col("max_m")
    relief = F.greatest(hi - lo, F.lit(0.0))
    true = relief * scale
    return grid.agg(F.min("z").alias("min_m"), F.max("z").alias("max_m")).select(
        "min_m", "max_m", relief.alias("relief_m"), (true * exaggeration).alias("relief_mm"), (true * exaggeration * 100.0 / diameter).alias("percent"),
        F.when(true > 0, F.least(F.greatest(F.lit(0.225 * diameter) / true, F.lit(1.0)), F.lit(8.0))).alias("suggested"),
    )


class AltitudeCurve:
    """Monotone cubic through control points (altitude, equivalent altitude); beyond its ends it goes on with the mean slope
    of the end segment.  NaN stays NaN and NULL stays NULL."""

    def __init__(self, points: tuple[tuple[float, float], ...]):
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        if len(points) < 2 or not all(map(math.isfinite, xs + ys)) or any(b <= a for a, b in zip(xs, xs[1:])) or any(b < a for a, b in zip(ys, ys[1:])) or ys[0] == ys[-1]:
            raise ValueError("two finite points or more; altitudes must rise, equivalents must not fall, and not all be equal")
        self.xs, self.ys = xs, ys
        h = [b - a for a, b in zip(xs, xs[1:])]
        s = [(b - a) / k for a, b, k in zip(ys, ys[1:], h)]
        inner = [0.0 if s[k - 1] * s[k] <= 0 else 3 * (h[k - 1] + h[k]) / ((2 * h[k] + h[k - 1]) / s[k - 1] + (h[k] + 2 * h[k - 1]) / s[k]) for k in range(1, len(s))]

        def end(h0, h1, s0, s1):
            m = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            if m * s0 <= 0:
                return 0.0
            return 3 * s0 if s0 * s1 <= 0 and abs(m) > abs(3 * s0) else m

        self.slopes = [s[0], s[0]] if len(s) == 1 else [end(h[0], h[1], s[0], s[1]), *inner, end(h[-1], h[-2], s[-1], s[-2])]
        self.steps, self.secants = h, s

    def column(self, a: Column) -> Column:
        """The curve at an altitude, as one chain of conditions over the segments."""
        xs, ys, m, s = self.xs, self.ys, self.slopes, self.secants
        out = F.when(a < xs[0], F.lit(ys[0]) + F.lit(s[0]) * (a - xs[0])).when(a > xs[-1], F.lit(ys[-1]) + F.lit(s[-1]) * (a - xs[-1]))
        for k, h in enumerate(self.steps):
            t = (a - xs[k]) / h
            cubic = (1 + 2 * t) * (1 - t) * (1 - t) * ys[k] + t * (1 - t) * (1 - t) * (h * m[k]) + t * t * (3 - 2 * t) * ys[k + 1] + t * t * (t - 1) * (h * m[k + 1])
            out = out.when((a >= xs[k]) & (a <= xs[k + 1]), cubic)
        return out

    def segments(self, spark, exaggeration: float = 1.0) -> DataFrame:
        """(a0, a1, factor): the mean exaggeration between control points."""
        return spark.createDataFrame([(a, b, s * exaggeration) for a, b, s in zip(self.xs, self.xs[1:], self.secants)], "a0 double, a1 double, factor double")

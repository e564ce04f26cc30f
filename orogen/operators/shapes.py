"""Outlines: polygons by the even-odd rule and regular polygons with rounded corners."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BROADCAST_EDGES = 100_000


def edges(spark: SparkSession, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """(ring, x0, y0, x1, y1) of closed rings."""
    rows = [(k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1])]
    return spark.createDataFrame(rows, "ring int, x0 double, y0 double, x1 double, y1 double")


def polygon_mask(cells: DataFrame, outline: DataFrame) -> DataFrame:
    """Cells (i, j, x, y) inside by the even-odd rule; an edge counts for low <= y < high, a crossing for x at it or beyond.

    Crossings are found once per row of cells; a cell then counts those at or before it.
    """
    y = F.col("y")
    live = outline.filter("y0 <> y1").withColumn("lo", F.least("y0", "y1")).withColumn("hi", F.greatest("y0", "y1"))
    at = F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    few = live.count() <= BROADCAST_EDGES  # beyond, edges meet rows by whole units of y, and no row meets an edge elsewhere
    ys = cells.select("i", "y").distinct()
    if not few:
        unit = F.explode(F.sequence(F.floor("lo"), F.floor("hi"))).alias("unit")
        rows = ys.withColumn("unit", F.floor("y")).join(live.select("*", unit), "unit").filter((y >= F.col("lo")) & (y < F.col("hi"))).groupBy("i").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    else:
        rows = ys.join(F.broadcast(live), (y >= F.col("lo")) & (y < F.col("hi"))).groupBy("i").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    inside = F.size(F.filter("xs", lambda c: c <= F.col("x"))) % 2 == 1
    return cells.join(rows, "i").filter(inside).select("i", "j")


def outline_extent(outline: DataFrame) -> DataFrame:
    """Centre and half the larger side of the bounding box."""
    b = outline.agg(*[f(c).alias(f"{n}_{c}") for c in ("x0", "y0") for n, f in (("lo", F.min), ("hi", F.max))])
    w, h = F.col("hi_x0") - F.col("lo_x0"), F.col("hi_y0") - F.col("lo_y0")
    return b.select(((F.col("lo_x0") + F.col("hi_x0")) / 2).alias("cx"), ((F.col("lo_y0") + F.col("hi_y0")) / 2).alias("cy"), (F.greatest(w, h) / 2).alias("radius"))


MOST_SIDES = 360
MOST_ARC_SEGMENTS = 20_000
ON_OUTLINE = 1e-9  # relative: a point this near beyond the outline counts as on it


@dataclass(frozen=True)
class RoundedPolygon:
    """n equal sides about the origin, corners rounded with a radius; an odd n has a corner to the north, an even n a side.

    ``radius`` is that of the reference circle: through the corners (inscribed) or tangent to the sides (circumscribed).
    With a rounded reference an inscribed outline touches the circle with its arcs.  ``rotation`` is in degrees,
    anticlockwise.
    """

    n: int
    radius: float
    corner: float = 0.0
    rotation: float = 0.0
    mode: str = "inscribed"
    reference: str = "sharp"

    def __post_init__(self):
        if self.mode not in ("inscribed", "circumscribed") or self.reference not in ("sharp", "rounded"):
            raise ValueError("mode is inscribed or circumscribed, reference sharp or rounded")
        if isinstance(self.n, bool) or not isinstance(self.n, int) or not 3 <= self.n <= MOST_SIDES:
            raise ValueError(f"a whole number of sides from 3 to {MOST_SIDES}")
        if not all(map(math.isfinite, (self.radius, self.corner, self.rotation))) or self.radius <= 0 or self.corner < 0:
            raise ValueError("finite numbers, a positive radius, and no negative corner radius")
        if self.corner > self.largest_corner * (1 + ON_OUTLINE):
            raise ValueError(f"corners no rounder than {self.largest_corner:g}")

    @property
    def half_angle(self) -> float:
        return math.pi / self.n

    @property
    def _touches(self) -> bool:
        return self.mode == "inscribed" and self.reference == "rounded"

    @property
    def apothem(self) -> float:
        """From the centre to the middle of a side."""
        if self.mode == "circumscribed":
            return float(self.radius)
        free = self.corner if self._touches else 0.0
        return free + (self.radius - free) * math.cos(self.half_angle)

    @property
    def largest_corner(self) -> float:
        return float(self.radius) if self._touches else self.apothem

    @property
    def circumradius(self) -> float:
        return self.apothem / math.cos(self.half_angle)

    @property
    def side(self) -> float:
        return 2 * self.apothem * math.tan(self.half_angle)

    @property
    def flat(self) -> float:
        """What is straight of a side."""
        return 2 * self._inner * math.tan(self.half_angle)

    @property
    def _inner(self) -> float:
        return max(self.apothem - self.corner, 0.0)

    @property
    def fillet_distance(self) -> float:
        """From the centre to the centre of a corner's circle."""
        return self._inner / math.cos(self.half_angle)

    @property
    def extreme_radius(self) -> float:
        return self.fillet_distance + self.corner

    @property
    def area(self) -> float:
        t = math.tan(self.half_angle)
        return self.n * t * self._inner**2 + 2 * self.n * t * self._inner * self.corner + math.pi * self.corner**2

    @property
    def perimeter(self) -> float:
        return 2 * self.n * math.tan(self.half_angle) * self._inner + 2 * math.pi * self.corner

    @property
    def phase(self) -> float:
        """Direction of the first corner, anticlockwise from east."""
        return math.pi / 2 - (0.0 if self.n % 2 else self.half_angle) + math.radians(self.rotation)

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        """(west, east, south, north) of the outline."""
        ways = [self.phase + 2 * k * self.half_angle for k in range(self.n)]
        d, c = self.fillet_distance, self.corner
        xs, ys = [d * math.cos(w) for w in ways], [d * math.sin(w) for w in ways]
        return min(xs) - c, max(xs) + c, min(ys) - c, max(ys) + c

    @property
    def half_extent(self) -> float:
        """Half the side of the smallest square about the origin that holds the outline."""
        return max(map(abs, self.bbox))

    def scaled(self, k: float) -> RoundedPolygon:
        return replace(self, radius=self.radius * k, corner=self.corner * k)

    def arc_segments(self, tolerance: float) -> int:
        """Chords per corner whose greatest distance from the arc is at most the tolerance; 0 for sharp corners."""
        if self.corner <= 0:
            return 0
        if not (math.isfinite(tolerance) and tolerance > 0):
            raise ValueError("a positive tolerance")
        if tolerance >= self.corner:
            return 1
        # A chord over an angle t lies r * (1 - cos(t / 2)) = 2 * r * sin(t / 4) ** 2 inside its arc.
        k = max(1, math.ceil(2 * self.half_angle / (4 * math.asin(math.sqrt(tolerance / (2 * self.corner))))))
        if k > MOST_ARC_SEGMENTS:
            raise ValueError(f"{k} segments to a corner; at most {MOST_ARC_SEGMENTS}")
        return k

    def _from_corner(self, x: Column, y: Column) -> Column:
        """The angle from the direction of the nearest corner."""
        step, way = 2 * self.half_angle, F.atan2(y, x) - self.phase
        return way - F.rint(way / step) * step

    def _at_corner(self, along: Column, across: Column) -> Column:
        """Whether the corner's circle is the outline there; along from its centre outwards."""
        return (along * math.tan(self.half_angle) >= F.abs(across)) if self.corner else F.lit(False)

    def contains(self, x: Column, y: Column) -> Column:
        """Whether a point is inside or on the outline, to a relative 1e-9."""
        r, psi, h = F.hypot(x, y), self._from_corner(x, y), self.half_angle
        side = r * F.cos(F.lit(h) - F.abs(psi)) <= self.apothem * (1 + ON_OUTLINE)
        along, across = r * F.cos(psi) - self.fillet_distance, r * F.sin(psi)
        return side & (~self._at_corner(along, across) | (F.hypot(along, across) <= self.corner * (1 + ON_OUTLINE)))

    def reach(self, x: Column, y: Column) -> Column:
        """Distance from the centre to the outline in the direction of a point."""
        psi, d, c = self._from_corner(x, y), self.fillet_distance, self.corner
        straight = F.lit(self.apothem) / F.cos(F.lit(self.half_angle) - F.abs(psi))
        if not c:
            return straight
        under = c * c - (F.sin(psi) * d) * (F.sin(psi) * d)
        out = F.cos(psi) * d + F.sqrt(F.greatest(under, F.lit(0.0)))
        return F.when((under >= 0) & self._at_corner(out * F.cos(psi) - d, out * F.sin(psi)), out).otherwise(straight)

    def project(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The nearest point of the outline for points inside it; the one in the same direction for points outside."""
        r, psi, h, c = F.hypot(x, y), self._from_corner(x, y), self.half_angle, self.corner
        u, v = r * F.cos(psi), r * F.sin(psi)
        left = F.lit(self.apothem) - (u * math.cos(h) + F.abs(v) * math.sin(h))
        gu, gv = u + left * math.cos(h), v + left * F.when(v >= 0, math.sin(h)).otherwise(-math.sin(h))
        if c:
            along, across = u - self.fillet_distance, v
            far, corner = F.hypot(along, across), self._at_corner(along, across)
            gu = F.when(corner, self.fillet_distance + c * F.when(far > 0, along / far).otherwise(1.0)).otherwise(gu)
            gv = F.when(corner, c * F.when(far > 0, across / far).otherwise(0.0)).otherwise(gv)
        axis, way, inside = F.atan2(y, x) - psi, F.atan2(y, x), self.contains(x, y)
        px = F.when(inside, gu * F.cos(axis) - gv * F.sin(axis)).otherwise(self.reach(x, y) * F.cos(way))
        py = F.when(inside, gu * F.sin(axis) + gv * F.cos(axis)).otherwise(self.reach(x, y) * F.sin(way))
        return px, py

    def outline(self, spark: SparkSession, segments: int | None = None, tolerance: float | None = None) -> DataFrame:
        """(k, s, x, y): vertices anticlockwise; a rounded corner has ``segments`` chords, or as many as the tolerance asks.

        Where a side has no straight part, the end of one corner's arc is the next one's beginning and comes once.
        """
        if self.corner:
            segments = segments if segments is not None else self.arc_segments(tolerance)
            if segments < 1:
                raise ValueError("a segment per corner or more")
        last = 0 if not self.corner else segments - (self.flat <= 1e-12 * self.apothem)
        k, s = F.col("k"), F.col("s")
        rows = spark.range(self.n).select(F.col("id").cast("int").alias("k")).select("k", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("s"))
        way = F.lit(self.phase) + k * (2 * self.half_angle)
        turn = way + ((s / float(segments)) * 2 - 1) * self.half_angle if self.corner else way
        d, c = (self.fillet_distance, self.corner) if self.corner else (self.circumradius, 0.0)
        return rows.select("k", "s", (F.cos(way) * d + F.cos(turn) * c).alias("x"), (F.sin(way) * d + F.sin(turn) * c).alias("y"))

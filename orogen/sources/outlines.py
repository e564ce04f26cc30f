"""Outlines from GeoJSON, and gridded XYZ text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "file string, feature int, ring int, x0 double, y0 double, x1 double, y1 double"


def rings_of(geometry: dict | None) -> list[list[tuple[float, float]]]:
    """The rings of a GeoJSON geometry's polygons; other geometries have none."""
    kind = (geometry or {}).get("type")
    if kind == "GeometryCollection":
        return [r for g in geometry.get("geometries") or () for r in rings_of(g)]
    parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(kind, lambda c: [])(geometry.get("coordinates") or [] if geometry else [])
    out = []
    for polygon in parts:
        for ring in polygon:
            points = [(float(p[0]), float(p[1])) for p in ring]
            if points and points[0] == points[-1]:
                points.pop()
            if len(points) < 3:
                raise ValueError(f"a ring of {len(points)} points")
            out.append(points)
    return out


def _features(document: dict) -> list[dict]:
    kind = document.get("type")
    if kind == "FeatureCollection":
        return document.get("features") or []
    return [document] if kind == "Feature" else [{"type": "Feature", "properties": {}, "geometry": document}]


def read_outlines(spark: SparkSession, path: str, where: dict | None = None) -> DataFrame:
    """(file, feature, ring, x0, y0, x1, y1): the edges of the polygons in GeoJSON files, each ring closed.

    where: properties that a feature must have.  Features without polygons are passed over; a file that is no JSON, or none of
    whose features is left, is refused.  Together the rings count by the even-odd rule, so that parts must not overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = _features(json.loads(raw))
                    rows = [
                        (name, k, n, *a, *z)
                        for k, f in enumerate(found) if all((f.get("properties") or {}).get(c) == v for c, v in (where or {}).items())
                        for n, ring in enumerate(rings_of(f.get("geometry"))) for a, z in zip(ring, ring[1:] + ring[:1], strict=True)
                    ]
                except (ValueError, TypeError, AttributeError, IndexError, KeyError) as e:
                    raise ValueError(f"{name}: no usable GeoJSON ({e})") from e
                if not rows:
                    raise ValueError(f"{name}: no polygon")
                types = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in EDGES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, EDGES)


def degrees_extent(edges: DataFrame, metres: float = 111_320.0) -> DataFrame:
    """(lat, lon, radius) of an outline in degrees: the centre of its box, and half the box's larger side in metres."""
    b = edges.agg(F.min("x0").alias("w"), F.max("x0").alias("e"), F.min("y0").alias("s"), F.max("y0").alias("n"))
    lat = (F.col("s") + F.col("n")) / 2
    wide = (F.col("e") - F.col("w")) * metres * F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    return b.select(lat.alias("lat"), ((F.col("w") + F.col("e")) / 2).alias("lon"), (F.greatest(wide, (F.col("n") - F.col("s")) * metres) / 2).alias("radius"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of lines of three numbers, apart by blanks, commas or semicolons; a first line of names is passed over."""
    parts = F.filter(F.split(F.trim("value"), r"[\s,;]+"), lambda p: p != "")
    rows = spark.read.text(path).select("value", parts.alias("p")).filter(F.size("p") > 0)
    number = [F.get("p", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")]
    rows = rows.select("value", *number).filter(~(F.col("x").isNull() & F.col("y").isNull()))
    whole = F.assert_true(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), F.concat(F.lit("not a line of three numbers: "), "value")).isNull()
    return rows.filter(whole).select("x", "y", "z")


def gridded(rows: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(i, j, x, y, z) of points that lie on a regular grid, rows from the north; scattered points are refused.

    The step of an axis is the smallest one between its values; every value must lie on a whole number of steps.  Columns
    and rows are few beside cells: their values alone are sorted.
    """

    def axis(c: str) -> tuple[float, float, float]:
        from pyspark.sql import Window

        v = rows.select(c).distinct()
        part = v.select(c, F.floor(F.col(c) / 1e4).alias("g"))  # steps within spans of 10 km, so that no task sorts all values
        gap = part.select(c, (F.col(c) - F.lag(c).over(Window.partitionBy("g").orderBy(c))).alias("d"))
        r = gap.agg(F.min("d"), F.min(c), F.max(c)).first()
        return r[0] or 1.0, r[1], r[2]

    (dx, west, _), (dy, _, north) = axis("x"), axis("y")
    if west is None:
        raise ValueError("no points")
    j, i = (F.col("x") - west) / dx, (F.lit(north) - F.col("y")) / dy
    on = (F.abs(j - F.rint(j)) <= tolerance) & (F.abs(i - F.rint(i)) <= tolerance)
    cells = rows.select(F.rint(i).cast("long").alias("i"), F.rint(j).cast("long").alias("j"), "x", "y", "z", on.alias("on"))
    n = cells.agg(F.count_if(~F.col("on")).alias("off"), F.count("*").alias("n"), (F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w")).first()
    if n["off"] or n["n"] > n["h"] * n["w"] or (n["n"] < 0.5 * n["h"] * n["w"] and n["n"] > 1):
        raise ValueError(f"scattered points: {n['off']} of {n['n']} off a grid of {n['h']} x {n['w']}")
    return cells.drop("on")

"""Raster files: ESRI ASCII grids and SRTM tiles as rows (i, j, z), with NULL for no data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOID = -32768
SCHEMA = "file string, i int, j int, x double, y double, z double"


def _rows(name: str, z: np.ndarray, west: float, north: float, dx: float, dy: float) -> Iterator[pa.RecordBatch]:
    """Cell centres, some rows of the grid at a time."""
    h, w = z.shape
    step = max(1, (1 << 18) // w)
    for a in range(0, h, step):
        part = z[a : a + step]
        i, j = np.mgrid[a : a + len(part), 0:w].astype(np.int32)
        cols = [pa.array([name] * part.size), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(west + (j.ravel() + 0.5) * dx), pa.array(north - (i.ravel() + 0.5) * dy), pa.array(part.ravel(), from_pandas=True)]
        yield pa.record_batch(cols, names=["file", "i", "j", "x", "y", "z"])


def parse_asc(name: str, raw: bytes) -> tuple[np.ndarray, float, float, float, float]:
    """Values (NaN for no data), west and north edges, and the cell's sides; what doesn't fit is refused."""
    head: dict[str, str] = {}
    lines = raw.decode().splitlines()
    at = 0
    while at < len(lines) and (m := re.match(r"\s*([A-Za-z_]+)\s+(\S+)\s*$", lines[at])):
        head[m[1].lower()] = m[2]
        at += 1
    try:
        w, h = int(head["ncols"]), int(head["nrows"])
        dx, dy = float(head.get("dx", head.get("cellsize", "nan"))), float(head.get("dy", head.get("cellsize", "nan")))
        west = float(head["xllcorner"]) if "xllcorner" in head else float(head["xllcenter"]) - dx / 2
        south = float(head["yllcorner"]) if "yllcorner" in head else float(head["yllcenter"]) - dy / 2
    except (KeyError, ValueError) as e:
        raise ValueError(f"{name}: header without a usable {e}") from e
    if not (w > 0 and h > 0 and dx > 0 and dy > 0 and np.isfinite([dx, dy, west, south]).all()):
        raise ValueError(f"{name}: sizes must be positive and finite")
    z = np.array(" ".join(lines[at:]).split(), dtype=float)
    if z.size < w * h:
        raise ValueError(f"{name}: {z.size} values for {w} x {h} cells")
    z = z[: w * h].reshape(h, w)
    if "nodata_value" in head:
        z[z == float(head["nodata_value"])] = np.nan
    z[~np.isfinite(z)] = np.nan
    return z, west, south + h * dy, dx, dy


def parse_hgt(name: str, raw: bytes) -> tuple[np.ndarray, float, float, float, float]:
    """An SRTM tile: its name gives the south-west corner, its size the side of 1201 or 3601 nodes."""
    m = re.search(r"([NS])(\d{2})([EW])(\d{3})\.hgt$", name, re.IGNORECASE)
    side = {2 * 1201**2: 1201, 2 * 3601**2: 3601}.get(len(raw))
    if not m or not side:
        raise ValueError(f"{name}: not an SRTM tile")
    lat, lon = int(m[2]) * (1 if m[1].upper() == "N" else -1), int(m[4]) * (1 if m[3].upper() == "E" else -1)
    z = np.frombuffer(raw, ">i2").reshape(side, side).astype(float)
    z[z == VOID] = np.nan
    d = 1.0 / (side - 1)
    return z, lon - d / 2, lat + 1 + d / 2, d, d


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .asc and .hgt files of a path, a file per task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _rows(name, *(parse_hgt if name.lower().endswith(".hgt") else parse_asc)(name, raw))

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{asc,hgt}").load(path).select("path", "content").mapInArrow(run, SCHEMA)

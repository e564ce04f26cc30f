"""Grey pictures with transparency of a raster, as PNG."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators.grid import fill_nearest, hillshade

MOST_SIDE = 1024


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width: int, height: int, rows) -> bytes:
    """The file of 8-bit grey and opacity; rows: bytes of width pixels each, from the top."""
    squeeze = zlib.compressobj(6)
    body = b"".join(squeeze.compress(b"\0" + r) for r in rows) + squeeze.flush()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 4, 0, 0, 0)) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def render(grid: DataFrame, inside: DataFrame, pixel: float, exaggeration: float = 1.0, reduce: int = 1, reach: int = 2) -> DataFrame:
    """(i, j, grey, alpha) of blocks of reduce x reduce cells: the mean light of the cells inside, opaque where there is one.

    Cells outside take the nearest inside value within ``reach`` first, so that slopes at the border are those of the terrain.
    """
    own = inside.select("i", "j", F.lit(True).alias("in"))
    z = grid.join(own, ["i", "j"], "left").select("i", "j", F.when(F.col("in"), F.col("z") * exaggeration).alias("z"))
    light = hillshade(fill_nearest(z, reach), pixel).join(own, ["i", "j"], "left").withColumn("light", F.when(F.col("in"), F.col("light")))
    blocks = light.groupBy(F.floor(F.col("i") / reduce).alias("i"), F.floor(F.col("j") / reduce).alias("j")).agg(F.avg("light").alias("l"))
    grey = F.least(F.greatest(F.rint(F.col("l") * 255), F.lit(0.0)), F.lit(255.0))
    return blocks.select("i", "j", F.coalesce(grey, F.lit(0.0)).cast("int").alias("grey"), F.when(F.col("l").isNotNull(), 255).otherwise(0).alias("alpha"))


def write_png(pixels: DataFrame, path: str) -> tuple[int, int]:
    """One local PNG file of (i, j, grey, alpha), at most MOST_SIDE a side, which bounds what comes to the driver; (width, height)."""
    from orogen.sources.mesh_files import replaced

    size = pixels.agg((F.max("i") + 1).alias("h"), (F.max("j") + 1).alias("w")).first()
    h, w = int(size["h"] or 0), int(size["w"] or 0)
    if not 0 < max(h, w) <= MOST_SIDE:
        raise ValueError(f"{w} x {h} pixels; at most {MOST_SIDE} a side")
    held = bytearray(2 * w * h)
    for r in pixels.toLocalIterator():
        held[2 * (r["i"] * w + r["j"])], held[2 * (r["i"] * w + r["j"]) + 1] = r["grey"], r["alpha"]
    with replaced(path) as part, open(part, "wb") as out:
        out.write(png(w, h, (bytes(held[2 * w * k : 2 * w * (k + 1)]) for k in range(h))))
    return w, h

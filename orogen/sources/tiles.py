"""Tiles that overlap in an edge row or column, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mosaic_tiles(tiles: DataFrame) -> DataFrame:
    """One grid from tiles that share edges; a cell known to either tile is known."""
    return tiles.groupBy("i", "j").agg(F.max("z").alias("z"))


def missing_tiles(have: DataFrame) -> DataFrame:
    """(lat, lon) absent from the rectangle that the given tiles span."""
    box = have.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    every = box.select(F.explode(F.sequence("a", "b")).alias("lat"), "c", "d").select("lat", F.explode(F.sequence("c", "d")).alias("lon"))
    return every.join(have, ["lat", "lon"], "left_anti")

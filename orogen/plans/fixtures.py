"""Elevation stand-ins over the driver's tables, as DataFrames and as DuckDB common table expressions.

All coordinates and heights are dyadic rationals, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.tables import table

D = "double"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point cloud: x, y in [0, 64), z, class, withheld, the tax band standing for a file, and a line number."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (((F.col("l_partkey") * 7919 + F.col("l_linenumber") * 31) % 4096).cast(D) / 64.0).alias("x"),
        (((F.col("l_orderkey") * 104729 + F.col("l_suppkey") * 17) % 4096).cast(D) / 64.0).alias("y"),
        (F.floor("l_extendedprice").cast(D) / 64.0).alias("z"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") <= 5), 7).when((F.col("l_linenumber") == 6) & (F.col("l_quantity") <= 5), 18)
        .when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 5).otherwise(2).alias("cls"),
        (F.col("l_quantity") == 50).alias("withheld"),
        (F.col("l_suppkey") % 7).cast("int").alias("file"),
        F.col("l_linenumber").cast("int").alias("line"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells i (row, from the north), j, v, z, valid."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "e"))
    v = F.col("e").cast(D)
    k = F.floor(v * 4096)
    return t.select("i", "j", v.alias("v"), (k.cast(D) / 8.0 + 500.0).alias("z"), (F.pmod(k, F.lit(17)) != 0).alias("valid"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, z) with NULL where invalid."""
    return grid(spark, sf_dir).select("i", "j", F.when(F.col("valid"), F.col("z")).alias("z"))


def raster2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second raster over the same cells, shifted, with other gaps."""
    z = F.col("z") + 8.0 + F.pmod(F.col("i") * 3 + F.col("j") * 5, F.lit(7)).cast(D) / 8.0
    return grid(spark, sf_dir).select("i", "j", F.when((F.col("i") * 31 + F.col("j")) % 11 != 0, z).alias("z"))


def mask(spark: SparkSession, sf_dir: str, above: float = -0.15) -> DataFrame:
    """Nodes (i, j) whose value is above a threshold."""
    return grid(spark, sf_dir).filter(F.col("v") > above).select("i", "j")


WIDTH = 64
POINTS = """points AS (SELECT ((l_partkey*7919 + l_linenumber*31) % 4096)::DOUBLE / 64.0::DOUBLE AS x, ((l_orderkey*104729 + l_suppkey*17) % 4096)::DOUBLE / 64.0::DOUBLE AS y,
 floor(l_extendedprice)::DOUBLE / 64.0::DOUBLE AS z, CASE WHEN l_linenumber=7 AND l_quantity<=5 THEN 7 WHEN l_linenumber=6 AND l_quantity<=5 THEN 18 WHEN l_returnflag='N' THEN 1 WHEN l_returnflag='A' THEN 5 ELSE 2 END AS cls,
 l_quantity = 50 AS withheld, (l_suppkey % 7)::INT AS file, l_linenumber::INT AS line FROM lineitem)"""
GRID = """grid0 AS (SELECT vec_id AS i, unnest(range(len(embedding)))::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
grid AS MATERIALIZED (SELECT i, j, v, floor(v*4096)::BIGINT AS k, floor(v*4096)/8.0::DOUBLE + 500.0 AS z, ((floor(v*4096)::BIGINT % 17)+17)%17 <> 0 AS valid FROM grid0)"""
RASTER = GRID + ", raster AS (SELECT i, j, CASE WHEN valid THEN z END AS z FROM grid)"
RASTERS = RASTER + ", raster2 AS (SELECT i, j, CASE WHEN (i*31+j)%11 <> 0 THEN z + 8.0 + ((i*3+j*5)%7)::DOUBLE/8.0 END AS z FROM grid)"


def mask_sql(above: float = -0.15) -> str:
    return GRID + f", mask AS (SELECT i, j FROM grid WHERE v > ({above})::DOUBLE)"


NINE = "(SELECT di, dj FROM (VALUES (-1),(0),(1)) a(di), (VALUES (-1),(0),(1)) b(dj))"

"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps the components and pulls every node towards the smallest node it sees; a few steps suffice whatever the
diameter.  A step is a map-side-combined minimum and a join of the edges with one row per node, so that a hub only ever
makes one side of a join large, which adaptive execution splits.  Every round is written to the shared folder: its
lineage ends there, the round before is deleted, and nothing but two numbers comes to the driver.  The edges themselves
are computed once: the first table holds them, loops included, and all that follows reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.shared import drop_path, materialise, new_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v -> the same components with smaller neighbours."""
    e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else e.groupBy("u").agg(F.min("v").alias("m"))
    e = e.join(low, "u")
    if large:
        out = e.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = e.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges with the smallest node it is connected to; loops and nulls are ignored."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)[a]
    given = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "edges")
    loops, current = given.filter("u = v").select(F.col("u").alias("node")), given.filter("u <> v")
    before, path, lasting = None, None, False
    for _ in range(max_rounds):
        to = new_path(spark, "components")
        _star(_star(current, True), False).write.parquet(to)
        current = spark.read.schema(f"u {kind}, v {kind}").parquet(to)
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if path is not None:
            drop_path(spark, path)
        path = to
        if state == before or not state[0]:
            lasting = True
            break
        before = state
    if not lasting:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = members.select(F.col("component").alias("node")).unionByName(loops).distinct()
    return members.unionByName(roots.join(members.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))

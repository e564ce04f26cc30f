"""Reports as JSON: numbers that aren't finite become null, at any depth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = 1


def clean(value):
    """A value JSON can hold: mappings and sequences all through, text for keys, null for what isn't finite."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if hasattr(value, "tolist"):  # numpy's scalars and arrays
        return clean(value.tolist())
    return None if isinstance(value, float) and not math.isfinite(value) else value


def finite(c: Column) -> Column:
    """The number, or NULL if it isn't finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _struct(values: dict) -> Column:
    one = lambda v: _struct(v) if isinstance(v, dict) else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.struct(*[one(v).alias(k) for k, v in values.items()])


def mesh_report(tris: DataFrame, model: dict, **sections: dict) -> DataFrame:
    """(report): one JSON text of a mesh in one pass: its model, the relief of its top and its triangles by part; more sections
    come after, as they are."""
    part = lambda p: F.count_if(F.col("part") == p)
    z = [F.col(f"{v}z") for v in "abc"]
    top = F.col("part") == "top"
    n = tris.agg(*[part(p).alias(p) for p in ("top", "bottom", "wall")], F.count("*").alias("all"), F.min(F.when(top, F.least(*z))).alias("lo"), F.max(F.when(top, F.greatest(*z))).alias("hi"))
    relief = F.struct(finite(F.col("lo")).alias("min_elevation_m"), finite(F.col("hi")).alias("max_elevation_m"), finite(F.col("hi") - F.col("lo")).alias("relief_m"))
    mesh = F.struct("top", "bottom", "wall", F.col("all").alias("triangles"))
    more = [_struct(clean(v)).alias(k) for k, v in sections.items()]
    body = F.struct(F.lit(SCHEMA).alias("schema"), _struct(clean(model)).alias("model"), relief.alias("relief"), mesh.alias("mesh"), *more)
    return n.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))

"""An extension that suits Spark: cell aggregates of points as they arrive, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators.points import Window, usable


def stream_cells(points: DataFrame, window: Window, late: str = "10 minutes", width: str = "5 minutes", select: str = "all") -> DataFrame:
    """(window, iy, ix, lowest, highest, n) over a stream with a timestamp ``ts``; points later than ``late`` are left out."""
    rows = points.withWatermark("ts", late).filter(window.box & window.inside & usable(select))
    return rows.groupBy(F.window("ts", width).alias("window"), window.iy.alias("iy"), window.ix.alias("ix")).agg(F.min("z").alias("lowest"), F.max("z").alias("highest"), F.count("*").alias("n"))

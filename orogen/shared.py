"""Durable intermediate tables in the folder that all executors share.

A cluster names that folder in ``spark.checkpoint.dir``.  Only on one machine, a local master without the setting, is a
folder of our own made; it then holds for the whole application.  Tables stay until their user, who has stored what was made
of them, calls ``release``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash; makes checkpoint() usable as a side effect."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share on {master}")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="orogen-")
        named = _own[app]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and return the written table.

    The result has no lineage but the files, so a lost executor costs one read and never the work before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written so far; how many.  DataFrames that read them can't be used again."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_path(spark, path)
    return len(paths)

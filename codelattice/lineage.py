"""Cutting the lineage of iterative plans in a way that outlives executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


_MADE: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, partitioned: bool = False, packed: bool = False) -> DataFrame:
    """``df`` without its history: from a table in the shared folder, whose size the optimizer knows, so that small ones are broadcast.

    With ``partitioned`` from a reliable checkpoint, which keeps how its rows are partitioned.  Tables are deleted when the
    driver ends, or by ``clean``; checkpoints are Spark's to clean up.

    The optimizer takes a table for as large as its files.  With ``packed`` (ids, paths, code: up to 20 times as large in
    memory) it is told more, by a join with one row of about that many bytes: else it broadcasts what only looks small.
    """
    spark, folder = df.sparkSession, checkpoint_dir(df.sparkSession)
    if partitioned:
        return df.checkpoint(eager=True)
    path = f"{folder.rstrip('/')}/cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    if not packed:
        return table
    return table.crossJoin(F.broadcast(spark.sql("SELECT * FROM VALUES ('') AS t(__wide)"))).select(*df.columns)


@atexit.register
def clean() -> None:
    """Deletes all tables that ``cut`` made; DataFrames that still read them fail afterwards."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone: its folder is somebody else's to clean
            continue

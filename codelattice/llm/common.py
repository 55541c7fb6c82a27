"""What the operators of this package share: tables, checkpoints and small helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark has unless somebody sets it, and what batches of long texts need: both sides of a Python worker's pipe hold several batches at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of documents become smaller, unless the session has a size of its own."""
    for key, (default, small) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which an idle worker gives the memory that it no longer uses back to the system."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores appended until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder, which outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder and read again: columns stay separately readable."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.table_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Up to this many rows of ids (16 bytes each in a hash table of longs) are broadcast; more are merged by their keys.
BROADCAST_ROWS = 500_000


def counted(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side ``ids`` of a join: broadcast if a count proves it small, otherwise for a merge join."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids.hint("merge")


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``; both tables ought to be written. Texts are only shuffled where the ids are too many to broadcast."""
    (name,) = unused(docs, "__drop_id")
    return docs.join(counted(ids.toDF(name)), F.col(id_col).cast("long") == F.col(name), "left_anti")

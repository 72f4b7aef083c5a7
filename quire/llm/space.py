"""Shared folder for intermediate tables, and the input tables.

On a cluster, ``spark.checkpoint.dir`` names a folder that the driver and all executors share; intermediate results go
there, so that a lost executor costs nothing that has been written. Where the setting is missing, a local session (tests)
gets a local folder in its place; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most.
BATCH_ROWS = 1000
#: Rows of a file of a table whose size is known, and files of it at least.
FILE_ROWS, LEAST_FILES = 500_000, 8
#: Folders of the tables that ``cut`` wrote.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; set here only if the session has none and is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quire-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, done: tuple[DataFrame, ...] = (), rows: int | None = None, sorted_joins: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again: its lineage ends there.

    ``rows``: how many rows it has at most, if that is known and they are small. They are then written in as many files as
    they need, and not one for each partition: most of these tables are small in most corpora.
    ``done`` are tables that an earlier call wrote and that nothing reads once ``df`` is written: their files are deleted.
    ``sorted_joins``: see ``cut_large``.
    The driver's garbage is collected then, for Spark deletes the shuffle files of ended jobs only with their objects.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_dir(spark, name)
    (df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))).write.parquet(path)
    drop(*done)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out = out.hint("merge") if sorted_joins else out
    _WRITTEN[out] = path
    return out


def cut_large(df: DataFrame, name: str, done: tuple[DataFrame, ...] = (), rows: int | None = None) -> DataFrame:
    """``cut`` for tables that grow with the input: joins with them sort both sides at every size.

    Spark sizes a table by its compressed files, an array as one element and an explode as its input. Left alone, it sends
    tables through the driver that take ten times the memory that it sees in them, or more.
    """
    return cut(df, name, done, rows, sorted_joins=True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            jvm = table.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send at most BATCH_ROWS rows at a time to Python workers: texts may be long, and both sides hold a whole batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of ``docs``, and the columns in ``more``; others may have any name."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)

"""Intermediate results that several parts of one result read: computed once, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder for this session's results, in ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own; on a cluster it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="quire-stages-"))
    return context.getCheckpointDir()


#: Rows that a Python worker gets at a time: it holds their texts, and lists made of each, as Python objects.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Send at most BATCH_ROWS rows at a time to Python workers, from now on in this session; their memory then doesn't grow with a table."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all shuffle partitions of the session, before a step that makes many rows, or much work, of each.

    Spark joins small partitions by the bytes that it shuffles, which are those before such a step: one task would get it all.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed now and read from ``spark.checkpoint.dir`` from then on; Spark keeps its partitioning, and may delete the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

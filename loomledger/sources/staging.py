"""Tables and files that a step leaves for the next one, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; below /tmp only where it is unset and the master is local. It goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run-{uuid.uuid4().hex}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return where.toString()


def staged(df: DataFrame) -> DataFrame:
    """`df` written as a table and read again: what comes after is neither computed twice nor lost with an executor."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 1_000_000) -> DataFrame:
    """`df` by the hash of its keys over tasks of some `rows` rows: as many as it needs, whatever number of shuffle partitions the session has, and not merged again. What a task sorts and groups doesn't grow with the table."""
    n = df.count()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows)), *keys)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, *order: str, name: str = "sequence_number") -> DataFrame:
    """`df` with the place of each row in the whole order, from 0.

    Rows are dealt by ranges of the order and sorted there; a place is that in the range, shifted by the sizes of the ranges before: no task holds them all. The ranges are drawn once and kept as a table, so that rows which are computed again have the same places.
    """
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    # a row for each range
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_shift", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_shift")).alias(name))

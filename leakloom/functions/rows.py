"""Rows from arrays, and tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """A row for each element that isn't null, as column name; the array is worked out once.

    A plain explode has Spark infer that the array isn't empty, and push that filter with the array's whole expression
    below the projection that works it out.
    """
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; only a local session may lack that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/leakloom/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that what follows repeats none of its work."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table with fewer bytes than a split for each core evenly over the cores; a larger one stays as it is.

    Files that are one row group are one task however many cores there are, and patterns take far longer than reading.
    A stream stays as it is too.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * split else df

"""Places of rows within groups of any size: no task ever takes a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import materialised


def ranked(df: DataFrame, order: tuple[str, ...], keys: tuple[str, ...] = (), name: str = "n") -> DataFrame:
    """df with each row's place, from 1, within its keys (of all rows if there are none) by order.

    Rows are dealt by ranges of keys and order and written once with the range they are in, so that a task that runs
    again deals no row anew. Places within a range are raised by the counts of the ranges before. Of each range one key
    at most goes on from the range before, so the table of those counts has no more rows than there are ranges, and is
    broadcast. The order should tell rows apart; equal rows may stand either way round. Nulls come first.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    rows = materialised(dealt, "ranked")
    within = Window.partitionBy("__range", *keys).orderBy("__at")
    sizes = rows.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__size")
    later = sizes.withColumn("__before", before).where(F.col("__before") > 0).select(F.col("__range").alias("__r"), *(F.col(k).alias(f"__k_{k}") for k in keys), "__before")
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = rows.withColumn(name, F.row_number().over(within)).join(F.broadcast(later), same, "left")
    return out.select(*df.columns, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("long").alias(name))

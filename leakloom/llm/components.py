"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: A round's table has about so many edges in a file.
EDGES_PER_FILE = 500_000


def _least(directed: DataFrame) -> DataFrame:
    return directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label of every node of the edges (a, b): label is the least node that its links reach.

    Each round hangs nodes on smaller ones and is written to the shared folder; rounds grow with the logarithm of the
    longest chain. Sums are partial before the shuffle, and a hub's rows join on the hub alone, which adaptive
    execution splits. An edge of a node to itself keeps that node.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    files = 1 + now.count() // EDGES_PER_FILE
    last = None
    while True:
        both = now.union(now.select("b", "a")).where("a <> b")
        stars = both.join(_least(both), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(stars.union(now.where("a = b")).distinct().coalesce(files), name)
        least = _least(large)
        hung = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialise(hung.distinct().coalesce(files), name)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))

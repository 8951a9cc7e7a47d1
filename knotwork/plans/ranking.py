"""Positions in a total order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.plans.lineage import keep


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with 0, 1, ... by a total order: range-partitioned, numbered inside each part, and moved on by the parts before."""
    ranged = df.repartitionByRange(*(F.col(c) for c in order)).withColumn("_part", F.spark_partition_id())
    ranged, _ = keep(ranged.withColumn("_inside", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1), "ranked")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row a partition
    before, run = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        before.append((r["_part"], run))
        run += r.n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")

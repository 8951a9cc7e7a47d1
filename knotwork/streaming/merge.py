"""Merges over a stream of triples: the state is one row a group, and batches fold into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_stream(triples: DataFrame) -> DataFrame:
    """The merge by (head, tail) as a streaming aggregate, for update or complete mode."""
    return triples.groupBy("head", "tail").agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("relation", "head_type", "tail_type")), F.min("seq").alias("first_seen"))


def relation_counts(triples: DataFrame, event_time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Relations by event-time window; rows later than the watermark are dropped."""
    return triples.withWatermark(event_time, late).groupBy(F.window(event_time, window), "relation").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "relation", "n")


def fold(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two merged tables as one; merging is associative, so any grouping of batches gives the same."""
    both = old.unionByName(new)
    return both.groupBy("head", "tail").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("relation", "head_type", "tail_type")), F.min("first_seen").alias("first_seen"))

"""Histograms, top-k, filters and summaries of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import matches
from knotwork.plans.schema import UNKNOWN


def relation_histogram(triples: DataFrame) -> DataFrame:
    """(relation, n, first_seen); a missing relation counts as unknown."""
    return triples.groupBy(F.coalesce("relation", F.lit(UNKNOWN)).alias("relation")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seen"))


def type_histogram(triples: DataFrame) -> DataFrame:
    """(entity_type, n, first_seen) over heads and tails; the head's type comes before the tail's."""
    ends = F.posexplode(F.array(F.coalesce("head_type", F.lit(UNKNOWN)), F.coalesce("tail_type", F.lit(UNKNOWN)))).alias("side", "entity_type")
    return triples.select("seq", ends).groupBy("entity_type").agg(F.count("*").alias("n"), F.min(F.col("seq") * 2 + F.col("side")).alias("first_seen"))


def top(histogram: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent, ties by first occurrence, then name."""
    return histogram.orderBy(F.desc("n"), "first_seen", key).limit(k).select(key, "n")


def filter_triples(triples: DataFrame, **patterns: str) -> DataFrame:
    """Rows whose columns match all given patterns (regular expressions, any case, anywhere); null matches nothing."""
    for column, pattern in patterns.items():
        if pattern:
            triples = triples.where(matches(F.col(column), pattern))
    return triples


def extraction_summary(triples: DataFrame) -> DataFrame:
    """One row: triples, distinct relations and types, and their sorted lists; a missing field counts as an empty value."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    sets = triples.select(empty("relation").alias("r"), F.array(empty("head_type"), empty("tail_type")).alias("t")).agg(
        F.count("*").alias("n_triples"), F.array_sort(F.collect_set("r")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("t")))).alias("t")
    )
    return sets.select("n_triples", F.size("r").cast("long").alias("n_relations"), F.size("t").cast("long").alias("n_types"), F.array_join("r", ", ").alias("relations"), F.array_join("t", ", ").alias("types"))

"""The three merges of triples, and their statistics.

One group-by each, combined map-side. Values are sorted sets as arrays; `joined` gives the files' form. Order of first occurrence is kept as first_seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import join_values


def _set(c: str) -> Column:
    return F.array_sort(F.collect_set(c)).alias(c)


def entity_occurrences(triples: DataFrame) -> DataFrame:
    """(entity, entity_type) for both ends of each triple, in one pass."""
    ends = F.explode(F.array(F.struct(F.col("head").alias("entity"), F.col("head_type").alias("entity_type")), F.struct(F.col("tail").alias("entity"), F.col("tail_type").alias("entity_type")))).alias("e")
    return triples.select(ends).select("e.entity", "e.entity_type")


def merge_entity_types(triples: DataFrame) -> DataFrame:
    """entity, entity_type (array): all types of each entity that has any. An empty type is a type; null is none."""
    typed = entity_occurrences(triples).where("entity is not null and entity_type is not null")
    return typed.groupBy("entity").agg(_set("entity_type"))


def merge_relations_and_types(triples: DataFrame) -> DataFrame:
    """By (head, tail): relation, head_type, tail_type as sorted sets, first_seen."""
    return triples.groupBy("head", "tail").agg(_set("relation"), _set("head_type"), _set("tail_type"), F.min("seq").alias("first_seen"))


def merge_values(triples: DataFrame, *values: str) -> DataFrame:
    """By (head, tail): the given columns as sorted sets; merge_relations_and_types() for triples that have no others."""
    return triples.groupBy("head", "tail").agg(*(_set(c) for c in values))


def merge_relations(merged: DataFrame) -> DataFrame:
    """By (head, tail): relation, first_seen; a projection of merge_relations_and_types()."""
    return merged.select("head", "tail", "relation", "first_seen")


def joined(merged: DataFrame, *columns: str) -> DataFrame:
    """Arrays as joined strings; an empty set becomes null, which a JSON sink leaves out."""
    return merged.select(*(join_values(F.col(c)).alias(c) if c in columns else F.col(c) for c in merged.columns))


def merge_statistics(triples: DataFrame) -> DataFrame:
    """One row: rows before, and after each merge, with the arrows."""
    kind = lambda name, given, a, b: F.when(given, F.struct(F.lit(name).alias("kind"), a.alias("a"), b.alias("b")))
    head, tail, none = F.col("head"), F.col("tail"), F.lit(None).cast("string")
    # one pass: every row gives its pair and its typed ends, which are counted by key
    keys = F.array(kind("pair", F.lit(True), head, tail), kind("entity", F.col("head_type").isNotNull(), head, none), kind("entity", F.col("tail_type").isNotNull(), tail, none))
    counted = triples.select(F.explode(keys).alias("k")).where("k is not null").select("k.*").groupBy("kind", "a", "b").agg(F.count("*").alias("times"))
    count = lambda cond: F.count(F.when(F.expr(cond), 1))
    one = counted.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "pair", F.col("times"))), F.lit(0)).alias("total_original_records"), count("kind = 'pair' and a is not null and b is not null").alias("n"), count("kind = 'entity' and a is not null").alias("entities")
    )
    arrow = lambda c: F.concat_ws(" -> ", F.col("total_original_records").cast("string"), F.col(c).cast("string"))
    return one.select(
        "total_original_records", F.col("entities").alias("entity_types_count"), F.col("n").alias("relations_count"), F.col("n").alias("relations_and_types_count"),
        arrow("entities").alias("entity_types_reduction"), arrow("n").alias("relations_reduction"), arrow("n").alias("relations_and_types_reduction"),
    )


def first_rows(merged: DataFrame, n: int = 3) -> DataFrame:
    """The first n merged rows in order of first occurrence."""
    return merged.orderBy("first_seen", "head", "tail").limit(n)

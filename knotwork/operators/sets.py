"""Set algebra over the triples of several sources. A missing field counts as an empty string."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.functions.text import preview
from knotwork.plans.schema import or_empty

KEY = ("head", "relation", "tail")


def triple_sets(triples: DataFrame) -> DataFrame:
    """Distinct (source, head, relation, tail)."""
    return triples.select("source", *(or_empty(c) for c in KEY)).distinct()


def memberships(sets: DataFrame) -> DataFrame:
    """For each triple the sorted array of sources that have it; one shuffle, from which all overlaps follow."""
    return sets.groupBy(*KEY).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def pairwise_intersections(sets: DataFrame) -> DataFrame:
    """(source_a, source_b, head, relation, tail) for every pair of sources and each triple in both."""
    a = F.explode("sources").alias("source_a")
    return memberships(sets).where("size(sources) > 1").select(*KEY, "sources", a).select("source_a", F.explode(F.filter("sources", lambda b: b > F.col("source_a"))).alias("source_b"), *KEY)


def three_way_intersection(sets: DataFrame) -> DataFrame:
    """The triples in all sources, if there are exactly three sources; else nothing."""
    three = sets.agg(F.count_distinct("source").alias("n_sources"))
    return memberships(sets).where("size(sources) = 3").crossJoin(F.broadcast(three)).where("n_sources = 3").select(*KEY)


def overlap_matrix(sets: DataFrame) -> DataFrame:
    """(source_a, source_b, n) for all pairs; the diagonal has each source's own size. The grid of sources is as small as their number squared."""
    both = memberships(sets).select(F.col("sources"), F.explode("sources").alias("source_a")).select("source_a", F.explode("sources").alias("source_b"))
    counts = both.groupBy("source_a", "source_b").count()
    names = sets.select("source").distinct()
    grid = names.toDF("source_a").crossJoin(names.toDF("source_b"))
    return grid.join(counts, ["source_a", "source_b"], "left").select("source_a", "source_b", F.coalesce("count", F.lit(0)).alias("n"))


def exclusive_intersections(members: DataFrame, item: str, source: str = "source", sample: int = 20) -> DataFrame:
    """For each exact combination of sources: how many items are in just these, and the first of them. members has (item, source), repeats allowed.

    A combination's sample is kept by the least items alone, never the whole list.
    """
    named = members.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.array_join(F.array_sort(F.collect_set(source)), " & ").alias("combination"))
    counts = named.groupBy("combination").agg(F.count("*").alias("n"))
    ranked = named.withColumn("k", F.row_number().over(W.partitionBy("combination").orderBy("item"))).where(f"k <= {sample + 1}")
    heads = ranked.groupBy("combination").agg(preview(F.array_sort(F.collect_list("item")), sample).alias("sample"))
    return counts.join(heads, "combination").orderBy(F.desc("n"), "combination")


def rows_per_source(triples: DataFrame) -> DataFrame:
    return triples.groupBy("source").agg(F.count("*").alias("n"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b hasn't."""
    return a.subtract(b)


def source_pairs(names: list[str]) -> list[tuple[str, str]]:
    return list(combinations(sorted(set(names)), 2))

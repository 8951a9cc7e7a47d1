"""How well a merge did: reduction, distributions, multi-valued records, complexity, coverage.

Merged tables come with arrays. `reread` gives them as the files' readers see them: joined and split again, where a value that holds the joiner falls in two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import join_values, split_values


def reread(merged: DataFrame, *columns: str) -> DataFrame:
    return merged.select(*(split_values(join_values(F.col(c))).alias(c) if c in columns else F.col(c) for c in merged.columns))


def reduction_efficiency(statistics: DataFrame) -> DataFrame:
    """Per merge, by how many percent rows became fewer; 0 where there were none."""
    total = F.col("total_original_records")
    percent = lambda c: F.when(total > 0, F.round((1 - F.col(c) / total) * 100, 2)).otherwise(0.0)
    return statistics.select(percent("entity_types_count").alias("entity_reduction"), percent("relations_count").alias("relation_reduction"), percent("relations_and_types_count").alias("full_reduction"))


def value_distribution(merged: DataFrame, column: str) -> DataFrame:
    """(value, n): in how many records each value of an array column is."""
    return merged.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def multi_valued(merged: DataFrame, column: str) -> DataFrame:
    """Records with more than one value, and how many."""
    return merged.where(F.size(column) > 1).withColumn("n", F.size(column).cast("long"))


def type_combinations(merged: DataFrame) -> DataFrame:
    """(combination, n): head type -> tail type over each record's types; N/A for none."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("N/A")))
    pairs = merged.select(F.explode(some("head_type")).alias("h"), some("tail_type").alias("t")).select("h", F.explode("t").alias("t"))
    return pairs.groupBy(F.concat_ws(" → ", "h", "t").alias("combination")).agg(F.count("*").alias("n"))


def complex_records(merged: DataFrame, above: int = 5) -> DataFrame:
    """Records by how many types and relations they hold, most first; an empty set counts one, as an empty string splits into one part."""
    parts = lambda c: F.greatest(F.size(c), F.lit(1))
    scored = merged.withColumn("complexity", (parts("head_type") + parts("tail_type") + parts("relation")).cast("long"))
    return scored.where(F.col("complexity") > above).orderBy(F.desc("complexity"), "head", "tail")


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array(F.coalesce("head", F.lit("")), F.coalesce("tail", F.lit("")))).alias("entity")).distinct()


def coverage(triples: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: percent of the original's entities, relations and triples that the merged table (arrays) still has, and counts. Each table is read once; a missing field counts as empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = F.lit(None).cast("string")
    key = lambda kind, a, b=none, c=none: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    head, tail, relation = (empty(c) for c in ("head", "tail", "relation"))
    was = triples.select(F.explode(F.array(key("entity", head), key("entity", tail), key("relation", relation), key("triple", head, relation, tail))).alias("k"), F.lit(True).alias("was"), F.lit(False).alias("now"))
    each = lambda of: F.transform("relation", of)
    kept = F.flatten(F.array(F.array(key("entity", head), key("entity", tail)), each(lambda r: key("relation", r)), each(lambda r: key("triple", head, r, tail))))
    now = merged.select(F.explode(kept).alias("k"), F.lit(False).alias("was"), F.lit(True).alias("now"))
    keys = was.unionByName(now).select("k.*", "was", "now").groupBy("kind", "a", "b", "c").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    n = lambda cond: F.count(F.when(F.expr(cond), 1))
    share = lambda kind: F.when(n(f"kind = '{kind}' and was") > 0, F.round(n(f"kind = '{kind}' and was and now") * 100 / n(f"kind = '{kind}' and was"), 4)).otherwise(0.0)
    return keys.agg(
        *(share(k).alias(f"{k}_coverage") for k in ("entity", "relation", "triple")),
        *(n(f"kind = '{k}' and {s}").alias(f"{name}_{k}_count") for k in ("entity", "relation") for s, name in (("was", "original"), ("now", "merged"))),
    )


def lost(triples: DataFrame, merged: DataFrame) -> DataFrame:
    """Entities that the merged table hasn't any more."""
    return entities(triples).subtract(entities(merged))


def new(triples: DataFrame, merged: DataFrame) -> DataFrame:
    """Entities that only the merged table has."""
    return entities(merged).subtract(entities(triples))


def first_entities(found: DataFrame, n: int = 20) -> DataFrame:
    """One row: how many entities there are, and the first n of them."""
    head = found.orderBy("entity").limit(n).agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    return found.agg(F.count("*").alias("n")).join(head)


def typed_relations(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Merged relations with the joined types of both ends; empty where an entity has none. types has one row an entity."""
    named = types.select("entity", join_values(F.col("entity_type")).alias("t"))
    both = relations.join(named.toDF("head", "head_type"), "head", "left").join(named.toDF("tail", "tail_type"), "tail", "left")
    return both.select("head", F.coalesce("head_type", F.lit("")).alias("head_type"), F.array_join("relation", ", ").alias("relation"), "tail", F.coalesce("tail_type", F.lit("")).alias("tail_type"))

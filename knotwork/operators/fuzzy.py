"""Fuzzy entity clusters, and the relations that members of one cluster disagree on.

Similar pairs come from a lossless filter at every threshold, not from comparing all. Two strings with an Indel ratio of t differ by at most d = (100 - t) / 100 * (|a| + |b|)
insertions and deletions, each of which changes at most two bigrams; so if the longer one has more than 2d bigrams, among the 2d + 1 rarest bigrams of one there is one of the other's. Where strings are so short, or t so low, that
it may have fewer, single characters serve: of a's characters at least t * |a| / (200 - t) are common to both, so among its rarest others plus one there is one of b's rarest. Strings meet by gram and by
class of length, as lengths must be in a band, too. What is left is scored exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from knotwork.functions.similarity import lcs
from knotwork.functions.text import normalise_entity
from knotwork.plans.lineage import drop, keep


def _rarest(names: DataFrame, size: int, most: str) -> DataFrame:
    """(norm, len, gram): the `most` (SQL) rarest grams of each string; an n-th use of a gram in a string is another one."""
    grams = F.transform(F.sequence(F.lit(1), F.col("len") - (size - 1)), lambda k: F.substring("norm", k, F.lit(size)))
    one = names.where(F.col("len") >= size).select("norm", "len", F.explode(grams).alias("g"))
    numbered = one.withColumn("gram", F.concat_ws("\u0001", "g", F.row_number().over(W.partitionBy("norm", "g").orderBy("g"))))
    counts = numbered.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = numbered.join(counts, "gram").withColumn("k", F.row_number().over(W.partitionBy("norm").orderBy("df", "gram")))
    return ranked.where(f"k <= {most}").select("norm", "len", "gram")


def _prefixes(names: DataFrame, threshold: int) -> DataFrame:
    """(norm, len, gram) of names(norm, len): what two similar strings must share one of. All numbers are whole, so nothing is lost by rounding."""
    t, rest = threshold, 100 - threshold
    # d for the longest partner, which has len * (200 - t) / t characters
    edits = f"(({rest} * len * 200) div ({t} * 100))"
    bigrams = _rarest(names, 2, f"2 * {edits} + 1")
    # a partner of length x with which the longer one's bigrams may all change
    shortest, longest = f"greatest(1, (len * {t} + {199 - t}) div {200 - t})", f"(len * {200 - t}) div {t}"
    short = F.expr(f"exists(sequence({shortest}, greatest({shortest}, {longest})), x -> greatest(len, x) - 1 <= 2 * (({rest} * (len + x)) div 100))")
    single = _rarest(names.where("len > 0").where(short), 1, f"len - (({t} * len + {199 - t}) div {200 - t}) + 1")
    return bigrams.unionByName(single)


def similar_names(names: DataFrame, threshold: int = 85) -> DataFrame:
    """(a, b, score) with a < b for all pairs of distinct strings in names(norm) with an Indel ratio of threshold (a whole number of 1 to 100) or more."""
    if not 1 <= threshold <= 100 or threshold != int(threshold):
        raise ValueError(f"a threshold is a whole number from 1 to 100, not {threshold}")
    sized = names.select("norm").distinct().withColumn("len", F.char_length("norm"))
    prefix, path = keep(_prefixes(sized, threshold), "prefixes")
    # lengths in the band are in one class or the next: a class is a little wider than the band
    width = math.log((200 - threshold) / threshold * 1.01 + 0.01)
    prefix = prefix.withColumn("c", F.floor(F.log("len") / width).cast("int"))
    a = prefix.toDF("a", "la", "gram", "c")
    b = prefix.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1))).toDF("b", "lb", "gram", "c")
    band = F.greatest("la", "lb") * threshold <= F.least("la", "lb") * (200 - threshold)
    pairs = a.join(b, ["gram", "c"]).where((F.col("a") < F.col("b")) & band).select("a", "b", "la", "lb").distinct()
    scored = pairs.withColumn("common", lcs("a", "b")).where(F.expr(f"200 * common >= {threshold} * (la + lb)"))
    return scored.select("a", "b", (200 * F.col("common") / (F.col("la") + F.col("lb"))).alias("score"))


def similar_entities(entities: DataFrame, threshold: int = 85) -> DataFrame:
    """(a, b, score), a < b, over raw names in entities(entity): equal normalised forms score 100."""
    named, _ = keep(entities.where("entity is not null").select("entity").distinct().withColumn("norm", normalise_entity(F.col("entity"))), "names")
    x, y = named.toDF("a", "norm"), named.toDF("b", "norm")
    same = x.join(y, "norm").where("a < b").select("a", "b", F.lit(100.0).alias("score"))
    cross, _ = keep(similar_names(named, threshold), "similar")
    pair = cross.toDF("na", "nb", "score").join(named.toDF("a", "na"), "na").join(named.toDF("b", "nb"), "nb")
    other = pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    return same.unionByName(other)


def seeds(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity) of the greedy choice in ascending order: each entity that is similar to no chosen one before it.

    That order is the result's own, so a chain of names, each similar to the next, takes half as many rounds as it has names; pairs by chance take few.
    By rounds: every undecided entity that is less than all its undecided neighbours is chosen, and its neighbours are out; this gives the same as going one by one.
    """
    spark = entities.sparkSession
    edges, edge_path = keep(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("entity", "other").distinct(), "edges")
    touched = edges.select("entity").distinct()
    chosen, chosen_path = keep(entities.select("entity").distinct().join(touched, "entity", "left_anti"), "chosen")
    open_, path = keep(edges, "open")
    while open_.limit(1).count():
        low = open_.groupBy("entity").agg(F.min("other").alias("least")).where("entity < least").select("entity")
        now, now_path = keep(low, "now")
        out, out_path = keep(open_.join(now, "entity", "left_semi").select(F.col("other").alias("entity")).union(now).distinct(), "out")
        grown, grown_path = keep(chosen.unionByName(now), "chosen")
        left = open_.join(out, "entity", "left_anti")
        # An entity whose neighbours are all decided, but which isn't out, is chosen.
        rest = left.join(out.toDF("other"), "other", "left_anti")
        alone = left.select("entity").distinct().join(rest.select("entity").distinct(), "entity", "left_anti")
        grown2, grown2_path = keep(grown.unionByName(alone), "chosen")
        next_, next_path = keep(rest.select("entity", "other"), "open")
        drop(spark, path, chosen_path, now_path, out_path, grown_path)
        open_, path, chosen, chosen_path = next_, next_path, grown2, grown2_path
    drop(spark, edge_path, path)
    return chosen


def clusters(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed, head, entity, members, place): each seed with all that is similar to it, so clusters may overlap; the head is the longest name, the seed first, then in order.

    Where two seeds give one head, the later one's members stand at the earlier one's place.
    """
    chosen, _ = keep(seeds(entities, pairs), "seeds")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("seed", "entity")
    members = both.join(chosen.toDF("seed"), "seed", "left_semi").unionByName(chosen.select(F.col("entity").alias("seed"), "entity")).distinct()
    rank = F.struct((-F.char_length("entity")).alias("l"), (F.col("entity") != F.col("seed")).alias("other"), "entity")
    heads = members.groupBy("seed").agg(F.min(rank).alias("best"), F.count("*").alias("members")).select("seed", F.col("best.entity").alias("head"), "members")
    by_head = heads.groupBy("head").agg(F.max("seed").alias("seed"), F.min("seed").alias("place"))
    return members.join(heads.select("seed", "members"), "seed").join(by_head, "seed").select("seed", "head", "entity", "members", "place")


def relation_conflicts(triples: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster_head, target, n_relations, relations): for clusters with several members, what their relations to a target disagree on.

    An endpoint belongs to the last cluster that has it. Of a pair in order, the target is the second if the first is in the cluster, else the first. Each relation comes with its sources, joined.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    edges = triples.select(F.least(empty("head"), empty("tail")).alias("x"), F.greatest(empty("head"), empty("tail")).alias("y"), empty("relation").alias("relation"), "source").distinct()
    last = found.groupBy("entity").agg(F.max(F.struct("place", "head", "members")).alias("c")).select("entity", F.col("c.head").alias("cluster"), F.col("c.members").alias("members"))
    e = edges.join(last.toDF("x", "cx", "mx"), "x", "left").join(last.toDF("y", "cy", "my"), "y", "left")
    first = F.when(F.col("mx") > 1, F.struct(F.col("cx").alias("cluster_head"), F.col("y").alias("target")))
    second = F.when((F.col("my") > 1) & ~F.col("cx").eqNullSafe(F.col("cy")), F.struct(F.col("cy").alias("cluster_head"), F.col("x").alias("target")))
    sides = e.select(F.explode(F.array_compact(F.array(first, second))).alias("s"), "relation", "source").select("s.cluster_head", "s.target", "relation", "source")
    files = sides.groupBy("cluster_head", "target", "relation").agg(F.array_sort(F.collect_set("source")).alias("f"))
    line = F.concat("relation", F.lit(" ("), F.array_join("f", ", "), F.lit(")"))
    by = files.groupBy("cluster_head", "target").agg(F.count("*").alias("n_relations"), F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("relations"))
    return by.where("n_relations > 1")

"""Crawl depths, property graphs from claims, and parts of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.plans.lineage import drop, keep
from knotwork.plans.ranking import with_rank

CLAIMS = "map<string, struct<label_tr: string, claims: map<string, array<variant>>>>"


def bfs_depths(links: DataFrame, roots: DataFrame, max_depth: int, failed: DataFrame | None = None) -> DataFrame:
    """(url, depth): each page reached from roots(url) over links(src, dst) in at most max_depth steps, with the least depth.

    A page in failed(url) is visited, but leads nowhere. A level is one join of its frontier with links, less what was visited.
    """
    spark = links.sparkSession
    visited, path = keep(roots.select("url").distinct().withColumn("depth", F.lit(0)), "visited")
    for depth in range(1, max_depth + 1):
        frontier = visited.where(F.col("depth") == depth - 1).select(F.col("url").alias("src"))
        if failed is not None:
            frontier = frontier.join(failed.select(F.col("url").alias("src")), "src", "left_anti")
        found = links.join(frontier, "src", "left_semi").select(F.col("dst").alias("url")).where("url is not null").distinct().join(visited.select("url"), "url", "left_anti")
        new, new_path = keep(visited.unionByName(found.withColumn("depth", F.lit(depth))), "visited")
        grew = new.where(F.col("depth") == depth).limit(1).count()
        drop(spark, path)
        visited, path = new, new_path
        if not grew:
            break
    return visited


def same_site(links: DataFrame, base: str) -> DataFrame:
    """Links that stay under a base url."""
    return links.where(F.col("dst").startswith(base))


def parse_claims(docs: DataFrame) -> DataFrame:
    """(seq, id, label, property, value as variant, p, s): a row for each statement of each entity in docs(seq, json), and one without property for each entity without any."""
    entities = docs.select("seq", F.posexplode(F.map_entries(F.from_json("json", CLAIMS))).alias("e", "entity")).select("seq", "e", F.col("entity.key").alias("id"), F.col("entity.value.label_tr").alias("label"), F.col("entity.value.claims").alias("claims"))
    props = entities.select("seq", "e", "id", "label", F.posexplode_outer(F.map_entries("claims")).alias("p", "prop"))
    statements = props.select("seq", "e", "id", "label", "p", F.col("prop.key").alias("property"), F.posexplode_outer("prop.value").alias("s", "stmt"))
    return statements.withColumn("value", F.expr("try_variant_get(stmt, '$.mainsnak.datavalue.value', 'variant')")).drop("stmt")


def claim_edges(claims: DataFrame) -> DataFrame:
    """(src, dst, property, kind, dst_label, order): item values lead to entities, strings to literal nodes `property:value`; other values are dropped."""
    kind = F.expr("schema_of_variant(value)")
    text = F.expr("try_variant_get(value, '$', 'string')")
    item = F.expr("try_variant_get(value, '$[\"entity-type\"]', 'string') = 'item'")
    target = F.expr("try_variant_get(value, '$.id', 'string')")
    typed = claims.where("value is not null").select("seq", "e", "p", "s", F.col("id").alias("src"), "property", F.when(kind == "STRING", "literal").when(item & target.isNotNull(), "item").alias("kind"), text.alias("text"), target.alias("target"))
    dst = F.when(F.col("kind") == "item", F.col("target")).otherwise(F.concat_ws(":", "property", "text"))
    return typed.where("kind is not null").select("src", dst.alias("dst"), "property", "kind", F.when(F.col("kind") == "item", F.col("target")).otherwise(F.col("text")).alias("dst_label"), F.struct("seq", "e", "p", "s").alias("order"))


def graph_nodes(claims: DataFrame) -> DataFrame:
    """(id, label, first_seen): entities with their own label, if they have one, else their id; literals with their value."""
    zero = F.struct("seq", "e", F.lit(-1).alias("p"), F.lit(-1).alias("s"))
    own = claims.select("id", "label", zero.alias("order"), F.lit(0).alias("prio")).distinct()
    edges = claim_edges(claims)
    reached = edges.select(F.col("dst").alias("id"), F.col("dst_label").alias("label"), "order", F.lit(1).alias("prio"))
    both = own.unionByName(reached)
    best = F.min(F.when(F.col("label").isNotNull() & (F.col("label") != ""), F.struct("prio", "label")))
    return both.groupBy("id").agg(best.alias("best"), F.min("order").alias("first_seen")).select("id", F.coalesce("best.label", "id").alias("label"), "first_seen")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges; parallel edges count."""
    tagged = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1)))
    return tagged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"))


def induced_subgraph(nodes: DataFrame, edges: DataFrame, k: int = 40) -> tuple[DataFrame, DataFrame]:
    """The first k nodes, and the edges between them."""
    first = nodes.orderBy("first_seen", "id").limit(k)
    inside = edges.join(F.broadcast(first.select(F.col("id").alias("src"))), "src", "left_semi").join(F.broadcast(first.select(F.col("id").alias("dst"))), "dst", "left_semi")
    return first, inside


def batches(ids: DataFrame, column: str, size: int = 50) -> DataFrame:
    """(batch, ids): ids in order, `size` together, as an API takes them."""
    ranked = with_rank(ids.select(column), column)
    return ranked.groupBy(F.expr(f"rank div {size}").alias("batch")).agg(F.array_sort(F.collect_list(column)).alias("ids"))

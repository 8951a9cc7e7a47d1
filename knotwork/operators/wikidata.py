"""What the Wikidata queries ask, over local tables: claims(subject, p, target), props(prop, p), labels(id, lang, label), types(id, type)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import is_entity_uri, label_or, last_segment

NO_TYPE, NO_RELATION, NO_ENTITY = "Belirtilmemiş", "Bilinmeyen İlişki", "Bilinmeyen Varlık"
BINDINGS = "struct<results: struct<bindings: array<map<string, struct<value: string>>>>>"


def best_labels(labels: DataFrame, languages: tuple[str, ...] = ("tr", "en")) -> DataFrame:
    """(id, label): for each id its label in the first of the languages that has a non-empty one; the least, if a language has several."""
    order = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(k)) for k, lang in enumerate(languages)))
    known = labels.where(F.col("lang").isin(*languages) & (F.col("label") != ""))
    return known.groupBy("id").agg(F.min(F.struct(order.alias("k"), "label")).alias("best")).select("id", "best.label")


def with_label(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the label of a key, else the key itself."""
    return rows.join(labels.toDF(key, name), key, "left").withColumn(name, label_or(F.col(key), F.col(name)))


def entity_claims(claims: DataFrame, props: DataFrame, labels: DataFrame, entity: str) -> DataFrame:
    """(prop_label, value, value_label) of one entity's direct claims; the filter is on the scan."""
    best = best_labels(labels)
    own = claims.where(F.col("subject") == entity).join(props, "p").select("prop", "target")
    ids = own.withColumn("value", F.when(is_entity_uri(F.col("target")), last_segment(F.col("target"))).otherwise(F.col("target")))
    out = with_label(with_label(ids, best, "prop", "prop_label"), best, "value", "value_label")
    return out.select("prop_label", F.col("target").alias("value"), "value_label").orderBy("prop_label", "value")


def typed_triples(claims: DataFrame, props: DataFrame, labels: DataFrame, types: DataFrame, entity: str | None = None) -> DataFrame:
    """Triples between entities: a row for each pair of a source's and a target's type, or with no type; nothing is made distinct. Those of one entity come in order."""
    if entity is not None:
        return typed_triples(claims.where(F.col("subject") == entity), props, labels, types).orderBy("relation", "tail", "head_type", "tail_type")
    best = best_labels(labels)
    named = with_label(types, best, "type", "type_label").select("id", "type_label")
    links = claims.where(is_entity_uri(F.col("target"))).withColumn("object", last_segment(F.col("target"))).join(props, "p").select("subject", "prop", "object")
    typed = links.join(named.toDF("subject", "head_type"), "subject", "left").join(named.toDF("object", "tail_type"), "object", "left")
    out = typed
    for key, name in (("subject", "head"), ("prop", "relation"), ("object", "tail")):
        out = with_label(out, best, key, name)
    return out.select("head", F.coalesce("head_type", F.lit(NO_TYPE)).alias("head_type"), "relation", "tail", F.coalesce("tail_type", F.lit(NO_TYPE)).alias("tail_type"))


def related_ids(claims: DataFrame, entity: str) -> DataFrame:
    """(id): the entities that an entity's claims lead to, and itself; distinct, in order."""
    targets = claims.where((F.col("subject") == entity) & is_entity_uri(F.col("target"))).select(last_segment(F.col("target")).alias("id"))
    me = claims.sparkSession.range(1).select(F.lit(entity).alias("id"))
    return targets.union(me).distinct().orderBy("id")


def descriptions(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, label_tr, description_tr): Turkish, else English, else the id or a fixed phrase. texts is like labels, with description."""
    ids = labels.select("id").union(texts.select("id")).distinct()
    said = best_labels(texts.withColumnRenamed("description", "label")).toDF("id", "d")
    return ids.join(best_labels(labels), "id", "left").join(said, "id", "left").select("id", label_or(F.col("id"), F.col("label")).alias("label_tr"), label_or(F.lit("No description available."), F.col("d")).alias("description_tr"))


def fetch_entities(batches: DataFrame, fetcher: Callable[[list[str]], dict[str, str] | None]) -> DataFrame:
    """(id, json) for batches(batch, ids) by any function from ids to a document each, called where the data is; a failed batch (None) is left out, and of one id's documents the last batch's stays."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(b, i, doc) for b, ids in zip(p["batch"], p["ids"], strict=True) for i, doc in (fetcher(list(ids)) or {}).items()]
            yield pd.DataFrame(rows, columns=["batch", "id", "json"])

    found = batches.select("batch", "ids").mapInPandas(run, "batch long, id string, json string")
    return found.groupBy("id").agg(F.max_by("json", "batch").alias("json"))


def parse_bindings(answers: DataFrame, column: str = "json", entity: str = "") -> DataFrame:
    """Triples of query answers in JSON; a variable that is missing gets its default."""
    rows = answers.select(F.explode(F.from_json(column, BINDINGS)["results"]["bindings"]).alias("b"))
    get = lambda name, default: F.coalesce(F.col("b")[name]["value"], F.lit(default)).alias
    return rows.select(get("sourceLabel", entity)("head"), get("sourceTypeLabel", NO_TYPE)("head_type"), get("propLabel", NO_RELATION)("relation"), get("targetLabel", NO_ENTITY)("tail"), get("targetTypeLabel", NO_TYPE)("tail_type"))

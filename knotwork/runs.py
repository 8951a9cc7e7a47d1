"""Whole runs: merging a folder of triple files, extracting triples from CSV tables with a model, and crawling pages to reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import crawl, extraction, frequency, merge
from knotwork.plans.lineage import keep
from knotwork.plans.schema import to_edge
from knotwork.sources import readers, sinks


@dataclass
class Merged:
    """What a merge run gives: where its files are, how it went, and the first rows of each table."""

    folder: str
    statistics: Row
    preview: dict[str, list[Row]]
    bad: list[str]


def merge_folder(spark: SparkSession, folder: str, name: str = "merged", first: int = 3) -> Merged | None:
    """Merge all triple files of a folder into folder/name: three merged tables and statistics, as JSON. None where there is no triple; files that can't be read are named."""
    triples, _ = keep(readers.read_triples(spark, folder), "triples")
    bad = [r.source for r in readers.bad_files(spark, folder).collect()]
    if not triples.limit(1).count():
        return None
    out = f"{folder.rstrip('/')}/{name}"
    full, _ = keep(merge.merge_relations_and_types(triples), "merged")
    order = ("first_seen", "head", "tail")
    tables = {
        "entity_types_merged": merge.joined(merge.merge_entity_types(triples), "entity_type").orderBy("entity"),
        "relations_merged": merge.joined(merge.merge_relations(full), "relation").orderBy(*order).select("head", "tail", "relation"),
        "relations_and_types_merged": merge.joined(full, "relation", "head_type", "tail_type").orderBy(*order).select("head", "head_type", "relation", "tail", "tail_type"),
    }
    for table, df in tables.items():
        sinks.write_json_list(to_edge(df), f"{out}/{table}.json", indent=2)
    statistics, _ = keep(merge.merge_statistics(triples), "statistics")
    sinks.write_statistics(statistics, f"{out}/statistics.json")
    return Merged(out, statistics.first(), {table: df.limit(first).collect() for table, df in tables.items()}, bad)


def extract_csv(spark: SparkSession, path: str, model: Callable[[list[str]], list[str | None]], system: str, examples: list[dict[str, str]]) -> DataFrame:
    """Triples that a model finds in the texts of a frequency table, or of each in a folder; each table's clean triples go to <table>_clean.json beside it.

    A text is each part of Kaynak_IDler; Frekans says how many relations are wanted. (source, head, head_type, relation, tail, tail_type, text), as kept, so the model is asked once.
    """
    files = path if path.endswith(".csv") else f"{path.rstrip('/')}/*.csv"
    rows = readers.read_csv(spark, files).select(F.col("_metadata.file_path").alias("file"), F.col("Kaynak_IDler").alias("text"), F.col("Frekans").cast("int").alias("n")).where("text is not null")
    asked = extraction.ask(extraction.parts(rows).withColumn("prompt", extraction.prompt(F.col("text"), system, examples, F.col("n"))).drop("n"), model)
    found, _ = keep(extraction.parse_answers(asked.drop("prompt"), text="text"), "extracted")
    for r in found.select("file").distinct().collect():  # one a table
        sinks.write_clean(found.where(F.col("file") == r.file), r.file)
    return found.select(F.regexp_extract("file", r"([^/]*)\.csv$", 1).alias("source"), "head", "head_type", "relation", "tail", "tail_type", "text")


@dataclass
class Report:
    """What a crawl run gives: where its tables are, the counts, and the most frequent entities."""

    folder: str
    depths: DataFrame
    n_pages: int
    n_entities: int
    n_pairs: int
    n_repeated: int
    top: list[Row]


def crawl_report(pages: DataFrame, root: str, max_depth: int, base: str, folder: str, least: int = 2, **selectors: str) -> Report:
    """Crawl from root, and write under folder, as CSV tables: occurrences by page, the roll-up by url with sentences, and the entities and pairs that are on `least` pages or more."""
    got = crawl.crawl(pages, root, max_depth, base, **selectors)
    found, _ = keep(got.mentions, "mentions")
    entities = frequency.page_frequency(found, least=least)
    for name, df in {
        "occurrences": frequency.occurrence_frequency(found), "urls": frequency.url_rollup(found), "entities": entities, "pairs": frequency.page_frequency(found, "entity", "url", least=least),
    }.items():
        sinks.write_csv(df, f"{folder.rstrip('/')}/{name}")
    counts = frequency.run_summary(found).first()
    return Report(folder, got.depths, counts.n_pages, counts.n_entities, counts.n_pairs, entities.count(), frequency.top_entities(found).collect())

"""Readers. A file's stem names its source; bad files and missing ones are left out, and can be asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.text import q_number, strip
from knotwork.plans.lineage import file_system
from knotwork.plans.schema import TURKISH

_FILE = "array<struct<" + ", ".join(f"`{k}`: string" for k in TURKISH) + ">>"
PAGE = "Title string, Card map<string,string>, Main array<struct<id:string,sentence:string>>"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, in whatever file system they name."""
    return [p for p in paths if (there := file_system(spark, p))[1].exists(there[0])]


def _stem(ext: str):
    return F.regexp_extract(F.col("_metadata.file_name"), rf"(.*)\.{ext}$", 1)


def _whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(_stem("json").alias("source"), F.from_json("value", _FILE).alias("rows"), "value")


def read_triples(spark: SparkSession, folder: str) -> DataFrame:
    """All triples of folder/*.json (not deeper); a file that is no JSON list gives none, see bad_files()."""
    return _explode(_whole(spark, [f"{folder.rstrip('/')}/*.json"]))


def read_triple_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All triples of the files that exist, duplicates kept; order follows the list."""
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*TURKISH.values(), "source")) + ", seq long")
    files = _whole(spark, there)
    order = F.coalesce(*(F.when(F.col("source") == p.rpartition("/")[2].removesuffix(".json"), k) for k, p in enumerate(there)), F.lit(len(there)))
    return _explode(files, order)


def _explode(files: DataFrame, order=None) -> DataFrame:
    rows = files.select("source", (F.lit(0) if order is None else order).alias("o"), F.posexplode("rows").alias("k", "t"))
    fields = [F.col(f"t.`{k}`").alias(v) for k, v in TURKISH.items()]
    return rows.where("t is not null").select(*fields, "source", (F.col("o").cast("long") * (1 << 40) + F.col("k")).alias("seq"))


def bad_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source): the files of a folder that read_triples() leaves out."""
    return _whole(spark, [f"{folder.rstrip('/')}/*.json"]).where("rows is null").select("source")


def read_merged(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The merged tables and statistics that a folder has, by name."""
    names = ("entity_types_merged", "relations_merged", "relations_and_types_merged", "statistics")
    return {n: spark.read.json(p, multiLine=True) for n in names if existing(spark, [p := f"{folder.rstrip('/')}/{n}.json"])}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page documents as (title, card: ordered array<struct<key,value>>, main, source); path may be a glob such as .../Wiki_*.json."""
    pages = spark.read.schema(PAGE).json(path, multiLine=True)
    return pages.select(F.col("Title").alias("title"), F.map_entries("Card").alias("card"), F.col("Main").alias("main"), _stem("json").alias("source"))


def page_sentences(pages: DataFrame) -> DataFrame:
    """(page_id, title, sent_id, sentence) of main text and of card values, whose id is titleCard#ordinal."""
    main = pages.select(F.col("source").alias("page_id"), "title", F.explode("main").alias("m")).select("page_id", "title", F.col("m.id").alias("sent_id"), F.col("m.sentence").alias("sentence"))
    card = pages.select(F.col("source").alias("page_id"), "title", F.posexplode("card").alias("k", "c")).select("page_id", "title", F.concat("title", F.lit("Card#"), F.col("k") + 1).alias("sent_id"), F.col("c.value").alias("sentence"))
    return main.unionByName(card).where("sentence is not null and sentence <> ''")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header; quoted values may go over lines."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_entity_sets(spark: SparkSession, paths: list[str], column: str = "E") -> DataFrame:
    """(source, item) from the CSV files that have the column; nulls dropped. Needs two such files."""
    out, used = None, 0
    for p in existing(spark, paths):
        df = read_csv(spark, p)
        if column not in df.columns:
            continue
        used += 1
        part = df.select(_stem("csv").alias("source"), F.col(column).cast("string").alias("item")).dropna(subset=["item"])
        out = part if out is None else out.unionByName(part)
    if used < 2:
        raise ValueError(f"two files with a column {column} are needed; there are {used}")
    return out


def read_q_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): a file's lines that start with Q, stripped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).where(F.col("id").startswith("Q"))


def valid_q_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    return ids.select(q_number(F.col(column)).alias("id")).where("id is not null")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """(seq, json) of claim documents, one a file."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("seq"), F.col("value").alias("json"))


def fetch_pages(urls: DataFrame, fetcher, column: str = "url") -> DataFrame:
    """(url, html) by any function from url to html or None, called where the data is; a failed page is null."""

    def run(batches):
        for b in batches:
            yield b[[column]].assign(html=[fetcher(u) for u in b[column]])

    return urls.select(column).mapInPandas(run, f"{column} string, html string")

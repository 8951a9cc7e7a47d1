"""A corpus pipeline: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes the documents that the one before kept and gives documents with the same columns; the last gives token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import decontamination, linededup, neardup, quality, sentencepiece_scan, store


def _counted(left: DataFrame, columns: list[str]) -> DataFrame:
    """left's columns, with n_chars, where it is there, as the text now is; a null text's stays."""
    n = F.coalesce(F.char_length("text").cast("long"), "n_chars") if "n_chars" in columns else None
    return left.select(*(n.alias(c) if c == "n_chars" else F.col(c) for c in columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the scorer keeps, and those on which no labeller votes; a null text, or one without words, goes.

    Each row is judged by its text alone: repeated rows share a fate, ids don't matter, very long texts are scored whole, a score of exactly 0.5 stays. An empty table stays one. Columns with the names of results are the documents' own.
    """
    scored = quality.classify(docs)
    return scored.where(F.col(scored.columns[-1])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occurred before.

    A document goes if less than half of its words is left: most of what it said stood in earlier documents (it is an exact or near copy, or quotes for the most part), and its remains are torn text, in which near-dedup could not see the copy any more. Every other one stays with what is left.
    Null texts, those without words and those without a repeated run stay as they are. Rows that repeat both id and text share a fate (the first of them isn't told from the others, so near-dedup
    takes the copies); one id on several texts is several documents, of which the one with the least text hash comes first; null ids come before all others. Very long texts are read whole. An empty table stays one.
    """
    done = linededup.dedup(docs)
    n, removed = (F.col(c) for c in done.columns[-2:])
    return _counted(done.where((removed == 0) | (REMAINDER * (n - removed) >= n)), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates by shingles of five words: that with the smallest doc_id, a null id after all others, among equal ids any one.

    Rows are told apart by a number of their own, not by doc_id: repeated rows are copies of each other, one id on several texts is several documents, and null ids are grouped like others.
    Null texts and those without words stay, each of them. Very long texts are compared by all their shingles. An empty table stays one.
    """
    rows, path = store.keep(docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id()), "rows", "lz4")
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    groups = neardup.near_duplicates(rows, "row", at["text"], n=5, percent=80)
    # only groups of several rows: their members, then the one of them that stays
    several = groups.where("not kept").select(F.col("component_id").alias("group")).distinct()
    members, members_path = store.keep(groups.join(several, F.col("component_id") == F.col("group"), "left_semi").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "grouped")
    named = members.join(rows.select("row", F.col(at["doc_id"]).alias("id")), "row")
    stays = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best")).select(F.col("best.row").alias("row"))
    gone = members.select("row").join(stays, "row", "left_anti")
    left, _ = store.keep(rows.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns), "distinct")
    store.drop(spark, path, members_path)
    return left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the words that windows of the benchmark hit are cut.

    Both follow from the text alone, whatever its doc_id: rows with null, shared or repeated ids fare as their text does. Null texts and those without words stay. Very long texts are searched whole.
    An empty table, or an empty benchmark, leaves all as it is.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    hits, _ = store.keep(decontamination.contamination(rows, benchmark, "_text_hash").where("size(spans) > 0"), "hits")
    gone = decontamination.digest(hits).where("contaminated").select(F.col("doc_id").alias("_text_hash")).distinct()
    left = decontamination.excise(rows.join(gone, "_text_hash", "left_anti").select(*rows.columns), hits, "_text_hash").drop("_text_hash")
    return _counted(left, docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip, a row for each row: null texts have null ids, empty ones none; repeated rows are encoded each, giants by the scan. An empty table gives no rows."""
    return sentencepiece_scan.encode(docs, "text", F.col("doc_id"))


#: A document of which line dedup leaves less than 1 / REMAINDER of its words goes.
REMAINDER = 2

STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("tokens", tokenise),
]

#: No SQL expresses a trained classifier or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, new = store.keep(docs, "stage-" + name.replace(" ", "-"))
            store.drop(spark, *([path] if path else []))
            path = new
    return docs

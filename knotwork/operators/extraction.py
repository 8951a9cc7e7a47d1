"""Triples from a language model's answers: prompts, a place to plug the model in, and the parsing of what it says."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from knotwork.functions.text import text_parts, unfenced
from knotwork.plans.schema import FIELDS, TURKISH

ANSWER = "array<struct<" + ", ".join(f"`{k}`: string" for k in TURKISH) + ">>"


def prompt(text: Column, system: str, examples: list[dict[str, str]], frequency: Column | None = None) -> Column:
    """System prompt, the first three examples as JSON, how many relations are wanted (where that is known), and the text."""
    head = system + "\n\nÖrnek çıktı:\n" + json.dumps(examples[:3], ensure_ascii=False, indent=2) + "\n"
    wanted = F.lit("") if frequency is None else F.coalesce(F.format_string("\nTam %d ayrı ilişki türü bul.\n", frequency.cast("int")), F.lit(""))
    wanted = wanted if frequency is None else F.when(frequency > 0, wanted).otherwise("")
    return F.concat(F.lit(head), wanted, F.lit("\nMetin:\n"), text, F.lit("\n\nYanıt yalnız bir JSON listesi olsun.\n"))


def load_examples(file: str) -> tuple[str, list[dict[str, str]]]:
    """(system prompt, examples) from a JSON file {"system": ..., "examples": [...]}: data, nothing in it is run. A missing or malformed file gives neither."""
    try:
        doc = json.loads(Path(file).read_text(encoding="utf-8"))
        return str(doc["system"]), list(doc["examples"])
    except (OSError, ValueError, KeyError, TypeError):
        return "", []


def parts(rows: DataFrame, column: str = "text") -> DataFrame:
    """A row for each part of a joined text, other columns carried along."""
    return rows.select("*", F.explode(text_parts(F.col(column))).alias("part")).drop(column).withColumnRenamed("part", column)


def ask(rows: DataFrame, model: Callable[[list[str]], list[str | None]], column: str = "prompt", answer: str = "answer") -> DataFrame:
    """rows with the model's answers, asked in batches where the data is; the model is any function of a list of prompts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{answer: model(b[column].tolist())})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(answer, StringType())]))


def parse_answers(rows: DataFrame, column: str = "answer", text: str | None = None) -> DataFrame:
    """Triples of all answers, with the other columns of rows; an answer that is no JSON list gives none. text names the column that is kept as a triple's text."""
    listed = F.from_json(unfenced(F.col(column)), ANSWER)
    each = rows.select("*", F.explode(F.coalesce(listed, F.array().cast(ANSWER))).alias("_t"))
    others = [c for c in rows.columns if c != column and c not in FIELDS]
    fields = [F.col(f"_t.`{k}`").alias(v) for k, v in TURKISH.items() if v != "text"]
    return each.select(*others, *fields, (F.col(text) if text else F.col("_t.metin")).alias("text"))


def clean_output(triples: DataFrame) -> DataFrame:
    """The six fields alone; empty where missing."""
    return triples.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIELDS))

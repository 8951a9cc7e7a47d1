"""The canonical triple, and its names at the edges.

Inside the engine a triple is (head, head_type, relation, tail, tail_type, text) with the name of its source and its place there;
files use Turkish keys. Multi-valued fields are arrays inside and joined strings at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURKISH = {"baş": "head", "baş_tipi": "head_type", "ilişki": "relation", "uç": "tail", "uç_tipi": "tail_type", "metin": "text"}
ASCII = {v: k for k, v in TURKISH.items()}
FIELDS = ("head", "head_type", "relation", "tail", "tail_type", "text")
TRIPLE = ", ".join(f"{c} string" for c in FIELDS) + ", source string, seq long"
UNKNOWN = "Bilinmiyor"
JOINER = ", "


def to_edge(df: DataFrame) -> DataFrame:
    """Canonical names to file names."""
    return df.select(*(F.col(c).alias(ASCII.get(c, c)) for c in df.columns))


def to_canonical(df: DataFrame) -> DataFrame:
    """File names to canonical names."""
    return df.select(*(F.col(f"`{c}`").alias(TURKISH.get(c, c)) for c in df.columns))


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def require_keys(triples: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with head, relation and tail. strict: a row without one of them fails the query when it is read."""
    missing = F.col("head").isNull() | F.col("relation").isNull() | F.col("tail").isNull()
    if strict:
        return triples.where(F.when(missing, F.raise_error(F.lit("a triple lacks head, relation or tail")).cast("boolean")).otherwise(F.lit(True)))
    return triples.where(~missing)


def quarantine(triples: DataFrame) -> DataFrame:
    """The rows that require_keys() leaves out."""
    return triples.where("head is null or relation is null or tail is null")

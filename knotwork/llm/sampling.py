"""Bounded samples by hash, and joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT of all rows is hot; so there are fewer than HOT of them.
HOT = 10_000


def bound(sample: float, rows: int) -> int:
    """Below it lies the share sample / rows of all signed 64-bit hashes; it resolves any table size (2**64 steps)."""
    return -(1 << 63) + min((1 << 64) - 1, (int(sample) << 64) // max(1, rows))


def chosen(texts: DataFrame, below: Column | int, most: int, text: str = "text", *more: str) -> DataFrame:
    """(h, text, *more) of the distinct texts whose hash h is below a bound: each text once, in how many rows it may stand, and `most` of them at most, least hashes first.

    Equal texts meet after each task has made them one, so a text in a third of all rows is no hot group.
    """
    h = F.xxhash64(F.col(text), F.lit(9))
    rows = texts.select(h.alias("h"), F.col(text), *more).where(F.col("h") <= below if isinstance(below, Column) else F.col("h") <= F.lit(below))
    one = rows.groupBy("h", *more).agg(F.min(text).alias(text)).orderBy("h", *more).limit(most)
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.repartition(tasks, "h").select("h", text, *more)


def join_split(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """rows joined with facts (one row a key, which `count` says how many of rows have), hot keys by broadcast, the others by a shuffle without any hot key.

    There are fewer than HOT hot keys whatever the input, so what is broadcast is bounded. facts must be a kept table, as it is read twice.
    """
    names = [c for c in facts.columns if c not in keys]
    limit = total // HOT
    hot = facts.where(F.col(count) > limit).select(*keys, F.struct(*names).alias("_hot"))
    tagged = rows.join(F.broadcast(hot), keys, "left")
    known = tagged.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in names))
    rest = tagged.where("_hot is null").drop("_hot").join(facts.where(F.col(count) <= limit), keys).select(*rows.columns, *names)
    return known.unionByName(rest)

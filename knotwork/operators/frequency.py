"""Mentions, and the three frequencies of them: occurrences, sentences, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import LEGACY, MENTION, bare_url, clean_entity, markup_to_entity, strip, without_markup

SEP = " | "


def mentions(sentences: DataFrame, legacy: bool = False, keep_parens: bool = False) -> DataFrame:
    """A row for each mention: the sentence's columns (page_id, title, sent_id, sentence), entity, url, pos. Both must not be empty.

    legacy also reads the older markup; keep_parens leaves a url as the markup has it.
    """
    rows = None
    for pattern in (MENTION, *([LEGACY] if legacy else [])):
        zipped = F.arrays_zip(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1)).alias("e"), F.regexp_extract_all("sentence", F.lit(pattern), F.lit(2)).alias("u"))
        found = sentences.select("page_id", "title", "sent_id", "sentence", F.posexplode(zipped).alias("pos", "m"))
        url = strip(F.col("m.u"))
        found = found.select("page_id", "title", "sent_id", "sentence", "pos", clean_entity(F.col("m.e")).alias("entity"), (url if keep_parens else bare_url(url)).alias("url"))
        rows = found if rows is None else rows.unionByName(found)
    return rows.where("entity <> '' and url <> ''")


def occurrence_frequency(found: DataFrame) -> DataFrame:
    """By page, entity and url: occurrences, and the sentences without their mentions as `id: sentence`, or bare ids where nothing is left."""
    by = found.groupBy("page_id", "entity", "url").agg(
        F.count("*").alias("n_occurrences"), F.array_sort(F.collect_set("sent_id")).alias("ids"), F.array_sort(F.collect_set(F.struct("sent_id", without_markup(F.col("sentence")).alias("s")))).alias("all")
    )
    full = F.filter("all", lambda x: x["s"] != "")
    listed = F.when(F.size(full) > 0, F.array_join(F.transform(full, lambda x: F.concat(x["sent_id"], F.lit(": "), x["s"])), SEP)).otherwise(F.array_join("ids", SEP))
    return by.select("page_id", "entity", "url", "n_occurrences", listed.alias("sources"))


def url_rollup(found: DataFrame) -> DataFrame:
    """By url: its aliases, the number of distinct sentences over all of them, and these with mentions as plain names; most first."""
    once = F.struct("sent_id", strip(F.col("sentence")).alias("raw"))
    by = found.groupBy("url").agg(F.array_sort(F.collect_set("entity")).alias("e"), F.array_sort(F.collect_set(once)).alias("s"))
    lines = F.transform("s", lambda x: F.concat(x["sent_id"], F.lit(": "), strip(markup_to_entity(x["raw"]))))
    return by.select(F.array_join("e", SEP).alias("entities"), "url", F.size("s").cast("long").alias("n_sentences"), F.array_join(lines, SEP).alias("sources")).orderBy(F.desc("n_sentences"), "url")


def page_frequency(found: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """By entity, or entity and url: on how many pages, with titles and page ids joined; at least `least` pages, most first."""
    keys = keys or ("entity",)
    by = found.groupBy(*keys).agg(F.array_sort(F.collect_set("title")).alias("titles"), F.array_sort(F.collect_set("page_id")).alias("pages"))
    out = by.select(*keys, F.size("pages").cast("long").alias("n_pages"), F.array_join("titles", SEP).alias("titles"), F.array_join(F.transform("pages", lambda p: p.cast("string")), SEP).alias("page_ids"))
    return out.where(F.col("n_pages") >= least).orderBy(F.desc("n_pages"), *keys)


def search_entity(found: DataFrame, query: str) -> DataFrame:
    """Page frequencies of the entities that hold the query, in any case."""
    return page_frequency(found.where(F.lower("entity").contains(query.strip().lower())), least=1)


def top_entities(found: DataFrame, k: int = 20) -> DataFrame:
    by = found.groupBy("entity").agg(F.count_distinct("page_id").alias("n_pages"))
    return by.orderBy(F.desc("n_pages"), "entity").limit(k)


def page_summary(found: DataFrame) -> DataFrame:
    """By page: distinct entities and pairs, and the lists."""
    pair = F.concat_ws("|", "entity", "url")
    by = found.groupBy("page_id", "title").agg(F.array_sort(F.collect_set("entity")).alias("e"), F.array_sort(F.collect_set(pair)).alias("p"))
    return by.select("page_id", "title", F.size("e").cast("long").alias("n_entities"), F.size("p").cast("long").alias("n_pairs"), F.array_join("e", SEP).alias("entities"), F.array_join("p", SEP).alias("pairs"))


def run_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("entity", "url").alias("n_pairs"), F.count_distinct("page_id").alias("n_pages"))

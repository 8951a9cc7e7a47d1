"""From pages to documents, mentions and links, and the crawl over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.html import infobox_udf, paragraphs_udf
from knotwork.functions.sentences import sentences
from knotwork.functions.text import page_title
from knotwork.operators.frequency import mentions
from knotwork.operators.graph import bfs_depths, same_site
from knotwork.plans.lineage import keep


def page_documents(pages: DataFrame, base: str, selector: str = "#mw-content-text p", box: str = ".vcard") -> DataFrame:
    """(page_id, title, card, main) of pages(url, html): card is ordered (key, value), main the sentences over all paragraphs. A failed page (null html) gives none."""
    read = pages.where("html is not null").select(F.col("url").alias("page_id"), page_title(F.col("html")).alias("title"), infobox_udf(base, box)("html").alias("card"), paragraphs_udf(base, selector)("html").alias("p"))
    parts = read.select("page_id", "title", "card", F.posexplode_outer("p").alias("k", "p")).select("page_id", "title", "card", "k", sentences("p").alias("s"))
    main = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]))
    return parts.groupBy("page_id", "title").agg(F.first("card").alias("card"), main.alias("main"))


def document_sentences(documents: DataFrame) -> DataFrame:
    """(page_id, title, sent_id, sentence): main sentences as title#n, card values as titleCard#n, n from 1 within a page."""
    main = documents.select("page_id", "title", F.posexplode("main").alias("k", "sentence")).select("page_id", "title", F.concat("title", F.lit("#"), F.col("k") + 1).alias("sent_id"), "sentence")
    card = documents.select("page_id", "title", F.posexplode("card").alias("k", "c")).select("page_id", "title", F.concat("title", F.lit("Card#"), F.col("k") + 1).alias("sent_id"), F.col("c.value").alias("sentence"))
    return main.unionByName(card).where("sentence <> ''")


@dataclass
class Crawl:
    """What a crawl gives: depths of visited urls, and the sentences and mentions of the pages that were read."""

    depths: DataFrame
    sentences: DataFrame
    mentions: DataFrame


def crawl(pages: DataFrame, root: str, max_depth: int, base: str, selector: str = "#mw-content-text p", box: str = ".vcard") -> Crawl:
    """Breadth first from root over mentions that stay under base; a page that is missing or failed is visited, but leads nowhere."""
    spoken, _ = keep(document_sentences(page_documents(pages, base, selector, box)), "sentences")  # so pages are parsed once, not at each level
    found, _ = keep(mentions(spoken), "mentions")
    links, _ = keep(same_site(found.select(F.col("page_id").alias("src"), F.col("url").alias("dst")).distinct(), base), "links")
    depths = bfs_depths(links, pages.sparkSession.range(1).select(F.lit(root).alias("url")), max_depth)
    visited = depths.select(F.col("url").alias("page_id"))
    return Crawl(depths, spoken.join(visited, "page_id", "left_semi"), found.join(visited, "page_id", "left_semi"))

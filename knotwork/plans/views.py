"""Triples, mentions, claims and links as views of relational tables, so that every operator can run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.text import page_title
from knotwork.plans.schema import FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _triples(df: DataFrame, **columns) -> DataFrame:
    return df.select(*(columns.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in FIELDS), columns["source"].cast("string").alias("source"), columns["seq"].cast("long").alias("seq"))


def triples_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User - event type - key; a source for each day."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _triples(
        table(spark, sf_dir, "events"),
        head=F.concat(F.lit("user_"), "user_id"), head_type=F.lit("User"), relation=F.col("event_type"), tail=F.concat(F.lit("k_"), k), tail_type=F.concat(F.lit("Bucket "), F.floor(k / 10)),
        source=F.date_format("ts", "yyyy-MM-dd"), seq=F.col("event_id"),
    )


def triples_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier - SUPPLIES - part, customer - ORDERED - part; part names have several types. The return flag is the source, so there are three.

    Orders join by keys alone before parts bring their texts, which so go through one shuffle; customers come last, so a head's rows are together and group-bys combine before they shuffle.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    seq = F.col("l_orderkey") * 16 + F.col("l_linenumber") * 2
    with_part = lambda df: df.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    supply = with_part(items).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    order = with_part(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    common = {"tail": F.col("p_name"), "source": F.col("l_returnflag")}
    return _triples(supply, head=F.col("s_name"), head_type=F.lit("Supplier"), relation=F.lit("SUPPLIES"), tail_type=F.col("p_type"), seq=seq, **common).unionByName(
        _triples(order, head=F.col("c_name"), head_type=F.col("c_mktsegment"), relation=F.concat(F.lit("ORDERED "), "p_brand"), tail_type=F.col("p_type"), seq=seq + 1, **common)
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, k, href, name) of every anchor of pages."""
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    zipped = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("h"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("n"))
    return table(spark, sf_dir, "pages").select("page_id", page_title(F.col("html")).alias("title"), F.posexplode(zipped).alias("k", "a")).select("page_id", "title", (F.col("k") + 1).cast("long").alias("k"), F.col("a.h").alias("href"), F.col("a.n").alias("name"))


def mention_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked-up sentence for each anchor: (page_id, title, sent_id, sentence)."""
    sentence = F.concat(F.lit("See <PossibleEntity>"), "name", F.lit("</PossibleEntity> <URL>:("), F.lower("href"), F.lit(")</URL> on "), F.col("k").cast("string"), F.lit("."))
    return anchors(spark, sf_dir).select("page_id", "title", F.concat(F.col("page_id").cast("string"), F.lit("#"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("sent_id"), sentence.alias("sentence"))


def triples_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor's name - a relation by page - the next anchor's name; three sources."""
    a = anchors(spark, sf_dir).select("page_id", "k", "name")
    b = a.select("page_id", (F.col("k") - 1).alias("k"), F.col("name").alias("next"))
    return _triples(
        a.join(b, ["page_id", "k"]), head=F.col("name"), head_type=F.lit("Link"), relation=F.concat(F.lit("r"), F.col("page_id") % 5), tail=F.col("next"), tail_type=F.lit("Link"),
        source=F.concat(F.lit("s"), F.col("page_id") % 3), seq=F.col("page_id") * 1000 + F.col("k"),
    )


def links_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> part -> supplier -> part, as (src, dst)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(name("c", "o_custkey").alias("src"), name("p", "l_partkey").alias("dst"))
    made = items.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"))
    back = items.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"))
    return bought.union(made).union(back).distinct()


def claim_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, json): a claim document for each supplier - its nation (an item), its name (a string), its balance (dropped as a number)."""
    s = table(spark, sf_dir, "supplier")
    item = F.to_json(F.struct(F.lit("item").alias("entity-type"), F.concat(F.lit("Q"), F.col("s_nationkey").cast("string")).alias("id")))
    stmt = lambda v: F.concat(F.lit('[{"mainsnak":{"datavalue":{"value":'), v, F.lit("}}}]"))
    qid = F.concat(F.lit("Q1"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    label = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"label_tr":"'), "s_name", F.lit('",'))).otherwise("")
    doc = F.concat(F.lit('{"'), qid, F.lit('":{'), label, F.lit('"claims":{"P17":'), stmt(item), F.lit(',"P1448":'), stmt(F.concat(F.lit('"'), "s_name", F.lit('"'))), F.lit(',"P2139":'), stmt(F.round("s_acctbal", 0).cast("long").cast("string")), F.lit("}}}"))
    return s.select(F.col("s_suppkey").cast("long").alias("seq"), doc.alias("json"))


def wikidata_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """claims, props, labels, types: suppliers in nations, nations in regions; nations have two types, suppliers none."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    uri = lambda c: F.concat(F.lit("http://www.wikidata.org/entity/"), c)
    q = lambda lead, c: F.concat(F.lit("Q" + lead), F.col(c).cast("string"))
    claims = (
        s.select(q("9", "s_suppkey").alias("subject"), F.lit("wdt:P17").alias("p"), uri(q("1", "s_nationkey")).alias("target"))
        .union(s.select(q("9", "s_suppkey"), F.lit("wdt:P1448"), F.col("s_name")))
        .union(n.select(q("1", "n_nationkey"), F.lit("wdt:P30"), uri(q("5", "n_regionkey"))))
    )
    props = spark.createDataFrame([("P17", "wdt:P17"), ("P30", "wdt:P30"), ("P1448", "wdt:P1448")], "prop string, p string")
    labels = (
        s.select(q("9", "s_suppkey").alias("id"), F.lit("en").alias("lang"), F.col("s_name").alias("label"))
        .union(n.select(q("1", "n_nationkey"), F.lit("en"), F.col("n_name")))
        .union(n.where("n_nationkey % 2 = 0").select(q("1", "n_nationkey"), F.lit("tr"), F.concat(F.lit("tr "), F.lower("n_name"))))
        .union(n.where("n_nationkey % 2 = 1").select(q("1", "n_nationkey"), F.lit("tr"), F.lit("")))
        .union(r.where("r_regionkey < 3").select(q("5", "r_regionkey"), F.lit("en"), F.col("r_name")))
        .union(spark.createDataFrame([("P17", "tr", "ülkesi"), ("P30", "en", "continent"), ("QT1", "tr", "ülke")], "id string, lang string, label string"))
    )
    types = n.select(q("1", "n_nationkey").alias("id"), F.lit("QT1").alias("type")).union(n.where("n_nationkey % 3 = 0").select(q("1", "n_nationkey"), F.lit("QT2")))
    return claims, props, labels, types

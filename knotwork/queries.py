"""The engine's queries over the relational test tables, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import html as H
from knotwork.functions import sentences as S
from knotwork.functions import text as T
from knotwork import runs
from knotwork.operators import extraction, frequency, fuzzy, graph, merge, quality, sets, statistics, wikidata
from knotwork.plans import views
from knotwork.plans.lineage import keep, scratch
from knotwork.plans.schema import to_edge
from knotwork.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# Views of the test tables, as SQL.
EV = """ev AS (SELECT 'user_' || user_id AS head, 'User' AS head_type, event_type AS relation, 'k_' || k AS tail, 'Bucket ' || CAST(floor(k / 10.0) AS BIGINT) AS tail_type,
  strftime(ts, '%Y-%m-%d') AS source, event_id AS seq FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""
ST = """st AS (
  SELECT s_name AS head, 'Supplier' AS head_type, 'SUPPLIES' AS relation, p_name AS tail, p_type AS tail_type, l_returnflag AS source, l_orderkey * 16 + l_linenumber * 2 AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT c_name, c_mktsegment, 'ORDERED ' || p_brand, p_name, p_type, l_returnflag, l_orderkey * 16 + l_linenumber * 2 + 1
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
EVM = """mg AS (SELECT head, tail, string_agg(DISTINCT relation, ', ' ORDER BY relation) AS relation, string_agg(DISTINCT head_type, ', ' ORDER BY head_type) AS head_type,
  string_agg(DISTINCT tail_type, ', ' ORDER BY tail_type) AS tail_type, min(seq) AS first_seen, count(DISTINCT relation) AS nr, count(DISTINCT head_type) AS nh, count(DISTINCT tail_type) AS nt FROM {v} GROUP BY head, tail)"""
SMG, EMG = EVM.format(v="st"), EVM.format(v="ev")
TS = "ts AS MATERIALIZED (SELECT DISTINCT source, head, relation, tail FROM st)"
AN = """an AS (SELECT page_id, k, href, name, title FROM (
  SELECT page_id, unnest(range(1, len(h) + 1)) AS k, unnest(h) AS href, unnest(n) AS name, title FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS n,
      trim(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' - Vikipedi', '')) AS title FROM pages)))"""
ME = """me AS (SELECT page_id, title, CAST(page_id AS VARCHAR) || '#' || lpad(CAST(k AS VARCHAR), 4, '0') AS sent_id, trim(name) AS entity, lower(href) AS url, k FROM an WHERE trim(name) <> '' AND href <> '')"""


def _w(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _events(spark: SparkSession, d: str) -> DataFrame:
    return views.triples_events(spark, d)


def _star(spark: SparkSession, d: str) -> DataFrame:
    return views.triples_star(spark, d)


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return frequency.mentions(views.mention_sentences(spark, d))


# Merges


@query(_w(ST) + """SELECT entity, string_agg(DISTINCT t, ', ' ORDER BY t) AS entity_type FROM (SELECT head AS entity, head_type AS t FROM st UNION ALL SELECT tail, tail_type FROM st) WHERE t IS NOT NULL GROUP BY entity""")
def merge_entity_types(spark, d):
    return merge.joined(merge.merge_entity_types(_star(spark, d)), "entity_type")


@query(_w(EV, EMG) + "SELECT head, tail, relation, first_seen FROM mg")
def merge_relations(spark, d):
    return merge.joined(merge.merge_relations(merge.merge_relations_and_types(_events(spark, d))), "relation")


@query(_w(EV, EMG) + "SELECT head, tail, relation, head_type, tail_type, first_seen FROM mg")
def merge_relations_types(spark, d):
    return merge.joined(merge.merge_relations_and_types(_events(spark, d)), "relation", "head_type", "tail_type")


@query(_w(ST) + """, a AS (SELECT count(*) AS t FROM st), b AS (SELECT count(DISTINCT e) AS e FROM (SELECT head AS e FROM st UNION ALL SELECT tail FROM st)), c AS (SELECT count(*) AS p FROM (SELECT DISTINCT head, tail FROM st))
SELECT t AS total_original_records, e AS entity_types_count, p AS relations_count, p AS relations_and_types_count, t || ' -> ' || e AS entity_types_reduction, t || ' -> ' || p AS relations_reduction, t || ' -> ' || p AS relations_and_types_reduction FROM a, b, c""")
def merge_statistics(spark, d):
    return merge.merge_statistics(_star(spark, d))


@query(_w(EV, EMG) + "SELECT head, tail, relation, first_seen FROM mg ORDER BY first_seen, head, tail LIMIT 3")
def merged_preview(spark, d):
    return merge.joined(merge.first_rows(merge.merge_relations(merge.merge_relations_and_types(_events(spark, d)))), "relation")


# Sets


@query(_w(ST) + "SELECT DISTINCT source, head, relation, tail FROM st")
def triple_sets(spark, d):
    return sets.triple_sets(_star(spark, d))


@query(_w(ST, TS) + """, g AS MATERIALIZED (SELECT head, relation, tail, list(source ORDER BY source) AS s FROM ts GROUP BY head, relation, tail HAVING count(*) > 1),
p AS (SELECT *, unnest(range(1, len(s))) AS i FROM g), q AS (SELECT *, unnest(range(i + 1, len(s) + 1)) AS j FROM p)
SELECT s[i] AS source_a, s[j] AS source_b, head, relation, tail FROM q""")
def pairwise_intersections(spark, d):
    return sets.pairwise_intersections(sets.triple_sets(_star(spark, d)))


@query(_w(ST, TS) + "SELECT head, relation, tail FROM ts WHERE (SELECT count(DISTINCT source) FROM ts) = 3 GROUP BY head, relation, tail HAVING count(*) = 3")
def three_way_intersection(spark, d):
    return sets.three_way_intersection(sets.triple_sets(_star(spark, d)))


@query(_w(EV) + """, ts AS (SELECT DISTINCT source, head, relation, tail FROM ev), g AS (SELECT a.source AS source_a, b.source AS source_b FROM (SELECT DISTINCT source FROM ts) a, (SELECT DISTINCT source FROM ts) b),
c AS (SELECT a.source AS source_a, b.source AS source_b, count(*) AS n FROM ts a JOIN ts b USING (head, relation, tail) GROUP BY a.source, b.source)
SELECT g.source_a, g.source_b, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.source_a = c.source_a AND g.source_b = c.source_b""")
def overlap_matrix(spark, d):
    return sets.overlap_matrix(sets.triple_sets(_events(spark, d)))


@query(_w(EV) + "SELECT source, count(*) AS n FROM ev GROUP BY source")
def rows_per_source(spark, d):
    return sets.rows_per_source(_events(spark, d))


@query(_w(ST) + """, m AS (SELECT item, string_agg(DISTINCT source, ' & ' ORDER BY source) AS combination FROM (SELECT head AS item, source FROM st UNION ALL SELECT tail, source FROM st) GROUP BY item),
r AS (SELECT combination, item, row_number() OVER (PARTITION BY combination ORDER BY item) AS k, count(*) OVER (PARTITION BY combination) AS n FROM m)
SELECT combination, max(n) AS n, string_agg(item, ', ' ORDER BY item) || CASE WHEN max(n) > 20 THEN '...' ELSE '' END AS sample FROM r WHERE k <= 20 GROUP BY combination""")
def exclusive_intersections(spark, d):
    ends = _star(spark, d).select(F.explode(F.array("head", "tail")).alias("item"), "source")
    return sets.exclusive_intersections(ends, "item")


# Histograms, filters, summaries


@query(_w(ST) + "SELECT relation, count(*) AS n, min(seq) AS first_seen FROM st GROUP BY relation")
def relation_histogram(spark, d):
    return statistics.relation_histogram(_star(spark, d))


@query(_w(ST) + "SELECT t AS entity_type, count(*) AS n, min(o) AS first_seen FROM (SELECT head_type AS t, seq * 2 AS o FROM st UNION ALL SELECT tail_type, seq * 2 + 1 FROM st) GROUP BY t")
def type_histogram(spark, d):
    return statistics.type_histogram(_star(spark, d))


@query(_w(ST) + "SELECT relation, n FROM (SELECT relation, count(*) AS n, min(seq) AS f FROM st GROUP BY relation) ORDER BY n DESC, f, relation LIMIT 10")
def top_relations(spark, d):
    return statistics.top(statistics.relation_histogram(_star(spark, d)), "relation")


@query(_w(ST) + "SELECT entity_type, n FROM (SELECT t AS entity_type, count(*) AS n, min(o) AS f FROM (SELECT head_type AS t, seq * 2 AS o FROM st UNION ALL SELECT tail_type, seq * 2 + 1 FROM st) GROUP BY t) ORDER BY n DESC, f, entity_type LIMIT 10")
def top_entity_types(spark, d):
    return statistics.top(statistics.type_histogram(_star(spark, d)), "entity_type")


@query(_w(ST) + "SELECT source, head, head_type, relation, tail, tail_type, seq FROM st WHERE regexp_matches(head, 'supplier#.*1$', 'i') AND regexp_matches(relation, 'suppl', 'i') AND regexp_matches(tail, '[aeiou]n|red', 'i')")
def filter_triples(spark, d):
    return statistics.filter_triples(_star(spark, d), head="supplier#.*1$", relation="suppl", tail="[aeiou]n|red").select("source", "head", "head_type", "relation", "tail", "tail_type", "seq")


@query(_w(ST) + """, t AS (SELECT head_type AS t FROM st UNION SELECT tail_type FROM st) SELECT (SELECT count(*) FROM st) AS n_triples, (SELECT count(DISTINCT relation) FROM st) AS n_relations, (SELECT count(*) FROM t) AS n_types,
(SELECT string_agg(DISTINCT relation, ', ' ORDER BY relation) FROM st) AS relations, (SELECT string_agg(t, ', ' ORDER BY t) FROM t) AS types""")
def extraction_summary(spark, d):
    return statistics.extraction_summary(_star(spark, d))


# Merge quality


@query(_w(ST) + """, a AS (SELECT count(*) AS t FROM st), b AS (SELECT count(DISTINCT e) AS e FROM (SELECT head AS e FROM st UNION ALL SELECT tail FROM st)), c AS (SELECT count(*) AS p FROM (SELECT DISTINCT head, tail FROM st))
SELECT round((1 - e / CAST(t AS DOUBLE)) * 100, 2) AS entity_reduction, round((1 - p / CAST(t AS DOUBLE)) * 100, 2) AS relation_reduction, round((1 - p / CAST(t AS DOUBLE)) * 100, 2) AS full_reduction FROM a, b, c""")
def reduction_efficiency(spark, d):
    return quality.reduction_efficiency(merge.merge_statistics(_star(spark, d)))


_TYPES = _w(ST) + ", ty AS (SELECT DISTINCT entity, t FROM (SELECT head AS entity, head_type AS t FROM st UNION ALL SELECT tail, tail_type FROM st) WHERE t IS NOT NULL) "


@query(_TYPES + "SELECT t AS value, count(*) AS n FROM ty GROUP BY t")
def type_distribution(spark, d):
    return quality.value_distribution(quality.reread(merge.merge_entity_types(_star(spark, d)), "entity_type"), "entity_type")


@query(_TYPES + "SELECT entity, string_agg(t, ', ' ORDER BY t) AS entity_type, count(*) AS n FROM ty GROUP BY entity HAVING count(*) > 1")
def multi_type_entities(spark, d):
    return merge.joined(quality.multi_valued(merge.merge_entity_types(_star(spark, d)), "entity_type"), "entity_type")


@query(_w(EV) + "SELECT relation AS value, count(*) AS n FROM (SELECT DISTINCT head, tail, relation FROM ev) GROUP BY relation")
def relation_distribution(spark, d):
    return quality.value_distribution(quality.reread(merge.merge_relations_and_types(_events(spark, d)), "relation"), "relation")


@query(_w(EV, EMG) + "SELECT head, tail, relation, first_seen, nr AS n FROM mg WHERE nr > 1")
def multi_relation_pairs(spark, d):
    return merge.joined(quality.multi_valued(merge.merge_relations(merge.merge_relations_and_types(_events(spark, d))), "relation"), "relation")


@query(_w(ST) + "SELECT h || ' → ' || t AS combination, count(*) AS n FROM (SELECT DISTINCT a.head, a.tail, a.head_type AS h, b.tail_type AS t FROM (SELECT DISTINCT head, tail, head_type FROM st) a JOIN (SELECT DISTINCT head, tail, tail_type FROM st) b ON a.head = b.head AND a.tail = b.tail) GROUP BY 1")
def type_combinations(spark, d):
    return quality.type_combinations(merge.merge_relations_and_types(_star(spark, d)))


@query(_w(ST, SMG) + "SELECT head, tail, relation, head_type, tail_type, nr + nh + nt AS complexity FROM mg WHERE nr + nh + nt > 5")
def complex_records(spark, d):
    return merge.joined(quality.complex_records(merge.merge_relations_and_types(_star(spark, d))), "relation", "head_type", "tail_type").drop("first_seen")


def _partly_merged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Star triples, and the merge of those of two sources, with relations as the files' readers see them. Both come from one table, so the star is joined once; it has what is compared alone, as types and places would go through each shuffle of the joins."""
    t, _ = keep(_star(spark, d).select("head", "relation", "tail", "source"), "star")
    return t, quality.reread(merge.merge_values(t.where("source <> 'R'"), "relation"), "relation")


_PART = _w(ST) + ", mm AS (SELECT * FROM st WHERE source <> 'R'), eo AS (SELECT head AS entity FROM st UNION SELECT tail FROM st), em AS (SELECT head AS entity FROM mm UNION SELECT tail FROM mm) "


@query(_PART + """, c AS (SELECT (SELECT count(*) FROM eo) AS eo, (SELECT count(*) FROM em) AS em, (SELECT count(DISTINCT relation) FROM st) AS ro, (SELECT count(DISTINCT relation) FROM mm) AS rm,
(SELECT count(*) FROM (SELECT DISTINCT head, relation, tail FROM st)) AS t_o, (SELECT count(*) FROM (SELECT DISTINCT head, relation, tail FROM mm)) AS tm)
SELECT round(em * 100 / CAST(eo AS DOUBLE), 4) AS entity_coverage, round(rm * 100 / CAST(ro AS DOUBLE), 4) AS relation_coverage, round(tm * 100 / CAST(t_o AS DOUBLE), 4) AS triple_coverage,
eo AS original_entity_count, em AS merged_entity_count, ro AS original_relation_count, rm AS merged_relation_count FROM c""")
def coverage(spark, d):
    return quality.coverage(*_partly_merged(spark, d))


_LOST = _w(ST) + ", lo AS (SELECT head AS entity FROM st UNION SELECT tail FROM st EXCEPT (SELECT head FROM st WHERE relation = 'SUPPLIES' UNION SELECT tail FROM st WHERE relation = 'SUPPLIES')) "


def _lost(spark, d) -> DataFrame:
    """What a merge that has seen suppliers' triples alone lacks of all."""
    t, _ = keep(_star(spark, d).select("head", "relation", "tail"), "star")
    return quality.lost(t, merge.merge_values(t.where("relation = 'SUPPLIES'"), "relation"))


@query(_LOST + "SELECT entity FROM lo")
def lost_entities(spark, d):
    return _lost(spark, d)


@query(_LOST + "SELECT (SELECT count(*) FROM lo) AS n, string_agg(entity, '|' ORDER BY entity) AS entities FROM (SELECT entity FROM lo ORDER BY entity LIMIT 20)")
def first_lost(spark, d):
    return quality.first_entities(_lost(spark, d)).select("n", F.array_join("entities", "|").alias("entities"))


@query(_PART + "SELECT entity FROM em EXCEPT SELECT entity FROM eo WHERE entity NOT LIKE 'C%'")
def new_entities(spark, d):
    t, merged = _partly_merged(spark, d)
    return quality.new(t.where("head not like 'C%'"), merged)


@query(_w(EV, EMG) + """, ty AS (SELECT entity, string_agg(DISTINCT t, ', ' ORDER BY t) AS t FROM (SELECT head AS entity, head_type AS t FROM ev UNION ALL SELECT tail, tail_type FROM ev) GROUP BY entity)
SELECT head, coalesce(h.t, '') AS head_type, relation, tail, coalesce(x.t, '') AS tail_type FROM mg LEFT JOIN ty h ON h.entity = head LEFT JOIN ty x ON x.entity = tail""")
def typed_relations(spark, d):
    t = _events(spark, d)
    return quality.typed_relations(merge.merge_relations(merge.merge_relations_and_types(t)), merge.merge_entity_types(t))


# Mentions and frequencies


@query(_w(AN, ME) + "SELECT page_id, title, sent_id, entity, url FROM me")
def mentions(spark, d):
    return _mentions(spark, d).select("page_id", "title", "sent_id", "entity", "url")


@query(_w(AN, ME) + "SELECT page_id, entity, url, count(*) AS n_occurrences, string_agg(sent_id || ': See on ' || k || '.', ' | ' ORDER BY sent_id) AS sources FROM me GROUP BY page_id, entity, url")
def mention_freq(spark, d):
    return frequency.occurrence_frequency(_mentions(spark, d))


@query(_w(AN, ME) + "SELECT string_agg(DISTINCT entity, ' | ' ORDER BY entity) AS entities, url, count(*) AS n_sentences, string_agg(sent_id || ': See ' || entity || ' on ' || k || '.', ' | ' ORDER BY sent_id) AS sources FROM me GROUP BY url")
def url_rollup(spark, d):
    return frequency.url_rollup(_mentions(spark, d))


def _page_freq_sql(keys: str, where: str = "", least: int = 2) -> str:
    return _w(AN, ME) + f"""SELECT {keys}, count(DISTINCT page_id) AS n_pages, string_agg(DISTINCT title, ' | ' ORDER BY title) AS titles, array_to_string(list_sort(list(DISTINCT page_id)), ' | ') AS page_ids FROM me {where} GROUP BY {keys} HAVING count(DISTINCT page_id) >= {least}"""


@query(_page_freq_sql("entity"))
def page_freq_entity(spark, d):
    return frequency.page_frequency(_mentions(spark, d))


@query(_page_freq_sql("entity, url"))
def page_freq_pair(spark, d):
    return frequency.page_frequency(_mentions(spark, d), "entity", "url")


@query(_page_freq_sql("entity", "WHERE contains(lower(entity), 'the')", 1))
def search_entity(spark, d):
    return frequency.search_entity(_mentions(spark, d), " The")


@query(_w(AN, ME) + "SELECT entity, count(DISTINCT page_id) AS n_pages FROM me GROUP BY entity ORDER BY n_pages DESC, entity LIMIT 20")
def top_entities(spark, d):
    return frequency.top_entities(_mentions(spark, d))


@query(_w(AN, ME) + """SELECT page_id, title, count(DISTINCT entity) AS n_entities, count(DISTINCT entity || '|' || url) AS n_pairs, string_agg(DISTINCT entity, ' | ' ORDER BY entity) AS entities,
string_agg(DISTINCT entity || '|' || url, ' | ' ORDER BY entity || '|' || url) AS pairs FROM me GROUP BY page_id, title""")
def page_summary(spark, d):
    return frequency.page_summary(_mentions(spark, d))


@query(_w(AN, ME) + "SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT entity || '|' || url) AS n_pairs, count(DISTINCT page_id) AS n_pages FROM me")
def run_summary(spark, d):
    return frequency.run_summary(_mentions(spark, d))


# Text and pages


@query("SELECT event_id, 'a ' || event_type AS cleaned FROM events")
def clean_entity_text(spark, d):
    raw = F.concat(F.lit(" - = a   "), "event_type", F.lit(" = "), "props", F.lit(" <PossibleEntity>x</PossibleEntity> <URL>:(y)</URL> =-"))
    return views.table(spark, d, "events").select("event_id", T.clean_entity(raw).alias("cleaned"))


@query("SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS norm FROM part")
def normalize_entity(spark, d):
    return views.table(spark, d, "part").select("p_partkey", T.normalise_entity(F.concat(F.lit(" \t"), "p_name", F.lit(" \n "), "p_brand", F.lit(" "))).alias("norm"))


@query("SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g') || '.' AS text FROM documents")
def strip_citations(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.strip_citations(F.concat("text", F.lit("[12].[3]"))).alias("text"))


@query("SELECT page_id, trim(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' - Vikipedi', '')) AS title FROM pages")
def page_title(spark, d):
    return views.table(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query(_w(AN) + "SELECT page_id, k, 'https://tr.example.org' || href AS url FROM an")
def absolute_urls(spark, d):
    return views.anchors(spark, d).select("page_id", "k", T.absolute_url(F.col("href"), "https://tr.example.org").alias("url"))


@query(_w(AN) + "SELECT page_id, k, 'See ' || name || ' on ' || k || '.' AS named, 'See on ' || k || '.' AS bare FROM an")
def markup_text(spark, d):
    s = views.mention_sentences(spark, d)
    k = F.element_at(F.split("sent_id", "#"), -1).cast("long")
    return s.select("page_id", k.alias("k"), T.markup_to_entity(F.col("sentence")).alias("named"), T.without_markup(F.col("sentence")).alias("bare"))


_SPACE = r"[ \t\n\r\f\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LET = "a-zA-ZçğıöşüÇĞİÖŞÜ"
# dots that end nothing become U+E001, ends U+E002; before a short word stands the text's beginning or no letter, digit or _
_SPLIT = rf"""SELECT doc_id, 'doc' || doc_id || '#' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sent_id, s AS sentence FROM (
  SELECT doc_id, i, regexp_replace(replace(p, chr(57345), '.'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS s FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\p{{Nd}}+)\.({_SPACE}*[{_LET}])', '\1' || chr(57345) || '\2', 'g'),
        '(^|[^\p{{L}}\p{{N}}_])([{_LET}]{{1,4}})\.({_SPACE}*[{_LET}])', '\1\2' || chr(57345) || '\3', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '([.!?]){_SPACE}+([A-ZÇĞİÖŞÜ])', '\1' || chr(57346) || '\2', 'g'), chr(57346)) AS ps FROM documents))) WHERE s <> ''"""


@query(_SPLIT)
def split_sentences(spark, d):
    """Every document's sentences with their ids."""
    docs = views.table(spark, d, "documents").select("doc_id", S.sentences("text").alias("s"))
    return S.numbered(docs.withColumn("title", F.concat(F.lit("doc"), F.col("doc_id").cast("string"))), "title", "s").select("doc_id", "sent_id", "sentence")


@query()
def html_paragraphs(spark, d):
    """Paragraphs of every page's article, as sentences."""
    p = views.table(spark, d, "pages").select("page_id", F.posexplode(H.paragraphs_udf("https://tr.example.org/", "article p")("html")).alias("k", "paragraph"))
    return p.select("page_id", "k", "paragraph")


@query("""SELECT n_nationkey, key, value FROM nation, (VALUES ('Name'), ('Region'), ('Name (2)')) k(key), LATERAL (SELECT CASE key WHEN 'Name' THEN n_name WHEN 'Name (2)' THEN ''
ELSE '<PossibleEntity>region</PossibleEntity> <URL>:(https://tr.example.org/r' || n_regionkey || ')</URL> x more' END AS value)""")
def infobox(spark, d):
    """Key-value cards of a box built around every nation."""
    n = views.table(spark, d, "nation")
    page = F.concat(F.lit('<table class="infobox vcard"><tr><th>Name</th><td>'), "n_name", F.lit('[1]</td></tr><tr><th>Region</th><td><a href="/r'), F.col("n_regionkey").cast("string"), F.lit('">region</a><br>x</td></tr><tr><td>more</td></tr><tr><th>Name</th></tr></table>'))
    return n.select("n_nationkey", F.explode(H.infobox_udf("https://tr.example.org")(page)).alias("c")).select("n_nationkey", "c.key", "c.value")


# Graphs


_LK = """lk AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"""


@query("WITH RECURSIVE " + _LK + ", b AS (SELECT 'c1' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN lk ON src = url WHERE depth < 3) SELECT url, CAST(min(depth) AS INT) AS depth FROM b GROUP BY url")
def bfs_depth(spark, d):
    root = spark.range(1).select(F.lit("c1").alias("url"))
    return graph.bfs_depths(views.links_star(spark, d), root, 3)


_CL = """cl AS (SELECT s_suppkey, 'Q1' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS label, 'Q' || s_nationkey AS nation, s_name FROM supplier),
ce AS (SELECT id AS src, nation AS dst, 'P17' AS property, 'item' AS kind FROM cl UNION ALL SELECT id, 'P1448:' || s_name, 'P1448', 'literal' FROM cl)"""


@query(_w(_CL) + "SELECT src, dst, property, kind FROM ce")
def graph_edges(spark, d):
    return graph.claim_edges(graph.parse_claims(views.claim_docs(spark, d))).select("src", "dst", "property", "kind")


@query(_w(_CL) + "SELECT id, coalesce(label, id) AS label FROM cl UNION SELECT nation, nation FROM cl UNION SELECT 'P1448:' || s_name, s_name FROM cl")
def graph_nodes(spark, d):
    return graph.graph_nodes(graph.parse_claims(views.claim_docs(spark, d))).select("id", "label")


@query(_w(_CL) + "SELECT (SELECT count(*) FROM (SELECT src FROM ce UNION SELECT dst FROM ce)) AS n_nodes, (SELECT count(*) FROM ce) AS n_edges")
def graph_counts(spark, d):
    claims = graph.parse_claims(views.claim_docs(spark, d))
    return graph.graph_counts(graph.graph_nodes(claims), graph.claim_edges(claims))


@query(_w(_CL) + """, no AS (SELECT id, min(o) AS o FROM (SELECT id, s_suppkey * 3 AS o FROM cl UNION ALL SELECT nation, s_suppkey * 3 + 1 FROM cl UNION ALL SELECT 'P1448:' || s_name, s_suppkey * 3 + 2 FROM cl) GROUP BY id),
f AS (SELECT id FROM no ORDER BY o, id LIMIT 40) SELECT src, dst, property FROM ce WHERE src IN (SELECT id FROM f) AND dst IN (SELECT id FROM f)""")
def induced_subgraph(spark, d):
    """The edges between the first 40 nodes."""
    claims = graph.parse_claims(views.claim_docs(spark, d))
    return graph.induced_subgraph(graph.graph_nodes(claims), graph.claim_edges(claims))[1].select("src", "dst", "property")


@query("SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 50 AS BIGINT) AS batch, id FROM (SELECT DISTINCT 'Q' || l_partkey AS id FROM lineitem)")
def claim_batches(spark, d):
    ids = T.q_number(F.concat(F.lit(" q"), F.col("l_partkey").cast("string")))
    return graph.batches(views.table(spark, d, "lineitem").select(ids.alias("id")).distinct(), "id").select("batch", F.explode("ids").alias("id"))


# Wikidata


_WD = """na AS (SELECT 'Q1' || n_nationkey AS id, n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'tr ' || lower(n_name) ELSE n_name END AS label, 'Q5' || n_regionkey AS region, n_regionkey FROM nation),
ty AS (SELECT id, 'ülke' AS t FROM na UNION ALL SELECT id, 'QT2' FROM na WHERE k % 3 = 0)"""


@query(_w(_WD) + """SELECT s_name AS head, 'Belirtilmemiş' AS head_type, 'ülkesi' AS relation, label AS tail, t AS tail_type FROM supplier JOIN na ON s_nationkey = k JOIN ty USING (id)
UNION ALL SELECT label, t, 'continent', CASE WHEN n_regionkey < 3 THEN r_name ELSE region END, 'Belirtilmemiş' FROM na JOIN ty USING (id) JOIN region ON n_regionkey = r_regionkey""")
def wikidata_triples(spark, d):
    return wikidata.typed_triples(*views.wikidata_tables(spark, d))


@query("""SELECT 'ülkesi' AS prop_label, 'http://www.wikidata.org/entity/Q1' || s_nationkey AS value, CASE WHEN n_nationkey % 2 = 0 THEN 'tr ' || lower(n_name) ELSE n_name END AS value_label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 7
UNION ALL SELECT 'P1448', s_name, s_name FROM supplier WHERE s_suppkey = 7""")
def entity_claims(spark, d):
    claims, props, labels, _ = views.wikidata_tables(spark, d)
    return wikidata.entity_claims(claims, props, labels, "Q97")


@query("SELECT 'Q97' AS id UNION SELECT 'Q1' || s_nationkey FROM supplier WHERE s_suppkey = 7")
def related_ids(spark, d):
    return wikidata.related_ids(views.wikidata_tables(spark, d)[0], "Q97")


@query(_w(_WD) + """SELECT id, label AS label_tr, CASE WHEN k < 10 THEN 'country ' || k ELSE 'No description available.' END AS description_tr FROM na
UNION ALL SELECT 'Q9' || s_suppkey, s_name, 'No description available.' FROM supplier UNION ALL SELECT 'Q5' || r_regionkey, r_name, 'No description available.' FROM region WHERE r_regionkey < 3
UNION ALL SELECT * FROM (VALUES ('P17', 'ülkesi', 'No description available.'), ('P30', 'continent', 'No description available.'), ('QT1', 'ülke', 'No description available.'))""")
def label_fallback(spark, d):
    n = views.table(spark, d, "nation")
    texts = n.where("n_nationkey < 10").select(F.concat(F.lit("Q1"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("en").alias("lang"), F.concat(F.lit("country "), F.col("n_nationkey").cast("string")).alias("description"))
    return wikidata.descriptions(views.wikidata_tables(spark, d)[2], texts)


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Q0' ELSE s_name END AS head, 'Belirtilmemiş' AS head_type, 'Bilinmeyen İlişki' AS relation, 'N' || s_nationkey AS tail, 'Belirtilmemiş' AS tail_type FROM supplier")
def parse_bindings(spark, d):
    s = views.table(spark, d, "supplier")
    own = F.when(F.col("s_suppkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit('"sourceLabel":{"value":"'), "s_name", F.lit('"},')))
    answer = F.concat(F.lit('{"results":{"bindings":[{'), own, F.lit('"targetLabel":{"value":"N'), F.col("s_nationkey").cast("string"), F.lit('"}}]}}'))
    return wikidata.parse_bindings(s.select(answer.alias("json")), entity="Q0")


# Fuzzy clusters


def _page_entities(spark, d) -> DataFrame:
    return quality.entities(views.triples_pages(spark, d))


@query()
def similar_entities(spark, d):
    return fuzzy.similar_entities(_page_entities(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@query()
def entity_clusters(spark, d):
    e = _page_entities(spark, d)
    return fuzzy.clusters(e, fuzzy.similar_entities(e)).select("seed", "head", "entity", "members")


@query()
def relation_conflicts(spark, d):
    t = views.triples_pages(spark, d)
    e = quality.entities(t)
    return fuzzy.relation_conflicts(t, fuzzy.clusters(e, fuzzy.similar_entities(e)))


# Model answers


@query("SELECT c_custkey AS id, c_name AS head, 'Customer' AS head_type, 'from' AS relation, 'N' || c_nationkey AS tail, CAST(NULL AS VARCHAR) AS tail_type, 'said of ' || c_name AS text FROM customer WHERE c_custkey % 4 <> 3")
def parse_llm_response(spark, d):
    c = views.table(spark, d, "customer")
    body = F.concat(F.lit('[{"baş":"'), "c_name", F.lit('","baş_tipi":"Customer","ilişki":"from","uç":"N'), F.col("c_nationkey").cast("string"), F.lit('"}]'))
    k = F.col("c_custkey") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("```\n"), body, F.lit("\n``` done"))).otherwise(F.concat(F.lit("no list: "), body))
    rows = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("said of "), "c_name").alias("said"), answer.alias("answer"))
    return extraction.parse_answers(rows, text="said").select("id", "head", "head_type", "relation", "tail", "tail_type", "text")


_EXAMPLES = [{"baş": "A", "ilişki": "r", "uç": "B"}]
_PROMPT = json.dumps(_EXAMPLES, ensure_ascii=False, indent=2)


@query(f"SELECT p_partkey AS id, 'system' || chr(10) || chr(10) || 'Örnek çıktı:' || chr(10) || '{_PROMPT}' || chr(10) || CASE WHEN p_size > 25 THEN chr(10) || 'Tam ' || p_size || ' ayrı ilişki türü bul.' || chr(10) ELSE '' END || chr(10) || 'Metin:' || chr(10) || p_name || chr(10) || chr(10) || 'Yanıt yalnız bir JSON listesi olsun.' || chr(10) AS prompt FROM part")
def build_prompt(spark, d):
    p = views.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), extraction.prompt(F.col("p_name"), "system", _EXAMPLES, F.when(F.col("p_size") > 25, F.col("p_size"))).alias("prompt"))


@query("SELECT p_partkey AS id, p_name AS text FROM part UNION ALL SELECT p_partkey, p_type FROM part")
def text_parts(spark, d):
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" | ", F.concat(F.lit("  "), "p_name"), F.lit(" "), "p_type").alias("text"))
    return extraction.parts(p)


@query("SELECT event_id AS id, event_type AS value FROM events UNION ALL SELECT event_id, props FROM events")
def multi_value_split(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.col("event_type"), F.lit(" , , "), "props").alias("v"))
    return e.select("id", F.explode(T.split_values(F.col("v"))).alias("value"))


# Files: test tables written by the sinks and read back


def _triple_folder(spark, d) -> str:
    """Two files with triples of every part, in order of its key, and one that is no JSON."""
    folder = scratch(spark, "triples")
    p = views.table(spark, d, "part").orderBy("p_partkey", "p_name")
    text = lambda c: F.lit(c).cast("string")
    for name, head_type, relation, tail_type in (("brands", "Part", "HAS", "Brand"), ("makers", "Item", "IS OF, BY", "Maker")):
        rows = p.select(F.col("p_name").alias("head"), text(head_type).alias("head_type"), text(relation).alias("relation"), F.col("p_brand").alias("tail"), F.when(F.col("p_size") % 2 == 0, text(tail_type)).alias("tail_type"))
        sinks.write_json_list(to_edge(rows), f"{folder}/{name}.json")
    with sinks.writing(spark, f"{folder}/none.json") as out:
        out.write("{")
    return folder


_TF = """tf AS (SELECT s AS source, p_name AS head, h AS head_type, r AS relation, p_brand AS tail, CASE WHEN p_size % 2 = 0 THEN t END AS tail_type, row_number() OVER (PARTITION BY s ORDER BY p_partkey, p_name) - 1 AS k
  FROM part, (VALUES ('brands', 'Part', 'HAS', 'Brand'), ('makers', 'Item', 'IS OF, BY', 'Maker')) v(s, h, r, t))"""


@query(_w(_TF) + "SELECT source, head, head_type, relation, tail, tail_type, k AS seq FROM tf")
def triple_files(spark, d):
    """All triples of a folder; the broken file gives none."""
    return readers.read_triples(spark, _triple_folder(spark, d)).select("source", "head", "head_type", "relation", "tail", "tail_type", "seq")


@query(_w(_TF) + "SELECT source, head, tail, k + CASE source WHEN 'brands' THEN 1099511627776 ELSE 0 END AS seq FROM tf")
def triple_file_list(spark, d):
    """Files in the order of a list, of which one isn't there."""
    folder = _triple_folder(spark, d)
    return readers.read_triple_files(spark, [f"{folder}/{n}.json" for n in ("gone", "makers", "brands")]).select("source", "head", "tail", "seq")


@query("SELECT 'none' AS source")
def bad_files(spark, d):
    return readers.bad_files(spark, _triple_folder(spark, d))


@query(_w(_TF) + """SELECT head, tail, string_agg(DISTINCT relation, ', ' ORDER BY relation) AS relation, string_agg(DISTINCT head_type, ', ' ORDER BY head_type) AS head_type,
string_agg(DISTINCT tail_type, ', ' ORDER BY tail_type) AS tail_type FROM tf GROUP BY head, tail""")
def merge_run(spark, d):
    """A whole merge run over a folder, its merged table read back."""
    done = runs.merge_folder(spark, _triple_folder(spark, d))
    return readers.read_merged(spark, done.folder)["relations_and_types_merged"].select(F.col("`baş`").alias("head"), F.col("`uç`").alias("tail"), F.col("`ilişki`").alias("relation"), F.col("`baş_tipi`").alias("head_type"), F.col("`uç_tipi`").alias("tail_type"))


@query(_w(_TF) + """, e AS (SELECT count(DISTINCT x) AS n FROM (SELECT head AS x FROM tf UNION ALL SELECT tail FROM tf WHERE tail_type IS NOT NULL)), p AS (SELECT count(*) AS n FROM (SELECT DISTINCT head, tail FROM tf)), t AS (SELECT count(*) AS n FROM tf)
SELECT t.n AS total_original_records, e.n AS entity_types_count, p.n AS relations_count, t.n || ' -> ' || p.n AS relations_reduction FROM e, p, t""")
def merge_run_statistics(spark, d):
    """The statistics file of a merge run, read back."""
    s = readers.read_merged(spark, runs.merge_folder(spark, _triple_folder(spark, d)).folder)["statistics"]
    return s.select("merge_statistics.total_original_records", "merge_statistics.entity_types_count", "merge_statistics.relations_count", "merge_efficiency.relations_reduction")


@query("SELECT c_name AS name, 'said \"' || c_mktsegment || '\",' || chr(10) || 'twice' AS note FROM customer")
def csv_file(spark, d):
    """A CSV file with a byte-order mark, quotes and line ends, read back."""
    rows = views.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit('said "'), "c_mktsegment", F.lit('",\ntwice')).alias("note"))
    sinks.write_csv_file(rows, to := scratch(spark, "csv") + "/customers.csv")
    return readers.read_csv(spark, to)


@query("SELECT 'sellers' AS source, s_name AS item FROM supplier UNION ALL SELECT 'nations', n_name FROM nation")
def entity_set_files(spark, d):
    """The entity columns of CSV files; one file has none."""
    folder = scratch(spark, "sets")
    for name, table, column, own in (("sellers", "supplier", "s_name", "E"), ("nations", "nation", "n_name", "E"), ("regions", "region", "r_name", "K")):
        sinks.write_csv_file(views.table(spark, d, table).select(F.col(column).alias(own)), f"{folder}/{name}.csv")
    return readers.read_entity_sets(spark, [f"{folder}/{n}.csv" for n in ("sellers", "nations", "regions")])


@query("SELECT DISTINCT 'Q' || l_partkey AS id FROM lineitem")
def id_file(spark, d):
    sinks.write_ids(views.table(spark, d, "lineitem").select(F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("id")), to := scratch(spark, "ids"))
    return readers.valid_q_ids(readers.read_q_ids(spark, to))


@query("""SELECT 'Wiki_nations' AS page_id, n_name AS title, n_name || '#1' AS sent_id, 'In region ' || n_regionkey || '.' AS sentence FROM nation
UNION ALL SELECT 'Wiki_nations', n_name, n_name || 'Card#1', 'key ' || n_nationkey FROM nation UNION ALL SELECT 'Wiki_nations', n_name, n_name || 'Card#2', n_name FROM nation""")
def page_files(spark, d):
    """Page documents as files, read back as sentences."""
    n = views.table(spark, d, "nation")
    main = F.array(F.struct(F.concat("n_name", F.lit("#1")).alias("id"), F.concat(F.lit("In region "), F.col("n_regionkey").cast("string"), F.lit(".")).alias("sentence")))
    card = F.create_map(F.lit("k"), F.concat(F.lit("key "), F.col("n_nationkey").cast("string")), F.lit("n"), F.col("n_name"))
    folder = scratch(spark, "pages")
    sinks.write_json_list(n.select(F.col("n_name").alias("Title"), card.alias("Card"), main.alias("Main")), f"{folder}/Wiki_nations.json")
    return readers.page_sentences(readers.read_pages(spark, f"{folder}/Wiki_*.json"))


@query(_w(_CL) + "SELECT src, dst, property, kind FROM ce")
def claims_file(spark, d):
    """All suppliers' claims as one document in a file, read back as edges."""
    to = scratch(spark, "claims") + "/claims.json"
    sinks.write_lines(spark, to, "{", views.claim_docs(spark, d).select("json").rdd.map(lambda r: r.json[1:-1]), "}", between=",")
    return graph.claim_edges(graph.parse_claims(readers.read_claims(spark, to))).select("src", "dst", "property", "kind")


@query("SELECT c_name AS head, 'N' || c_nationkey AS tail, '' AS tail_type, 'said of ' || c_name AS text FROM customer WHERE c_custkey % 4 <> 3")
def clean_file(spark, d):
    """Clean triples of the model's answers in a file, read back."""
    found = parse_llm_response(spark, d).orderBy("id")
    to = sinks.write_clean(found, scratch(spark, "answers") + "/answers.json")
    return readers.read_triple_files(spark, [to]).select("head", "tail", "tail_type", "text")


@query(_w(_CL) + "SELECT src, dst, property FROM ce")
def gexf_file(spark, d):
    """A graph file's edges, read back."""
    claims, _ = keep(graph.parse_claims(views.claim_docs(spark, d)), "claims")
    sinks.write_gexf(graph.graph_nodes(claims).orderBy("first_seen", "id"), graph.claim_edges(claims).orderBy("order"), to := scratch(spark, "graph") + "/graph.gexf")
    line = spark.read.text(to).where("value like '<edge %'")
    part = lambda name: F.regexp_extract("value", rf' {name}="([^"]*)"', 1)
    return line.select(part("source").alias("src"), part("target").alias("dst"), F.regexp_extract("value", r'for="0" value="([^"]*)"', 1).alias("property"))


@query("SELECT c_name || '#1' AS sent_id, c_mktsegment AS entity, 'https://tr.example.org/n' || c_nationkey AS url FROM customer UNION ALL SELECT c_name || '#1', 'again', 'http://x.example.org/' || c_custkey FROM customer")
def legacy_mentions(spark, d):
    """Mentions in the older markup, by the parser of both."""
    c = views.table(spark, d, "customer")
    s = F.concat(F.lit("Sold to ___E:"), "c_mktsegment", F.lit(" U:(https://tr.example.org/n"), F.col("c_nationkey").cast("string"), F.lit(")___ and ___E: again  U:(http://x.example.org/"), F.col("c_custkey").cast("string"), F.lit(")___, ___E:no U:(ftp://y)___."))
    rows = c.select(F.lit("p").alias("page_id"), F.lit("t").alias("title"), F.concat("c_name", F.lit("#1")).alias("sent_id"), s.alias("sentence"))
    return frequency.mentions(rows, legacy=True).select("sent_id", "entity", "url")


@query(_w(AN) + "SELECT page_id, k, href AS dst FROM an WHERE starts_with(href, '/t')")
def same_site_links(spark, d):
    return graph.same_site(views.anchors(spark, d).select("page_id", "k", F.col("href").alias("dst")), "/t")


@query(_w(EV) + """, ts AS (SELECT DISTINCT source, head || ' ' || relation || ' ' || tail AS t FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t) AS k, count(*) OVER (PARTITION BY source) AS n FROM ts)
SELECT source, string_agg(t, chr(10) ORDER BY t) || CASE WHEN max(n) > 5 THEN chr(10) || '... ' || (max(n) - 5) || ' more' ELSE '' END AS hover FROM r WHERE k <= 5 GROUP BY source""")
def hover_previews(spark, d):
    """The first triples of each source, and how many more there are."""
    ts = sets.triple_sets(_events(spark, d)).groupBy("source").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "head", "relation", "tail"))).alias("t"))
    return ts.select("source", T.hover(F.col("t")).alias("hover"))


# Runs


def _web(spark, d) -> DataFrame:
    """(url, html): a page for each region that links to its nations, for each nation that links to its suppliers, and for each supplier."""
    r, n, s = (views.table(spark, d, t) for t in ("region", "nation", "supplier"))
    page = lambda title, body: F.concat(F.lit("<title>"), title, F.lit(' - Vikipedi</title><div id="mw-content-text"><p>'), body, F.lit("</p></div>"))
    link = lambda lead, key, name: F.concat(F.lit(f'Bkz <a href="/{lead}'), F.col(key).cast("string"), F.lit('">'), name, F.lit("</a> burada."))
    url = lambda lead, key: F.concat(F.lit(f"https://tr.example.org/{lead}"), F.col(key).cast("string")).alias("url")
    listed = lambda df, key, of: df.groupBy(F.col(key).alias("key")).agg(F.array_join(F.array_sort(F.collect_list(of)), " ").alias("body"))
    regions = r.join(listed(n, "n_regionkey", link("n", "n_nationkey", F.col("n_name"))), F.col("r_regionkey") == F.col("key")).select(url("r", "r_regionkey"), page(F.col("r_name"), F.col("body")).alias("html"))
    nations = n.join(listed(s, "s_nationkey", link("s", "s_suppkey", F.col("s_name"))), F.col("n_nationkey") == F.col("key"), "left").select(url("n", "n_nationkey"), page(F.col("n_name"), F.coalesce("body", F.lit("Yok."))).alias("html"))
    return regions.unionByName(nations).unionByName(s.select(url("s", "s_suppkey"), page(F.col("s_name"), F.lit("Son.")).alias("html")))


@query("""SELECT 'https://tr.example.org/r0' AS url, 0 AS depth UNION ALL SELECT 'https://tr.example.org/n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 'https://tr.example.org/s' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0""")
def crawl_run(spark, d):
    """Depths of a crawl that parses pages, finds their mentions, follows them and writes its tables."""
    return runs.crawl_report(_web(spark, d), "https://tr.example.org/r0", 3, "https://tr.example.org", scratch(spark, "crawl")).depths


@query("""SELECT 'https://tr.example.org/s' || s_suppkey AS url, s_name AS entities, 1 AS n_sentences FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0
UNION ALL SELECT 'https://tr.example.org/n' || n_nationkey, n_name, 1 FROM nation WHERE n_regionkey = 0""")
def crawl_run_urls(spark, d):
    """The roll-up by url that a crawl writes, read back."""
    runs.crawl_report(_web(spark, d), "https://tr.example.org/r0", 3, "https://tr.example.org", folder := scratch(spark, "crawl"))
    return readers.read_csv(spark, f"{folder}/urls").select("url", "entities", F.col("n_sentences").cast("int").alias("n_sentences"))


def _echo(prompts: list[str]) -> list[str]:
    """A model that finds one triple in each text: its first and last word, by the number of relations that is wanted."""
    texts = [p.split("Metin:\n")[1].split("\n")[0].split(" ") for p in prompts]
    wanted = [p.split("Tam ")[1].split(" ")[0] if "Tam " in p else "0" for p in prompts]
    return [json.dumps([{"baş": t[0], "ilişki": n, "uç": t[-1]}]) for t, n in zip(texts, wanted, strict=True)]


@query("""SELECT 'parts' AS source, split_part(t, ' ', 1) AS head, CAST(p_size AS VARCHAR) AS relation, split_part(t, ' ', -1) AS tail, t AS text FROM (SELECT p_size, unnest([p_name, p_type || ' end']) AS t FROM part)""")
def extract_run(spark, d):
    """A frequency table's texts through the whole extraction, with a stand-in for the model."""
    p = views.table(spark, d, "part")
    rows = p.select(F.col("p_name").alias("E"), F.lit("u").alias("U"), F.col("p_size").alias("Frekans"), F.concat_ws(" | ", "p_name", F.lit(" "), F.concat("p_type", F.lit(" end"))).alias("Kaynak_IDler"))
    sinks.write_csv_file(rows, to := scratch(spark, "tables") + "/parts.csv")
    return runs.extract_csv(spark, to, _echo, "system", _EXAMPLES).select("source", "head", "relation", "tail", "text")

"""Golden cases, properties and edges of the core operators."""

import csv
import json
import random
import re
from itertools import combinations
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from knotwork import runs
from knotwork.functions import text as T
from knotwork.functions.html import infobox, paragraphs
from knotwork.functions.sentences import sentences, split_sentences
from knotwork.functions.similarity import common_length, ratio
from knotwork.operators import crawl, extraction, frequency, fuzzy, graph, merge, quality, sets, statistics, wikidata
from knotwork.plans import lineage
from knotwork.plans.ranking import with_rank
from knotwork.plans.schema import TRIPLE, quarantine, require_keys
from knotwork.sources import readers, sinks
from knotwork.streaming import merge as stream

ROWS = [
    ("Ada", "Kişi", "yazdı", "Not", "Eser", None, "a", 0),
    ("Ada", "insan", "yazdı", "Not", "Eser", None, "b", 1),
    ("Ada", "Kişi", "konuştuğu, yazdığı diller", "Not", None, None, "b", 2),
    ("Can", None, "bildi", "Ada", "Kişi", None, "a", 3),
    ("Can", "", "bildi", "Ada", "Kişi", None, "c", 4),
    ("Ada", "Kişi", "yazdı", "Not", "Eser", None, "a", 5),
]


@pytest.fixture
def triples(spark):
    return spark.createDataFrame(ROWS, TRIPLE)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_merges(triples):
    types = rows(merge.joined(merge.merge_entity_types(triples), "entity_type"), "entity", "entity_type")
    assert types == [("Ada", "Kişi, insan"), ("Can", ""), ("Not", "Eser")]
    full = merge.merge_relations_and_types(triples)
    assert rows(merge.joined(full, "relation", "head_type", "tail_type"), "head", "tail", "relation", "head_type", "first_seen") == [("Ada", "Not", "konuştuğu, yazdığı diller, yazdı", "Kişi, insan", 0), ("Can", "Ada", "bildi", "", 3)]
    assert merge.merge_relations(full).count() == full.count()
    s = merge.merge_statistics(triples).first()
    assert (s.total_original_records, s.entity_types_count, s.relations_count, s.relations_reduction) == (6, 3, 2, "6 -> 2")


def test_merge_is_idempotent_and_foldable(spark, triples):
    full = merge.merge_relations_and_types(triples)
    again = full.select("head", "tail", F.explode("relation").alias("relation"), F.explode_outer("head_type").alias("head_type"), F.lit(None).cast("string").alias("tail_type"), F.lit(0).cast("long").alias("seq"))
    assert rows(merge.merge_relations_and_types(again), "head", "tail", "relation") == rows(full, "head", "tail", "relation")
    folded = stream.fold(merge.merge_relations_and_types(triples.where("seq < 2")), merge.merge_relations_and_types(triples.where("seq >= 2")))
    assert rows(folded, "head", "tail", "relation", "head_type", "tail_type", "first_seen") == rows(full, "head", "tail", "relation", "head_type", "tail_type", "first_seen")


def test_stream_equals_batch(spark, triples, tmp_path):
    triples.write.json(str(tmp_path / "in"))
    q = stream.merged_stream(spark.readStream.schema(TRIPLE).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("m").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("m"), "head", "tail", "relation") == rows(merge.merge_relations_and_types(triples), "head", "tail", "relation")


def test_missing_keys(spark):
    df = spark.createDataFrame([("a", None, "r", None, None, None, "s", 0), ("a", None, "r", "b", None, None, "s", 1)], TRIPLE)
    assert require_keys(df).count() == 1
    assert quarantine(df).count() == 1
    with pytest.raises(Exception, match="lacks"):
        require_keys(df, strict=True).collect()


def test_sets(triples):
    ts = sets.triple_sets(triples)
    assert ts.count() == 5
    overlaps = {(r.source_a, r.source_b): r.n for r in sets.overlap_matrix(ts).collect()}
    assert overlaps["a", "b"] == overlaps["b", "a"] == 1
    assert (overlaps["a", "a"], overlaps["b", "b"], overlaps["b", "c"]) == (2, 2, 0)
    assert rows(sets.pairwise_intersections(ts), "source_a", "source_b", "relation") == [("a", "b", "yazdı"), ("a", "c", "bildi")]
    assert sets.three_way_intersection(ts).count() == 0
    ends = triples.select(F.explode(F.array("head", "tail")).alias("item"), "source")
    table = sets.exclusive_intersections(ends, "item", sample=1)
    assert sum(r.n for r in table.collect()) == 3
    assert {r.combination: r.sample for r in table.collect()} == {"a & b & c": "Ada", "a & c": "Can", "a & b": "Not"}
    assert sets.difference(ts.where("source = 'a'").drop("source"), ts.where("source = 'b'").drop("source")).count() == 1


def test_statistics(triples):
    assert rows(statistics.top(statistics.relation_histogram(triples), "relation", 2), "relation", "n") == [("bildi", 2), ("yazdı", 3)]
    assert dict(rows(statistics.type_histogram(triples), "entity_type", "n"))["Bilinmiyor"] == 2
    assert statistics.filter_triples(triples, head="aDA", relation="YAZDI$").count() == 3
    assert statistics.filter_triples(triples, head_type=".").count() == 4
    s = statistics.extraction_summary(triples).first()
    assert (s.n_triples, s.n_relations, s.n_types) == (6, 3, 4)



def test_quality(spark, triples):
    full = merge.merge_relations_and_types(triples)
    seen = quality.reread(full, "relation")
    assert dict(rows(quality.value_distribution(seen, "relation"), "value", "n")) == {"bildi": 1, "konuştuğu": 1, "yazdığı diller": 1, "yazdı": 1}
    assert rows(quality.type_combinations(full), "combination", "n") == [(" → Kişi", 1), ("Kişi → Eser", 1), ("insan → Eser", 1)]
    c = quality.coverage(triples, seen).first()
    assert (c.entity_coverage, c.original_relation_count, c.merged_relation_count) == (100.0, 3, 4)
    assert c.relation_coverage == pytest.approx(66.6667)
    assert quality.coverage(triples, full).first().triple_coverage == 100.0
    assert quality.lost(triples, full.where("head = 'Can'")).collect()[0].entity == "Not"
    assert quality.complex_records(full, 4).first().complexity == 5
    assert quality.reduction_efficiency(merge.merge_statistics(triples.where("false"))).first().entity_reduction == 0.0
    typed = rows(quality.typed_relations(merge.merge_relations(full), merge.merge_entity_types(triples)), "head", "head_type", "tail", "tail_type")
    assert typed == [("Ada", "Kişi, insan", "Not", "Eser"), ("Can", "", "Ada", "Kişi, insan")]


def one(spark, c, *values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "v string").select(c(F.col("v")).alias("x")).collect()]


def test_text_functions(spark):
    assert one(spark, T.normalise_entity, "  Ada\t LOVELACE ", None) == ["ada lovelace", ""]
    assert one(spark, T.clean_entity, " = a  b = c -", "=x", "= = y", "", "p=<PossibleEntity>q</PossibleEntity> <URL>:(u)</URL>") == ["a b", "x", "y", "", "p"]
    assert one(spark, T.strip_citations, "a[12]  b[x]") == ["a b[x]"]
    assert one(spark, T.page_title, "<title> A - Vikipedi</title>", "<p>") == ["A", "Başlık Bulunamadı"]
    assert one(spark, T.bare_url, "(http://x/(y))", "z") == ["http://x/(y)", "z"]
    assert one(spark, T.q_number, " q12 ", "Q1x", "12") == ["Q12", None, None]
    assert one(spark, lambda c: T.absolute_url(c, "https://h.org"), "/a", "//b/c", "http://d", "e") == ["https://h.org/a", "https://b/c", "http://d", "https://h.org/e"]
    assert one(spark, T.unfenced, "[1]", "x ```json\n[1]\n``` y", "```\n[2]```", None) == ["[1]", "[1]", "[2]", None]
    assert one(spark, T.split_values, "a,  b, , c", "") == [["a", "b", "c"], []]
    assert one(spark, lambda c: T.matches(c, "messi"), "MESSİ", None) == [True, False]
    assert one(spark, lambda c: T.preview(F.split(c, ""), 2), "abc", "ab") == ["a, b...", "a, b"]
    assert one(spark, lambda c: T.hover(F.split(c, ""), 2), "abcd") == ["a\nb\n... 2 more"]


def test_urls_are_joined_as_the_library_does(spark):
    rng = random.Random(8)
    bits = ["a", "b.c", "..", ".", "/", "?q=1", "#p", "x y"]
    hrefs = sorted({"".join(rng.choice(bits) + rng.choice(["/", "/", ""]) for _ in range(rng.randint(1, 5))) for _ in range(400)} | {"/..", "/../x", "a/..", ".", "..", "?q", "#p"})
    hrefs = [h for h in hrefs if "//" not in h]
    got = one(spark, lambda c: T.absolute_url(c, "https://h.org", "/d/e/", "/d/e/page"), *hrefs)
    assert got == [urljoin("https://h.org/d/e/page", h) for h in hrefs]


M = "<PossibleEntity>{}</PossibleEntity> <URL>:({})</URL>"


def test_sentences():
    link = M.format("Ay. Su", "http://x. Y")
    assert split_sentences("Bir gitti. İki geldi! " + link + " kaldı. Üç kaldı? evet") == ["Bir gitti.", "İki geldi! " + link + " kaldı.", "Üç kaldı? evet"]
    # günü. holds back its dot and takes the D along, so Dr. ends a sentence; oldu. ends none
    assert split_sentences("Geldi 12. Ocak günü. Dr. Ali vardı. Tamam oldu. Son") == ["Geldi 12. Ocak günü. Dr.", "Ali vardı.", "Tamam oldu. Son"]
    assert split_sentences("A. B. Cde.") == ["A. B.", "Cde."]
    assert split_sentences(None) == split_sentences(" ") == []


def test_sentences_as_columns(spark):
    """Texts without mentions never go through Python, and are split alike."""
    rng = random.Random(6)
    bits = ["Ab", "cd", "Ö", "çok", "uzunca", "12", ".", "! ", "? ", " ", ". ", "\n", "\u00a0", M.format("e", "u"), "A."]
    texts = [None, "", " ", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("s", sentences("t"))
    assert {r.k: r.s for r in df.collect()} == {k: split_sentences(t) for k, t in enumerate(texts)}


def test_sentences_lose_nothing():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["Ab", "cd", ".", "! ", " ", "7", "Ö", M.format("e", "u"), ". "]) for _ in range(30))
        assert "".join("".join(split_sentences(text)).split()) == "".join(text.split())


PAGE = """<html><title>T - Vikipedi</title><div id="mw-content-text"><p>Bir <a href="/wiki/X">X</a> <b>iki</b>[12] <a>yok</a> <i><a href="/y">deep</a></i></p><p> </p><p>Son<p>Ek</div>
<table class="infobox vcard"><tr><th>Ad</th><td>Ada<br>L. <div><a href="/l">London</a></div><ul><li>bir</li><li>iki</li></ul></td></tr><tr><th>Baş</th></tr><tr><td>ek <a href="http://z/q">q</a></td></tr><tr><th>Ad</th><td>2[3]</td></tr></table></html>"""


def test_html():
    # space is squeezed before marks go, so one is left on either side of a mark
    assert paragraphs(PAGE, "https://tr.example.org") == [f"Bir {M.format('X', 'https://tr.example.org/wiki/X')} iki  deep", "Son", "Ek"]
    box = infobox(PAGE, "https://tr.example.org")
    assert box == [("Ad", f"Ada L. {M.format('London', 'https://tr.example.org/l')} bir iki"), ("Baş", f"ek {M.format('q', 'http://z/q')}"), ("Ad (2)", "2")]
    assert infobox(None, "") == paragraphs(None, "") == []


def test_mentions_and_frequencies(spark):
    s = spark.createDataFrame([("p", "T", "T#1", f"x {M.format(' A ', 'http://u')} y {M.format('B', 'http://u')}"), ("p", "T", "T#2", M.format("A", "http://u")), ("q", "U", "U#1", "___E:A U:(http://v)___ " + M.format("", "w"))], "page_id string, title string, sent_id string, sentence string")
    found = frequency.mentions(s, legacy=True)
    assert rows(found, "sent_id", "entity", "url") == [("T#1", "A", "http://u"), ("T#1", "B", "http://u"), ("T#2", "A", "http://u"), ("U#1", "A", "http://v")]
    assert frequency.mentions(s, keep_parens=True).first().url.startswith("(")
    occ = {(r.entity, r.url): (r.n_occurrences, r.sources) for r in frequency.occurrence_frequency(found.where("page_id = 'p'")).collect()}
    assert occ["A", "http://u"] == (2, "T#1: x y") and occ["B", "http://u"][0] == 1
    u = frequency.url_rollup(found).first()
    assert (u.entities, u.n_sentences, u.sources) == ("A | B", 2, "T#1: x A y B | T#2: A")
    assert rows(frequency.page_frequency(found), "entity", "n_pages", "titles", "page_ids") == [("A", 2, "T | U", "p | q")]
    assert frequency.page_frequency(found, "entity", "url").count() == 0
    assert rows(frequency.search_entity(found, " b"), "entity") == [("B",)]
    assert rows(frequency.top_entities(found, 1), "entity") == [("A",)]
    assert frequency.run_summary(found).first().asDict() == {"n_entities": 2, "n_pairs": 3, "n_pages": 2}


def subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_indel_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcç ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert common_length(a, b) == subsequence(a, b)
    assert ratio("", "") == 100 and ratio("a", "") == 0


def greedy(names, threshold):
    norm = {n: " ".join(n.strip().lower().split()) for n in names}
    alike = lambda a, b: 200 * subsequence(norm[a], norm[b]) >= threshold * (len(norm[a]) + len(norm[b]))
    done, out, place = set(), {}, {}
    for seed in sorted(names):
        if seed in done:
            continue
        members = [seed] + [x for x in sorted(names) if x != seed and alike(seed, x)]
        head = max(members, key=len)
        out[head] = (seed, set(members))
        place.setdefault(head, len(place))
        done |= set(members)
    return out


@pytest.mark.parametrize("threshold", [85, 75, 60, 50, 20])
def test_fuzzy_clusters(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    names = {"".join(c for c in b if rng.random() > 0.1) + rng.choice(["", "a", " "]) for b in base for _ in range(4)} | {"Ab", "aB", "ab "}
    names = {n for n in names if n.strip()}
    df = spark.createDataFrame([(n,) for n in names], "entity string")
    pairs = fuzzy.similar_entities(df, threshold)
    norm = lambda n: " ".join(n.strip().lower().split())
    want = {(a, b) for a, b in combinations(sorted(names), 2) if 200 * subsequence(norm(a), norm(b)) >= threshold * (len(norm(a)) + len(norm(b)))}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    found = {}
    for r in fuzzy.clusters(df, spark.createDataFrame(sorted(want), "a string, b string")).collect():
        found.setdefault(r.head, (r.seed, set()))[1].add(r.entity)
    assert found == greedy(names, threshold)


def test_fuzzy_pairs_of_very_short_names(spark):
    df = spark.createDataFrame([("ab",), ("acb",), ("a",), ("b",), ("",)], "entity string")
    assert rows(fuzzy.similar_entities(df, 60), "a", "b", "score") == [("a", "ab", 200 / 3), ("ab", "acb", 80.0), ("ab", "b", 200 / 3)]
    assert fuzzy.similar_entities(df, 100).count() == 0
    for bad in (0, 101, 84.5):
        with pytest.raises(ValueError, match="threshold"):
            fuzzy.similar_entities(df, bad)


def test_relation_conflicts(spark):
    t = spark.createDataFrame([("Barça", None, "r1", "X", None, None, "f", 0), ("Barca", None, "r2", "X", None, None, "g", 1), ("X", None, "r3", "Barça", None, None, "g", 2), ("Q", None, "r", "X", None, None, "g", 3)], TRIPLE)
    e = quality.entities(t)
    got = rows(fuzzy.relation_conflicts(t, fuzzy.clusters(e, spark.createDataFrame([("Barca", "Barça")], "a string, b string"))), "cluster_head", "target", "n_relations", "relations")
    assert got == [("Barca", "X", 3, "r1 (f); r2 (g); r3 (g)")]


def test_bfs(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "f"), ("f", "g"), ("c", "d"), ("d", None)], "src string, dst string")
    root = spark.createDataFrame([("a",)], "url string")
    assert dict(rows(graph.bfs_depths(links, root, 2), "url", "depth")) == {"a": 0, "b": 1, "f": 1, "c": 2, "g": 2}
    assert dict(rows(graph.bfs_depths(links, root, 9, failed=spark.createDataFrame([("f",)], "url string")), "url", "depth")) == {"a": 0, "b": 1, "f": 1, "c": 2, "d": 3}
    assert graph.same_site(links, "b").count() == 1


def test_claims(spark, tmp_path):
    doc = {"Q1": {"label_tr": "Bir", "claims": {"P1": [{"mainsnak": {"datavalue": {"value": {"entity-type": "item", "id": "Q2"}}}}] * 2, "P2": [{"mainsnak": {"datavalue": {"value": "lit"}}}, {"mainsnak": {}}, {"mainsnak": {"datavalue": {"value": {"time": "x"}}}}, {"mainsnak": {"datavalue": {"value": 5}}}]}}, "Q2": {"claims": {}}}
    claims = graph.parse_claims(spark.createDataFrame([(1, json.dumps(doc))], "seq long, json string"))
    edges, nodes = graph.claim_edges(claims), graph.graph_nodes(claims)
    assert rows(edges, "src", "dst", "property") == [("Q1", "P2:lit", "P2"), ("Q1", "Q2", "P1"), ("Q1", "Q2", "P1")]
    assert rows(nodes, "id", "label") == [("P2:lit", "lit"), ("Q1", "Bir"), ("Q2", "Q2")]
    assert graph.graph_counts(nodes, edges).first().asDict() == {"n_nodes": 3, "n_edges": 3}
    assert graph.induced_subgraph(nodes, edges, 2)[1].count() == 2
    sinks.write_gexf(nodes.orderBy("id"), edges, str(tmp_path / "g.gexf"))
    assert (tmp_path / "g.gexf").read_text().count("<edge ") == 3


def test_ranks_and_batches(spark):
    ids = spark.range(123).select(F.concat(F.lit("Q"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id")).repartition(7)
    assert [r.id for r in with_rank(ids, "id").orderBy("rank").collect()] == [f"Q{k:04d}" for k in range(123)]
    assert sorted(len(r.ids) for r in graph.batches(ids, "id", 50).collect()) == [23, 50, 50]


def test_wikidata(spark):
    b = '{"results":{"bindings":[{"targetLabel":{"value":"X"}},{"sourceLabel":{"value":"S"},"propLabel":{"value":"p"}}]}}'
    got = wikidata.parse_bindings(spark.createDataFrame([(b,), ("bad",)], "json string"), entity="Q5")
    assert rows(got, "head", "relation", "tail") == [("Q5", "Bilinmeyen İlişki", "X"), ("S", "p", "Bilinmeyen Varlık")]
    assert len(rows(wikidata.related_ids(spark.createDataFrame([("Q1", "p", "http://www.wikidata.org/entity/Q2"), ("Q1", "p", "lit")], "subject string, p string, target string"), "Q1"), "id")) == 2


def test_extraction(spark):
    df = spark.createDataFrame([(1, "bir |  | iki")], "id long, text string")
    asked = extraction.ask(extraction.parts(df).withColumn("prompt", extraction.prompt(F.col("text"), "s", [{"baş": "x"}] * 5, F.lit(2))), lambda ps: ['```json\n[{"baş":"h","ilişki":"r","uç":"t"}]\n```' if "iki" in p else "?" for p in ps])
    assert asked.first().prompt.count('"baş"') == 3 and "Tam 2 " in asked.first().prompt
    t = extraction.parse_answers(asked, text="text")
    assert rows(t, "id", "head", "relation", "tail", "tail_type", "text") == [(1, "h", "r", "t", None, "iki")]
    assert extraction.clean_output(t).first().tail_type == ""


def test_sources_and_sinks(spark, tmp_path, triples):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "bir.json").write_text('[{"baş":"a","ilişki":"r","uç":"b"},{"baş":"c","ilişki":"r","uç":"d","metin":"m"}]', encoding="utf-8")
    (tmp_path / "t" / "kötü.json").write_text("{", encoding="utf-8")
    got = readers.read_triples(spark, str(tmp_path / "t"))
    assert rows(got, "source", "head", "text", "seq") == [("bir", "a", None, 0), ("bir", "c", "m", 1)]
    assert rows(readers.bad_files(spark, str(tmp_path / "t")), "source") == [("kötü",)]
    two = readers.read_triple_files(spark, [str(tmp_path / "t" / n) for n in ("yok.json", "bir.json", "kötü.json")])
    assert two.count() == 2 and readers.read_triple_files(spark, [str(tmp_path / "no.json")]).count() == 0
    for name, body in (("x", "E,U\nA,1\n\"B\nC\",2\n,3\n"), ("y", "E\nA\n"), ("z", "K\n1\n")):
        (tmp_path / f"{name}.csv").write_bytes(b"\xef\xbb\xbf" + body.encode())
    paths = [str(tmp_path / f"{n}.csv") for n in "xyz"]
    assert rows(readers.read_entity_sets(spark, paths), "source", "item") == [("x", "A"), ("x", "B\nC"), ("y", "A")]
    with pytest.raises(ValueError, match="two files"):
        readers.read_entity_sets(spark, paths[1:])
    (tmp_path / "ids.txt").write_text(" Q1 \nx\nQ2\n")
    assert rows(readers.read_q_ids(spark, str(tmp_path / "ids.txt")), "id") == [("Q1",), ("Q2",)]
    (tmp_path / "Wiki_a.json").write_text(json.dumps({"Title": "T", "Card": {"k": "v", "e": ""}, "Main": [{"id": "T#1", "sentence": "s"}]}))
    assert rows(readers.page_sentences(readers.read_pages(spark, str(tmp_path / "Wiki_*.json"))), "page_id", "sent_id", "sentence") == [("Wiki_a", "T#1", "s"), ("Wiki_a", "TCard#1", "v")]
    merged = merge.joined(merge.merge_relations_and_types(triples), "relation", "head_type", "tail_type").orderBy("first_seen").drop("first_seen")
    sinks.write_json_list(merged, str(tmp_path / "relations_and_types_merged.json"))
    sinks.write_statistics(merge.merge_statistics(triples), str(tmp_path / "statistics.json"))
    assert json.loads((tmp_path / "statistics.json").read_text())["merge_statistics"]["total_original_records"] == 6
    back = readers.read_merged(spark, str(tmp_path))
    assert set(back) == {"relations_and_types_merged", "statistics"} and back["relations_and_types_merged"].count() == 2
    sinks.write_csv_file(merged, str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_bytes().startswith(b"\xef\xbb\xbfhead,")
    assert sinks.write_clean(triples, str(tmp_path / "r.json")).endswith("r_clean.json")
    assert len(json.loads((tmp_path / "r_clean.json").read_text())) == 6
    sinks.write_ids(spark.createDataFrame([("Q2",), ("Q1",), ("Q2",)], "id string"), str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out")), "value") == [("Q1",), ("Q2",)]
    assert readers.fetch_pages(spark.createDataFrame([("u",)], "url string"), lambda u: None).first().html is None


def test_crawl(spark):
    page = lambda title, *to: f'<title>{title}</title><div id="mw-content-text"><p>Bir ilk tümce. {"".join(f"<a href={t!r}>n{t}</a> " for t in to)}</p><p>Bitti burada.</p></div><table class="vcard"><tr><th>k</th><td>v</td></tr></table>'
    pages = spark.createDataFrame([("https://w.org/a", page("A", "/b", "https://other.org/x")), ("https://w.org/b", page("B", "/c", "/a")), ("https://w.org/c", None), ("https://w.org/d", page("D", "/a"))], "url string, html string")
    got = crawl.crawl(pages, "https://w.org/a", 5, "https://w.org")
    assert dict(rows(got.depths, "url", "depth")) == {"https://w.org/a": 0, "https://w.org/b": 1, "https://w.org/c": 2}
    assert {r.url for r in got.mentions.where("title = 'A'").collect()} == {"https://w.org/b", "https://other.org/x"}
    assert rows(got.sentences.where("title = 'B'"), "sent_id")[-1] == ("BCard#1",) and got.sentences.where("title = 'D'").count() == 0
    assert rows(got.sentences.where("title = 'B'"), "sentence")[0] == ("Bir ilk tümce. <PossibleEntity>n/c</PossibleEntity> <URL>:(https://w.org/c)</URL> <PossibleEntity>n/a</PossibleEntity> <URL>:(https://w.org/a)</URL>",)


def test_fetch_and_examples(spark, tmp_path):
    b = spark.createDataFrame([(0, ["Q1", "Q2"]), (1, ["Q2"]), (2, ["Q9"])], "batch long, ids array<string>")
    got = wikidata.fetch_entities(b, lambda ids: None if "Q9" in ids else {i: f"{i}/{len(ids)}" for i in ids})
    assert rows(got, "id", "json") == [("Q1", "Q1/2"), ("Q2", "Q2/1")]
    (tmp_path / "e.json").write_text('{"system": "s", "examples": [{"baş": "x"}]}')
    assert extraction.load_examples(str(tmp_path / "e.json")) == ("s", [{"baş": "x"}])
    assert extraction.load_examples(str(tmp_path / "no.json")) == ("", [])


def test_first_entities(spark):
    found = spark.createDataFrame([(c,) for c in "cab"], "entity string")
    assert quality.first_entities(found, 2).first().asDict() == {"n": 3, "entities": ["a", "b"]}


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([("r", "2024-01-01 10:00:00"), ("r", "2024-01-01 11:00:00"), ("s", "2024-01-03 00:00:00")], "relation string, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    counts = stream.relation_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t")
    q = counts.writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w"), "relation", "n") == [("r", 2), ("s", 1)]


def test_shared_folder(spark, tmp_path, monkeypatch):
    class Conf:
        value = str(tmp_path / "given")

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.value

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    class Cluster(Session):
        class sparkContext:
            master = "spark://host:7077"

    assert lineage.shared_dir(Session()) == str(tmp_path / "given")
    Conf.value = None
    assert lineage.shared_dir(Session()) == lineage.shared_dir(Session()) != str(tmp_path / "given")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        lineage.shared_dir(Cluster())
    kept, path = lineage.keep(spark.range(3), "t")
    assert path.startswith(lineage.shared_dir(spark)) and kept.count() == 3
    lineage.drop(spark, path)
    with pytest.raises(Exception, match=r"(?i)not.?exist|not found"):
        spark.read.parquet(path).count()


def test_merge_run(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"baş":"x","baş_tipi":"T","ilişki":"r","uç":"y"},{"baş":"y","ilişki":"q","uç":"x"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"baş":"x","baş_tipi":"S","ilişki":"p, o","uç":"y","uç_tipi":"U"}]', encoding="utf-8")
    (tmp_path / "c.json").write_text("no", encoding="utf-8")
    done = runs.merge_folder(spark, str(tmp_path))
    assert done.bad == ["c"] and done.statistics.total_original_records == 3 and [r.relation for r in done.preview["relations_merged"]] == ["p, o, r", "q"]
    read = lambda name: json.loads((tmp_path / "merged" / f"{name}.json").read_text())
    assert read("entity_types_merged") == [{"entity": "x", "entity_type": "S, T"}, {"entity": "y", "entity_type": "U"}]
    assert read("relations_merged") == [{"baş": "x", "uç": "y", "ilişki": "p, o, r"}, {"baş": "y", "uç": "x", "ilişki": "q"}]
    assert read("relations_and_types_merged")[0] == {"baş": "x", "baş_tipi": "S, T", "ilişki": "p, o, r", "uç": "y", "uç_tipi": "U"}
    assert read("statistics")["merge_efficiency"]["relations_reduction"] == "3 -> 2"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.json").write_text("{", encoding="utf-8")
    assert runs.merge_folder(spark, str(tmp_path / "none")) is None


def test_extract_run(spark, tmp_path):
    for name in ("bir", "iki"):
        (tmp_path / f"{name}.csv").write_bytes(b"\xef\xbb\xbf" + f'E,U,Frekans,Kaynak_IDler\n{name},u,2,"T#1: ilk |  | T#2: son"\nyok,u,1,\n'.encode())
    model = lambda prompts: [None if "son" in p else '[{"baş":"h","ilişki":"' + p.split("Tam ")[1][0] + '","uç":"t"}]' for p in prompts]
    got = runs.extract_csv(spark, str(tmp_path), model, "s", [])
    assert rows(got, "source", "head", "relation", "tail", "text") == [("bir", "h", "2", "t", "T#1: ilk"), ("iki", "h", "2", "t", "T#1: ilk")]
    assert json.loads((tmp_path / "iki_clean.json").read_text()) == [{"baş": "h", "baş_tipi": "", "ilişki": "2", "uç": "t", "uç_tipi": "", "metin": "T#1: ilk"}]
    assert runs.extract_csv(spark, str(tmp_path / "bir.csv"), model, "s", []).count() == 1


def test_crawl_report(spark, tmp_path):
    page = lambda title, *to: f'<title>{title}</title><div id="mw-content-text"><p>{" ".join(f"Bkz <a href={t!r}>n{t}</a> burada." for t in to)}</p></div>'
    pages = spark.createDataFrame([("https://w.org/a", page("A", "/b", "/c")), ("https://w.org/b", page("B", "/c", "/a")), ("https://w.org/c", page("C", "/b"))], "url string, html string")
    r = runs.crawl_report(pages, "https://w.org/a", 2, "https://w.org", str(tmp_path / "out"))
    assert (r.n_pages, r.n_entities, r.n_pairs, r.n_repeated) == (3, 3, 3, 2) and [t.n_pages for t in r.top] == [2, 2, 1]
    assert rows(readers.read_csv(spark, str(tmp_path / "out" / "entities")), "entity", "n_pages", "titles") == [("n/b", "2", "A | C"), ("n/c", "2", "A | B")]
    assert readers.read_csv(spark, str(tmp_path / "out" / "urls")).count() == 3 and readers.read_csv(spark, str(tmp_path / "out" / "occurrences")).count() == 5
    assert readers.read_csv(spark, str(tmp_path / "out" / "pairs")).count() == 2


def test_single_files_without_the_driver(spark, tmp_path, monkeypatch):
    """Rows of a single file don't come to the driver, and keep their order over many pieces of a MB."""

    def rows_to_driver(self, *_):
        raise AssertionError("rows come to the driver")

    long = spark.range(0, 40_000, 1, 5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.repeat(F.lit("ş,\n"), 30).alias("label"), "id").toDF("id", "label", "k").orderBy(F.desc("k"))
    edges = long.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("label").alias("property"))
    with monkeypatch.context() as m:
        m.setattr(type(long), "toLocalIterator", rows_to_driver)
        sinks.write_json_list(long.drop("k"), str(tmp_path / "l.json"))
        sinks.write_json_list(long.where("k < 0"), str(tmp_path / "e.json"))
        for _ in range(2):
            sinks.write_csv_file(long.select("id", "label"), str(tmp_path / "l.csv"))
        sinks.write_gexf(long, edges, str(tmp_path / "g.gexf"))
    want = [(f"n{k}", "ş,\n" * 30) for k in reversed(range(40_000))]
    assert [tuple(r.values()) for r in json.loads((tmp_path / "l.json").read_text())] == want
    assert (tmp_path / "l.json").read_text().startswith('[\n{\n    "id": "n39999",') and (tmp_path / "e.json").read_text() == "[\n]\n"
    with (tmp_path / "l.csv").open(encoding="utf-8-sig", newline="") as f:
        assert [tuple(r) for r in csv.reader(f)] == [("id", "label"), *want]
    ids = [re.findall(rf'^<{tag}="([^"]*)"', (tmp_path / "g.gexf").read_text(), re.M) for tag in ("node id", "edge id")]
    assert ids == [[n for n, _ in want], [str(k) for k in range(40_000)]]
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]

"""Every core query that SQL can express against DuckDB, on the smallest tables."""

import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import pytest

from knotwork import queries
from knotwork.functions.html import paragraphs
from knotwork.functions.similarity import ratio
from knotwork.plans import lineage, views
from knotwork.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def value(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    there = [c[0] for c in cursor.description]
    assert sorted(there) == columns
    want = Counter(tuple(value(r[there.index(c)]) for c in columns) for r in cursor.fetchall())
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_the_others_are_held_against_plain_versions():
    assert set(QUERIES) - set(ORACLES) == {"html_paragraphs", "similar_entities", "entity_clusters", "relation_conflicts"}


@pytest.fixture(scope="module")
def links(con):
    """(head, relation, tail, source) of the triples between neighbouring anchors of pages."""
    out = []
    for page, html in con.execute("SELECT page_id, html FROM pages").fetchall():
        names = re.findall(r'<a href="[^"]*">([^<]*)</a>', html)
        out += [(a, f"r{page % 5}", b, f"s{page % 3}") for a, b in zip(names, names[1:], strict=False)]
    return out


@pytest.fixture(scope="module")
def alike(links):
    """{(a, b): score} over all pairs of names."""
    names = sorted({x for a, _, b, _ in links for x in (a, b)})
    norm = {n: " ".join(n.strip().lower().split()) for n in names}
    return {(a, b): s for a, b in combinations(names, 2) if (s := ratio(norm[a], norm[b])) >= 85}


def test_similar_entities(spark, alike):
    assert {(r.a, r.b): r.score for r in QUERIES["similar_entities"](spark, SF).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in alike.items()} != {}


def clusters(links, alike):
    """{head: (seed, members)}, greedily by name; a later cluster with the same head takes the earlier one's place."""
    names = sorted({x for a, _, b, _ in links for x in (a, b)})
    near = {n: {b if a == n else a for a, b in alike if n in (a, b)} for n in names}
    done, out = set(), {}
    for seed in names:
        if seed not in done:
            members = [seed, *sorted(near[seed])]
            out[max(members, key=len)] = (seed, set(members))
            done |= set(members)
    return out


def test_entity_clusters(spark, links, alike):
    found = {}
    for r in QUERIES["entity_clusters"](spark, SF).collect():
        found.setdefault(r.head, (r.seed, set()))[1].add(r.entity)
    assert found == clusters(links, alike)


def test_relation_conflicts(spark, links, alike):
    of, size = {}, {}
    for head, (_, members) in clusters(links, alike).items():
        size[head] = len(members)
        of |= dict.fromkeys(members, head)
    said = {}
    for a, r, b, source in links:
        x, y = sorted((a, b))
        cx, cy = of.get(x), of.get(y)  # none for those of a cluster whose head a later one has, too
        if size.get(cx, 0) > 1:
            said.setdefault((cx, y), {}).setdefault(r, set()).add(source)
        if size.get(cy, 0) > 1 and cx != cy:
            said.setdefault((cy, x), {}).setdefault(r, set()).add(source)
    want = {(*k, len(v), "; ".join(sorted(f"{r} ({', '.join(sorted(s))})" for r, s in v.items()))) for k, v in said.items() if len(v) > 1}
    assert {tuple(r[c] for c in ("cluster_head", "target", "n_relations", "relations")) for r in QUERIES["relation_conflicts"](spark, SF).collect()} == want != set()


def test_html_paragraphs(spark, con):
    want = {(page, k, p) for page, html in con.execute("SELECT page_id, html FROM pages").fetchall() for k, p in enumerate(paragraphs(html, "https://tr.example.org/", "article p"))}
    assert {tuple(r) for r in QUERIES["html_paragraphs"](spark, SF).select("page_id", "k", "paragraph").collect()} == want != set()


@pytest.mark.parametrize("name", ["coverage", "merge_statistics"])
def test_one_pass(spark, name):
    """These plans read and join each table once."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 if name == "coverage" else plan.count("lineitem.parquet") <= 2


@pytest.mark.parametrize("name", ["triple_files", "triple_file_list", "bad_files", "merge_run", "merge_run_statistics", "claims_file"])
def test_files_without_the_driver(spark, monkeypatch, name):
    """What is written as single files doesn't go through the driver row by row."""

    def rows_to_driver(self, *_):
        raise AssertionError("rows come to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", rows_to_driver)
    assert QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("name", ["coverage", "lost_entities", "new_entities"])
def test_stars_are_kept_narrow(spark, monkeypatch, name):
    """Types and places, which these don't compare, go through no join of the star and into no kept table."""
    kept = []
    monkeypatch.setattr(queries, "keep", lambda df, name: kept.append(df) or lineage.keep(df, name))
    QUERIES[name](spark, SF)
    (star,) = kept
    assert set(star.columns) <= {"head", "relation", "tail", "source"}
    plan = [line for line in star._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" not in line]
    assert len(plan) > 10 and not re.search("p_type#|c_mktsegment#|l_linenumber#", "".join(plan))


def test_orders_join_the_star_by_keys(spark):
    """Below the join with orders there is no text of a part."""
    plan = views.triples_star(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: re.search(r"[A-Z]", line).start()
    at = next(k for k, line in enumerate(plan) if re.search(r"Join Inner.*l_orderkey#\d+L = o_orderkey", line))
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert any("o_orderkey" in line for line in below) and not any("p_name" in line for line in below if "Relation [" not in line)

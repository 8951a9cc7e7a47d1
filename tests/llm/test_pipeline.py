"""The queries of the subpackage against SQL, and the pipeline's stages against what they promise."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from knotwork.llm import decontamination, licenses, linededup, neardup, quality, queries, sentencepiece_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    there = [c[0] for c in cursor.description]
    assert Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(str(r[there.index(c)]) for c in columns) for r in cursor.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        seen.append(out.count())
        if k < 4:
            assert out.dtypes == docs.dtypes
            assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] > 0.5 * seen[0]
    assert docs.where("not round_trip").count() == 0
    again = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.ids for r in again.collect()} == {r.doc_id: r.ids for r in docs.collect()}


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).count() == 0


def test_stages_take_odd_rows(spark):
    prose = " ".join(f"Bu {k} ayrı tümce burada sözlerle durur." for k in range(12))
    rows = [(1, None, "en", None, None, False, 5), (2, "", None, "s", 0, True, 5), (3, prose, "tr", "s", 7, False, 5), (3, prose, "tr", "s", 7, False, 5), (None, prose.replace("ayrı", "başka"), None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep boolean, n_removed long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert {3} <= {r.doc_id for r in out.collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()} == {3, None}
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == ["1", "2", "3", "None"]
    assert corpus_pipeline.tokenise(spark, docs, SF).where("round_trip").count() == 4


def test_benchmark_words_are_cut(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    own = " ".join(f"w{k}é" for k in range(4000))
    rows = [(1, f"{own}. {item} {own}", 1), (2, f"Ab {item}", 2), (3, own, 3), (4, None, 4)]
    out = {r.doc_id: r for r in corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), SF).collect()}
    assert set(out) == {1, 3, 4} and out[3].text == own and out[4].text is None
    assert out[1].text.startswith(f"{own}. ") and out[1].text.endswith(f" {own}") and len(out[1].text) < 2 * len(own) + 8 and out[1].n_chars == len(out[1].text)


def test_very_long_texts(spark):
    long = " ".join(f"söz{k % 9973} var{k % 7919}." for k in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long + " ek"), (3, "Kısa bir metin. MIT License"), (4, long[:200_000].replace(" ", ""))], "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    gone = {r.doc_id: (r.n_removed, len(r.text)) for r in linededup.dedup(docs).collect()}
    assert gone[1] == (0, len(long)) and gone[2][1] < 100 and gone[3] == (0, 27)
    item = spark.createDataFrame([(9, " ".join(long.split()[200_000:200_030]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontamination.digest(decontamination.contamination(docs, item)).collect()}
    assert hits[1] == hits[2] >= 30 and hits[3] == hits[4] == 0
    assert {r.doc_id for r in quality.classify(docs).collect()} == {1, 2, 3, 4}
    assert [len(r.sentences) for r in licenses.scan(docs, "text", F.col("doc_id")).orderBy("doc_id").collect()] == [0, 0, 1, 0]
    tokens = sentencepiece_scan.encode(docs.where("doc_id in (3, 4)"), "text", F.col("doc_id")).collect()
    assert all(r.round_trip for r in tokens)
    model = sentencepiece_scan.load(sentencepiece_scan.MODEL)
    assert {r.doc_id: r.ids for r in tokens}[4] == model.sp.encode(long[:200_000].replace(" ", ""))

"""The registered queries without SQL, over whole small tables, against plain versions."""

import zlib

import numpy as np
import pandas as pd
import pytest
from test_text_operators import without_repeats

from knotwork.llm import licenses, queries, sentencepiece_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def run(spark, name, key):
    return queries.queries()[name](spark, SF).toPandas().sort_values(key).reset_index(drop=True)


def test_license_query(spark, docs):
    got = run(spark, "op1_license_scan", "doc_id")
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary"}
    want = [",".join(sorted({lines[x] for x in t.split("\n") if x in lines})) for t in docs.text]
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got.licences.tolist() == want
    assert all(set(s.split(",")) <= {*licenses.SENTENCES, ""} for s in got.sentences)


def test_quality_query(spark, docs):
    got = run(spark, "op3_quality", "doc_id").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert len(run(spark, "op3_quality", "doc_id")) == len(docs)
    assert ((got.quality == 1) == got.keep).mean() > 0.95 and got[got.quality == 1].keep.mean() > 0.98


def test_sharding_query(spark, docs):
    got = run(spark, "op5_sharding", "doc_id")
    assert got["size"].tolist() == [len(t.encode()) + 8 for t in docs.text] and got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in docs.text]
    counts = got.shard.value_counts().reindex(range(24), fill_value=0)
    assert counts.max() - counts.min() <= 1 and (got.law == "rows").all() and got.grown_shard.isna().all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = docs.merge(got, on="doc_id").groupby("text").agg(n=("shard", "size"), places=("shard", "nunique"))
    small = groups[(groups.n > 1) & (groups.n <= len(docs) // 48)]
    assert (small.places == 1).mean() > 0.9


def test_sentencepiece_query(spark, docs):
    got = run(spark, "op6_sentencepiece", "doc_id")
    assert got.round_trip.all()
    assert [list(i) for i in got.ids] == sentencepiece_scan.load(sentencepiece_scan.MODEL).sp.encode(docs.text.tolist())


def test_line_dedup_query(spark, docs):
    got = run(spark, "op7_line_dedup", "doc_id")
    want = without_repeats(docs.text.tolist(), 50)
    assert list(zip(got.text, got.n_removed, strict=True)) == want


def test_language_query(spark, docs):
    got = run(spark, "op9_language_id", "doc_id").merge(docs, on="doc_id")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_neighbour_query(spark):
    got = run(spark, "op10_permutation_index", ["query_id", "rank"])
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    v, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    hit = 0
    for q, g in got.groupby("query_id"):
        gap = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, gap)) if ids[i] != q][:10]
        hit += len(set(g.vec_id) & set(ids[order]))
        assert g.score.tolist() == pytest.approx([gap[ids == i][0] for i in g.vec_id])
    assert sorted(got.query_id.unique()) == sorted(i for i in ids if i % 100 == 0) and hit >= 0.9 * len(got)

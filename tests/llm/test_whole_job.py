"""What operators once did for a part of the rows, runs or spellings only."""

import textwrap

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knotwork.llm import langid, licenses, linededup, quality, sampling


def test_line_dedup_takes_a_run_to_its_end(spark):
    passage = "".join(" ".join(f"{lead}{k}" for k in range(n)) + "\n" for lead, n in (("a", 45), ("b", 10), ("c", 10)))
    df = spark.createDataFrame([(0, passage), (1, "Own line\n" + passage + "another\n")], "doc_id long, text string")
    assert [r.text for r in linededup.dedup(df).orderBy("doc_id").collect()] == [passage, "Own line\nanother\n"]


@pytest.mark.parametrize("rows", [10, 10**6, 10**11, 10**15])
def test_samples_of_any_table(rows):
    """The share of hashes that are taken follows the table's size down to any share."""
    share = (sampling.bound(6000, rows) + 2**63) / 2**64
    assert share == pytest.approx(min(1.0, 6000 / rows), rel=1e-3) and share > 0


def test_samples_of_repeated_rows(spark):
    """Null or equal ids, and a text in half of all rows, neither swell nor empty the sample."""
    prose = "Ein Satz {0} mit Worten und mehr. Noch ein Satz {0} steht hier. Dann folgt {0} das Ende davon."
    rows = [(None, prose.format("x"))] * 300 + [(None, prose.format(f"w{k}")) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    taken = sampling.chosen(df, sampling.bound(60, 600), 120, "text").collect()
    assert 10 <= len(taken) <= 60 and len({r.text for r in taken}) == len(taken)
    assert quality.classify(df, sample=60).where("keep").count() == 600
    assert quality.classify(df, sample=0).where("keep").count() == 600  # no scorer: the label model decides
    spoken = df.withColumn("lang", F.when(F.col("text").contains("w1"), "rare").otherwise("de"))
    assert langid.train(spoken, sample=5, least=20).languages == ["de", "rare"]


PROSE = " ".join(f"Bu {k} ayrı tümce burada sözlerle durur." for k in range(12))
OTHER = " ".join(f"Une autre phrase {k * 7} se trouve ici encore." for k in range(12))


def test_near_dedup_keeps_one_row_of_each_text(spark):
    rows = [(1, PROSE), (5, PROSE), (5, OTHER), (7, None), (7, ""), (None, PROSE), (None, OTHER + " fin"), (1, PROSE)]
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(order, "doc_id long, text string").repartition(3), "").collect()
        assert sorted(map(tuple, out), key=str) == sorted([(1, PROSE), (5, OTHER), (7, None), (7, "")], key=str)


def test_stages_on_repeated_ids_and_clashing_columns(spark):
    rows = [(3, PROSE, 9, 1, 0.5, 2), (3, OTHER, 9, 1, 0.5, 2), (None, PROSE, 9, 1, 0.5, 2), (None, OTHER, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, component_id long, score double, marks int")
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.quality_classifier(spark, df, sf).count() == 4
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, sf).collect()) == sorted([(3, PROSE), (3, OTHER)])
    assert corpus_pipeline.decontaminate(spark, df, sf).count() == 4
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, df, sf).collect()} == {None}  # null ids come first, so the others are the repeats
    assert all(stage(spark, df, sf).columns == df.columns for _, stage in corpus_pipeline.STAGES[:4])


def test_remains_of_copies_go(spark):
    words = [f"söz{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"yeni{k}" for k in range(49)])), (3, " ".join(words[:60] + [f"öz{k}" for k in range(60)])), (5, " ".join(words[:61] + [f"son{k}" for k in range(60)])), (4, "kısa")]
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert out == {1: rows[0][1], 3: " ".join(f"öz{k}" for k in range(60)), 4: "kısa"}


def test_last_stage_takes_odd_tables(spark):
    giant = "söz ve ışık " * 9000
    df = spark.createDataFrame([(1, giant), (1, giant), (None, None), (2, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = corpus_pipeline.tokenise(spark, df, "").collect()
    assert len(got) == 4 and sum(r.round_trip is True for r in got) == 3
    assert corpus_pipeline.tokenise(spark, df.limit(0), "").count() == 0


@pytest.mark.parametrize("text", ["All rights\nreserved.", "All rights  reserved.", "// All rights\n// reserved.", "This work is dedicated to the public\ndomain."])
def test_licenses_in_wrapped_or_spaced_words(text):
    assert len(licenses.sentences(f"Before.\n{text}\nAfter")) == 1


@pytest.mark.parametrize("lead", ["", "# "])
def test_licenses_over_many_lines(lead):
    known = {n: f for n in ("mit-grant", "mit-notice", "asis") for f in licenses.SENTENCES[n]}
    text = "\n".join(lead + word for form in known.values() for word in form.split())
    found = licenses.sentences(text + "\n#\n" + lead + "more")
    assert [f[0] for f in found] == list(known)
    assert [(n, text[a:b]) for n, a, b in licenses.licences(found, text)] == [("MIT", text)]


def test_benchmark_goes_whatever_the_id(spark):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    own = " ".join(f"w{k}" for k in range(8000))
    rows = [(None, item), (1, item), (1, own), (None, f"{own} {item}"), (None, own), (2, None)]
    out = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(((r.doc_id, r.text and r.text.strip(" .")) for r in out), key=str) == sorted([(1, own), (None, own), (None, own), (2, None)], key=str)


def named(text):
    return [n for n, *_ in licenses.licences(licenses.sentences(text), text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("// SPDX-License-Identifier: mit OR apache-2.0", ["Apache-2.0", "MIT"]),
        ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND BSD-3-Clause */", ["BSD-3-Clause", "GPL-2.0-or-later"]),
        ("# SPDX-License-Identifier: GPL-3.0", ["GPL-3.0-only"]),
        ("SPDX-License-Identifier: LicenseRef-Own", ["LicenseRef-Own"]),
        ("SPDX-License-Identifier:", []),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby\ngranted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
        ("Foo Bar is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", ["AGPL-3.0-or-later"]),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", ["GPL-2.0-or-later"]),
        ("Water is free software in this story.", []),
    ],
)
def test_licence_names(text, want):
    assert named(f"Before.\n{text}\nAfter") == want


@pytest.mark.parametrize("width", [20, 50, 60, 10_000])
def test_licences_of_any_width(width):
    """A whole BSD text with a holder's name, at any line width and with any comment leader."""
    parts = [licenses.SENTENCES[n][0] for n in ("bsd-redist", "bsd-source", "bsd-binary")]
    parts.append("Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
    for lead in ("", "# ", " * "):
        text = "\n".join(f"{lead}{line}" for p in ["Copyright 2020 A B", *parts] for line in textwrap.wrap(p, width))
        assert named(text) == ["BSD-3-Clause"], (width, lead)
    mit = "\n".join(line for n in ("mit-grant", "mit-notice", "asis", "liability") for line in textwrap.wrap(licenses.SENTENCES[n][0], width))
    assert named(mit) == ["MIT"]


def test_every_rule_is_found():
    for name, rules in licenses.RULES.items():
        for rule in rules:
            text = "\n\n".join(licenses.SENTENCES[n][0].replace("*", "Some Name") for n in rule)
            assert named(text) == [name], rule


def test_license_scan_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "Released under the MIT License.\n" + "word " * 200_000 + "\nAll rights reserved.", "y"), (2, "", "z")], "doc_id long, text string, sentences string")
    rows = licenses.scan(df, "text", F.col("doc_id")).collect()
    assert sorted((r.doc_id, [x["name"] for x in r.licences]) for r in rows) == [(1, []), (2, []), (2, ["MIT", "Proprietary"])]
    assert licenses.scan(df.limit(0), "text", F.col("doc_id")).count() == 0

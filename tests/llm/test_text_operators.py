"""Decontamination, near-duplicates, line dedup and license scans against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.llm import components, decontamination, licenses, linededup, neardup, sampling, textbytes

DOCS = "doc_id long, text string, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], DOCS)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_words_and_hashes():
    texts = ["Añb c-d", None, "", "  ", "x" * 50, "日本 é9_Z", "a b"]
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or "")) for t in texts]
    seen = {}
    for limit in (1, 7, 1000):
        got = []
        for lo, hi, data, offsets in textbytes.text_slices(pa.array(texts), limit):
            data = textbytes.LOWER[data]
            starts, ends, first = textbytes.words(data, offsets, textbytes.ALNUM)
            h = textbytes.span_hashes(data, starts, ends)
            for i in range(hi - lo):
                w = [data[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
                got.append(w)
                for word, x in zip(w, h[first[i] : first[i + 1]].tolist(), strict=True):
                    assert seen.setdefault(word, x) == x
        assert got == want
    assert len(set(seen.values())) == len(seen)


def contaminated(texts, items, size=13):
    out = {}
    wins = []
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
        wins += [(i, w[k : k + size]) for k in range(max(1, len(w) - size + 1) if w else 0)]
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
        hit, found = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize(("block", "many", "step"), [(1 << 18, 16, 1 << 21), (20, 3, 7)])
def test_decontamination(spark, monkeypatch, block, many, step):
    monkeypatch.setattr(decontamination, "MANY", many)
    monkeypatch.setattr(decontamination, "STEP", step)
    rng = random.Random(3)
    vocab = ["the", "of", "Ab", "cé", "d9", "e", "f"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 13, 14, 20]) if k < 8 else 16)) for k in range(12)] + [(3, text(15)), (60, text(90)), (60, text(90)), (50, None), (51, " ..."), (100, "only-here")]
    texts = [None, "", "...", "only here, ONLY HERE", *(text(rng.randint(1, 60)) for _ in range(20)), *(f"{text(9)}. {t}! {text(4)}" for _, t in items if t)]
    got = decontamination.digest(decontamination.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_words=block))
    assert {r.doc_id: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got.collect()} == contaminated(texts, items)


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(None, "a b", 1), (5, "a b", 2), (5, "a b", 2)], "doc_id long, text string, n_words int")
    got = decontamination.digest(decontamination.contamination(df, none)).collect()
    assert [(r.doc_id, r.n_words, r.contaminated) for r in got].count((5, 2, False)) == 2 and (None, 2, False) in [(r.doc_id, r.n_words, r.contaminated) for r in got]
    assert decontamination.digest(decontamination.contamination(df.limit(0), none)).count() == 0


def test_phrases_and_proximity(spark):
    index = decontamination.build_index(docs(spark, ["a b c a b", "b a x c", "a b", ""]))
    exact = {(r.doc_id, r.phrase, r.position) for r in decontamination.find_phrases(index, ["a b", "c", "", "zz a"]).collect()}
    assert exact == {(0, 0, 0), (0, 0, 3), (2, 0, 0), (0, 1, 2), (1, 1, 3)}
    near = {(r.doc_id, r.position) for r in decontamination.find_phrases(index, ["c a"], slop=1).collect()}
    assert near == {(0, 2)}
    assert {(r.doc_id, r.position) for r in decontamination.find_phrases(index, ["c a"], slop=2).collect()} == {(0, 2), (1, 3)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("leaf", "depth", "hub"), [(1024, 6, 256), (6, 2, 256), (4, 6, 3)])
def test_near_duplicates(spark, monkeypatch, leaf, depth, hub):
    monkeypatch.setattr(neardup, "HUB", hub)
    monkeypatch.setattr(sampling, "HOT", 20)
    rng = random.Random(leaf)
    vocab = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "One", "one", "one two", "ONE\ttwo"]
    for group in range(6):
        base = [rng.choice(vocab) for _ in range(120)]
        for k in range(25 if group == 0 else 4):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w[: len(w) - rng.randint(0, 3)]))
    boiler = " ".join(vocab[:14])
    texts += [boiler + " " + " ".join(rng.choice(vocab) for _ in range(40)) for _ in range(40)] + [texts[10]] * 30
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, texts), n=4, leaf=leaf, depth=depth).collect()}
    assert got == near(texts, 4, 80)


def test_nodes_over_batches(monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 10, raising=False)
    rng = np.random.default_rng(3)
    counts = np.array([1, 2, 3, 12, 1, 20, 2, 9, 5])
    node = np.repeat(np.arange(len(counts)), counts)
    rep, comp = np.arange(len(node)), rng.integers(0, 4, len(node))
    comp[node == 5] = 7
    base = rng.integers(0, 2**32, (3, neardup.TOKENS), dtype=np.uint32)
    kind = rng.integers(0, 3, len(node))
    rows = pa.RecordBatch.from_arrays([*(pa.array(x) for x in (node, rep, np.full(len(node), 50), comp)), neardup.fixed(base[kind])], names=["node", "rep", "n_shingles", "comp", "tokens"])
    want = {(a, b) for a in rep.tolist() for b in range(a + 1, len(node)) if node[a] == node[b] and kind[a] == kind[b] and comp[a] != comp[b]}
    for step in (1, 7, len(node)):
        out = list(neardup._compare(0.8, False)(iter([rows.slice(k, step) for k in range(0, len(node), step)])))
        got = [(r["a"], r["b"]) for x in out for r in x.to_pylist()]
        assert sorted(got) == sorted(want)
        assert max(len(x) for x in out) < 10 + 12 * 11 // 2  # pairs of all nodes of a batch are not held together


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (2, "a b c d e", 1), (2, "a b c d e", 1)], "doc_id long, text string, n_shingles int")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == [(2, 2, True), (2, 2, True), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def without_repeats(texts, least):
    """(text, words gone): every window of least words that occurred before, without overlap, is cut to the word."""
    toks = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    seen, gone, out = {}, set(), []
    for i, found in enumerate(toks):
        w = [m.group() for m in found]
        for s in range(len(w) - least + 1):
            doc, first = seen.setdefault(tuple(w[s : s + least]), (i, s))
            if doc != i or s >= first + least:
                gone |= {(i, j) for j in range(s, s + least)}
    for i, (t, found) in enumerate(zip(texts, toks, strict=True)):
        edges = [0, *(m.start() for m in found[1:]), len(t or "")]
        cut = [(i, j) in gone for j in range(len(found))]
        out.append((t if not found else "".join(t[edges[j] : edges[j + 1]] for j in range(len(found)) if not cut[j]), sum(cut)))
    return out


@pytest.mark.parametrize("least", [1, 8, 50, 63, 64, 100])
def test_line_dedup(spark, least):
    rng = random.Random(least)
    lines = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6 * max(1, least // 10)))) + rng.choice(["", ".", "!"]) for _ in range(12)]
    texts = [None, "", "\n\n", " a b c d e f g h i j"] + ["".join(rng.choice(lines) + rng.choice(["\n", " ", "\n\n", " \n"]) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    texts += [" ".join(["x"] * 300), " ".join(["x", "y"] * 150), " ".join(["x"] * 150)]  # runs that overlap themselves
    got = [(r.text, r.n_removed) for r in linededup.dedup(docs(spark, texts), least=least).orderBy("doc_id").collect()]
    assert got == without_repeats(texts, least)


def test_line_dedup_inside_lines(spark):
    """A passage is found wherever it begins in a line and however it is wrapped, and is cut to its last word."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(51)]
    texts = []
    for k in range(30):
        own = [[word() for _ in range(rng.randint(3, 90))] for _ in range(2)]
        texts.append(" ".join(own[0]) + rng.choice([" ", "\n"]) + rng.choice([" ", "\n", "  "]).join(passage) + " " + " ".join(own[1]))
    rows = linededup.dedup(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0] + [51] * 29
    assert [(r.text, r.n_removed) for r in rows] == without_repeats(texts, 50)


def test_line_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a b c d", 9), (1, "a b c d", 9), (1, "d c b a", 9), (None, "a b c d", 9), (None, None, 9)], "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id, r.text, r.n_words, r.line_n_words, r.n_removed) for r in linededup.dedup(df, least=2).collect()), key=str)
    assert got == sorted([(1, "", 9, 4, 4), (1, "", 9, 4, 4), (1, "d c b a", 9, 4, 0), (None, "a b c d", 9, 4, 0), (None, None, 9, 0, 0)], key=str)
    assert linededup.dedup(df.limit(0)).count() == 0


def test_winnowing_guarantee():
    """Each window of least words belongs to one fingerprint, which is its least line hash, the first if tied."""
    rng = random.Random(0)
    for least in (1, 5, 20, 50):
        for _ in range(20):
            h = np.array([rng.randrange(40) for _ in range(130)], np.uint64)
            first, span = np.array([0, 0, 60, 70, 130]), linededup.span_of(least)
            runs = linededup.Runs(h)
            begin, stop, place = linededup.winnow(runs, len(h), first, least)
            owner = {s: p for a, b, p in zip(begin.tolist(), stop.tolist(), place.tolist(), strict=True) for s in range(a, b)}
            lines = runs.of(np.arange(131 - span), np.arange(131 - span) + span).tolist()
            want = {s: min(range(s, s + least - span + 1), key=lambda k: (lines[k], k)) for a, b in ((0, 60), (60, 70), (70, 130)) for s in range(a, b - least + 1)}
            assert owner == want


def test_licenses(spark):
    mit = "/* Copyright (c) 2020 A B\n * Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n * documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n *\n * The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n */ code"
    texts = [None, "", "Nothing here", "Foo bar\nReleased under the MIT License.\nmore", mit, "# Licensed under the Apache License,\n# Version 2.0. text. All rights reserved.", "SPDX-License-Identifier: BSD-2-Clause", "we like the MIT License very much", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."]
    got = [[x["name"] for x in r.licences] for r in licenses.scan(docs(spark, texts), "text", F.col("doc_id")).orderBy("doc_id").collect()]
    assert got == [[], [], [], ["MIT"], ["MIT"], ["Apache-2.0", "Proprietary"], ["BSD-2-Clause"], [], ["CC-BY-NC-4.0", "CC-BY-NC-4.0"]]
    assert licenses.scan(docs(spark, texts).limit(0)).count() == 0
    for name, forms in licenses.SENTENCES.items():
        for form in forms:
            assert licenses.sentences("Before.\n" + form.replace("*", "Some Name") + "\nAfter")[0][0] == name

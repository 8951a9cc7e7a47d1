"""Trained operators and the pipeline against plain Python: the models are given, all that follows from them is worked out text by text."""

import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_text_operators import ascii_lower, near, without_repeats

import corpus_pipeline
from knotwork.llm import chat, langid, quality, queries, sentencepiece_scan, sharding

SF = "/root/testdata/sf0.001"
M32 = (1 << 32) - 1


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def measures(text):
    """quality.MEASURES of one text, by their definitions."""
    b = (text or "").encode()
    words = [w.encode() for w in spaced(text)]
    n = len(words)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    lower = [ascii_lower(w) for w in spaced(text)]
    same = sum(x == y for x, y in zip(lower, lower[1:], strict=False))
    rest = [[c for c in w if not letter(c)] for w in words]
    plain = sum(not r or (len(r) == 1 and r[0] == w[-1] and chr(r[0]) in ".,!?;:") for r, w in zip(rest, words, strict=True))
    letters, size, some = max(1, sum(map(letter, b))), max(1, len(b)), max(1, n)
    count = lambda signs: sum(chr(c) in signs for c in b if c < 128)
    return [n, sum(65 <= c <= 90 for c in b) / letters, count("#$%&*@^~|<>{}[]\\=+_") / size, count("!") / some, count("|") / some, len(set(lower)) / some, same / some, sum(map(len, words)) / some, count(".!?;:") / some, plain / some]


def score(text, m, scorer):
    """The scorer's score of one text, gram by gram."""
    if not m[0]:
        return 0.0
    b = text.encode()
    kind = [1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else {32: 4, 10: 5, 9: 6, 11: 6, 12: 6, 13: 6}.get(c, c) for c in b]
    z = scorer.bias + sum(scorer.measures[quality.measure_codes(np.array([m]))[0]])
    for n in (3, 5):
        total = 0.0
        for i in range(len(kind)):
            h = n
            for k in range(n):
                h = (h * 0x01000193 + (kind[i + k] if i + k < len(kind) else 4) * 0x9E3779B1) & M32
            h ^= h >> 15
            h = h * 0x85EBCA6B & M32
            total += float(scorer.grams[(h ^ h >> 13) & (quality.FEATURES - 1)])
        z += total / len(kind)
    return 1 / (1 + math.exp(-z))


def test_quality_against_plain_scores(spark, docs):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model, scorer = quality.train(df)
    got = queries.op3_quality(spark, SF).toPandas().sort_values("doc_id")
    for text, r in zip(docs.text, got.itertuples(), strict=True):
        m = measures(text)
        v = quality.votes(np.array([m]))[0]
        code = sum(int(x) * 3**k for k, x in enumerate(v)) if m[0] else -1
        assert r.pattern == code
        odds = math.log(model.share / (1 - model.share)) + sum((1 if x == quality.BAD else -1) * math.log(a / (1 - a)) for x, a in zip(v, model.accuracy, strict=True) if x != quality.NONE)
        assert r.p_bad == pytest.approx(1 / (1 + math.exp(-odds)) if m[0] else 1.0, abs=2e-6)
        s = score(text, m, scorer)
        assert r.score == pytest.approx(s, abs=2e-6)
        if abs(s - 0.5) > 1e-6:
            assert r.keep == (s >= 0.5 or code == 0)


def test_expectation_maximisation_row_by_row():
    """EM over counted patterns is EM over documents."""
    rng = np.random.default_rng(2)
    votes = rng.integers(0, 3, (300, len(quality.LABELLERS)))
    p, c = np.unique(quality.pattern(votes), return_counts=True)
    model = quality.expectation_maximisation(p, c.astype(float), rounds=7)
    share, acc = 0.1, [0.9] * votes.shape[1]
    for _ in range(7):
        bad = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum((1 if x == quality.BAD else -1) * math.log(a / (1 - a)) for x, a in zip(v, acc, strict=True) if x)
            bad.append(1 / (1 + math.exp(-odds)))
        acc = [min(0.99, max(0.55, (9 + sum(b if v[k] == quality.BAD else 1 - b for v, b in zip(votes, bad, strict=True) if v[k])) / (10 + sum(v[k] != 0 for v in votes)))) for k in range(votes.shape[1])]
        share = min(0.5, max(0.001, (sum(bad) + 1) / (len(votes) + 10)))
    assert model.share == pytest.approx(share) and model.accuracy == pytest.approx(acc)


def grams(text):
    """{feature: count} of a text, character by character."""
    low = lambda ch: ch.lower() if len(ch.lower()) == 1 else ch
    kept = "".join(low(ch) if unicodedata.category(ch)[0] in "LM" else " " for ch in text)
    cp = [ord(ch) for ch in " " + re.sub(" +", " ", kept) + " "]
    out = {}
    for n in (1, 2, 3):
        for i in range(len(cp) - n + 1):
            g = 0
            for c in cp[i : i + n]:
                g = (g * 0x01000193 & M32) ^ (c * 0x9E3779B1 & M32)
            h = (g ^ g >> 15) * 0x85EBCA6B & M32
            f = (h ^ h >> 13) & (langid.BUCKETS - 1)
            out[f] = out.get(f, 0) + 1
    return out


def test_languages_against_plain_scores(spark, docs):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(df.where(~held))
    got = queries.op9_language_id(spark, SF).toPandas().sort_values("doc_id")
    learn = [t for i, t in zip(docs.doc_id, docs.text, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = {}
    for t in learn:
        for f in grams(t):
            seen[f] = seen.get(f, 0) + 1
    assert model.idf == pytest.approx([math.log((1 + len(learn)) / (1 + seen.get(f, 0))) + 1 for f in range(langid.BUCKETS)])
    for text, r in zip(docs.text, got.itertuples(), strict=True):
        x = {f: (1 + math.log(c)) * model.idf[f] for f, c in grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[f, k] for f, v in x.items()) + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(v - max(z)) for v in z]
        assert r.score == pytest.approx(max(p) / sum(p), abs=1e-9) and r.lang_pred == model.languages[int(np.argmax(p))]


def words(text):
    return list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or "")))


def decontaminated(text, windows):
    """None if the text goes, else what is left of it. windows by length."""
    found = words(text)
    w = [m.group() for m in found]
    hit = {j for n, known in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in known for j in range(i, i + n)}
    if hit and 20 * len(hit) >= len(w):
        return None
    out, at = "", 0
    for j in sorted(hit):
        if j - 1 not in hit:
            out += text[at : found[j].start()]
        at = found[j].end()
    return out + text[at:]


def test_pipeline_against_plain_stages(spark, docs):
    kept = {r.doc_id for r in quality.classify(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).where("keep").collect()}
    rows = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if i in kept]
    cut = without_repeats([t for _, t in rows], 50)
    rows = [(i, new) for (i, t), (new, gone) in zip(rows, cut, strict=True) if not gone or corpus_pipeline.REMAINDER * (len(spaced(t)) - gone) >= len(spaced(t))]
    alike = near([t for _, t in rows], 5, 80)
    rows = [r for k, r in enumerate(rows) if alike[k][2]]
    windows = {}
    for t in pd.read_parquet(f"{SF}/benchmark.parquet").text:
        w = [m.group() for m in words(t)]
        n = min(13, len(w))
        windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    left = {i: new for i, t in rows if (new := decontaminated(t, windows)) is not None}
    sp = sentencepiece_scan.load(sentencepiece_scan.MODEL).sp
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: sp.encode(t) for i, t in left.items()}
    assert 0.5 * len(docs) < len(got) < len(docs)


def test_very_long_texts_of_other_operators(spark):
    long = "Ein sehr langer Satz mit Wörtern. " * 60_000
    df = spark.createDataFrame([(1, long, "de"), (None, long, "de"), (2, "Another short text in words", "en"), (2, "Another short text in words", "en"), (3, None, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.predict(df, langid.train(df), "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=str) == sorted([(1, "de"), (None, "de"), (2, "en"), (2, "en"), (3, "und")], key=str)
    sizes = {(r.doc_id, r["size"], r.links, r.cut) for r in sharding.shard_documents(df.withColumn("row", F.lit(1)), 2).collect()}
    assert {x[:2] for x in sizes} == {(1, len(long.encode()) + 8), (None, len(long.encode()) + 8), (2, 35), (3, 8)}
    said = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string").withColumn("c", F.lit(0)).withColumn("formatted", F.lit("x"))
    r = chat.digests(chat.format_turns(said)).first()
    assert (r.n_turns, r.loss_chars) == (3, 2 * len(long))


def test_languages_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    ids = spark.createDataFrame([(None, "der Satz und die Worte", "de")] * 5 + [(None, "the words and a sentence", "en")] * 5 + [(7, None, "fr"), (7, "12", None)], "doc_id long, text string, lang string")
    model = langid.train(ids)
    assert model.languages == ["de", "en"]  # ids play no part, and a text that stands five times counts once
    assert sorted({r.lang_pred for r in langid.predict(ids, model).collect()}) == ["de", "en", "und"]


def test_decontaminated_by_hand():
    rng = random.Random(1)
    item = tuple(f"i{k}" for k in range(13))
    own = [f"o{rng.randrange(10**6)}" for _ in range(400)]
    text = " ".join(own[:200]) + ". " + " ".join(item) + "! " + " ".join(own[200:])
    assert decontaminated(text, {13: {item}}) == " ".join(own[:200]) + ". " + "! " + " ".join(own[200:]) and decontaminated(" ".join(item), {13: {item}}) is None

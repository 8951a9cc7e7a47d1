"""Trained models, tokens, chats, shards and neighbours: held-out accuracy, exact round trips, brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from knotwork.llm import chat, langid, permutation_index, quality, sentencepiece_scan, sharding

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_agrees_with_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(documents.select("doc_id", "text")).join(labels, "doc_id").select("quality", "keep").collect()
    assert sum((r.quality == 1) == r.keep for r in rows) >= 0.98 * len(rows)
    assert sum(r.keep for r in rows if r.quality == 1) >= 0.995 * sum(r.quality == 1 for r in rows)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, " ", 2.0), (3, "Ein Satz mit Worten. Noch ein Satz.", 3.0), (3, "Ein Satz mit Worten. Noch ein Satz.", 3.0), (None, "x y", 4.0)], "doc_id long, text string, score double")
    out = {(r.doc_id, r.text): (r.keep, r.score, r.quality_score) for r in quality.classify(df).collect()}
    assert out[1, None] == (False, 1.0, 0.0) and out[2, " "][0] is False and quality.classify(df).count() == 5
    assert quality.classify(df.limit(0)).count() == 0
    assert quality.classify(df.where("doc_id = 1")).first().keep is False


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    n, right = 20000, np.array([0.95, 0.9, 0.85, 0.9, 0.8, 0.95, 0.7, 0.9])
    bad = rng.random(n) < 0.3
    votes = np.where(rng.random((n, 8)) < 0.3, 0, np.where((rng.random((n, 8)) < right) == bad[:, None], quality.BAD, quality.GOOD))
    p, c = np.unique(quality.pattern(votes), return_counts=True)
    model = quality.expectation_maximisation(p, c.astype(float))
    assert abs(model.share - 0.3) < 0.02 and np.abs(model.accuracy - right).max() < 0.03


def test_language_id(spark, documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(documents.where(~held), sample=800)
    assert (model.weights == 0).mean() > 0.1
    rows = langid.predict(documents.where(held), model, "doc_id", "text", F.col("lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 ... ²", "x"), (4, "é", "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.languages
    assert langid.train(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.predict(odd, None).first().lang_pred == "und"


def test_chunked_features_are_whole():
    text = "Größe é 日本 abc!  def " * 300
    at, n = langid.features(text)
    assert n.sum() > 3 * 0.8 * len(text) and len(at) == len(n)


@pytest.fixture(scope="module")
def model():
    return sentencepiece_scan.load(sentencepiece_scan.MODEL)


def test_scan_gives_what_the_library_gives(model):
    rng = random.Random(1)
    alphabet = "aaabbcdeilnorst  \n.,éß日😀xX1"
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(60)] + ["a" * k for k in range(1, 90, 7)] + [" " * 57, "the" * 60, "=-" * 70, "\n" * 50, ""]
    for text in cases:
        for size in (1, 90):
            assert sentencepiece_scan.scan_encode(model, text, size) == model.sp.encode(text)


def test_matrices_are_associative(model):
    text = model.normalised("the quick brown fox jumps over the lazy dog and runs " * 8)
    parts = sentencepiece_scan.chunks(len(text), 60, model.longest)
    m = [sentencepiece_scan.transfer(model, text, 0, a, b, len(text)) for a, b in parts][:4]
    c = sentencepiece_scan.combine
    assert c(c(m[0], m[1]), c(m[2], m[3])) == c(m[0], c(m[1], c(m[2], m[3]))) == sentencepiece_scan.product(m)


def test_unigram_weights(model):
    """With scores as weights the scan finds the best of all segmentations, as one pass over the text does."""
    import copy

    m = copy.copy(model)
    m.merges = False
    rng = random.Random(2)
    for _ in range(20):
        t = "".join(rng.choice("thean ing") for _ in range(150)).replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(t)
        for i in range(len(t)):
            for p in m.starting(t, i):
                best[i + len(p)] = max(best[i + len(p)], best[i] + m.score.get(p, m.unknown))
        parts = sentencepiece_scan.chunks(len(t), 40, m.longest)
        ways = [None, *sentencepiece_scan.choose([sentencepiece_scan.transfer(m, t, 0, a, b, len(t)) for a, b in parts], None, None, len(t))]
        pieces = [p for k, (_, b) in enumerate(parts) for p in sentencepiece_scan.trace(m, t, 0, ways[k], ways[k + 1], b)]
        assert "".join(pieces) == t and sum(m.score.get(p, m.unknown) for p in pieces) == pytest.approx(best[-1])


def test_encode_and_decode(spark, model):
    texts = [None, "", "Ein Text.", "giant words " * 40, "x" * 700, "日本 é " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = sentencepiece_scan.encode(df, "text", F.col("doc_id"), giant=300, chunk=100)
    got = {r.doc_id: (r.ids, r.round_trip) for r in out.collect()}
    assert got[0] == (None, None) and got[1] == ([], True)
    assert all(got[k] == (model.sp.encode(t), True) for k, t in enumerate(texts) if t)
    back = {r.doc_id: r.text for r in sentencepiece_scan.decode(out, "ids", F.col("doc_id")).collect()}
    assert back == dict(enumerate(texts))
    assert sentencepiece_scan.encode(df.limit(0), "text", F.col("doc_id")).count() == 0
    deep = sentencepiece_scan.encode(df.where("doc_id > 2"), "text", F.col("doc_id"), giant=10, chunk=40, fan=2)
    assert {r.doc_id: r.ids for r in deep.collect()} == {k: model.sp.encode(t) for k, t in enumerate(texts) if k > 2}


def spoken(turns):
    """Digests of one conversation's (role, text), by the definition."""
    said = [(r or "", t or "") for r, t in turns]
    own = [t for r, t in said if r == "assistant"]
    return len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), sum(map(len, own)), hashlib.sha256("".join(own).encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["\\", "<turn ", "</turn>\n", "<\\turn ", ">", "\n", "é日😀", "ok", " ", "<", "### Assistant:"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    convs = {k: [(rng.choice(["user", "assistant", "a>b\\", "", None]), rng.choice([None, text(), text()])) for _ in range(rng.randint(1, 6))] for k in range(40)}
    convs[-5] = [("assistant", str(k)) for k in range(chat.PART * 2 + 3)]
    convs[-6] = [("assistant", "x")] * chat.PART
    df = spark.createDataFrame([(c, k, r, t, "z") for c, turns in convs.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_turns(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(formatted).collect()}
    assert got == {c: spoken(turns) for c, turns in convs.items()}
    parts = {}
    for r in formatted.collect():
        parts.setdefault(r.conv_id, []).append((r.part, r.n_turns, r.last))
    assert sorted(parts[-5]) == [(0, chat.PART, False), (1, chat.PART, False), (2, 3, True)] and parts[-6] == [(0, chat.PART, True)]
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


@pytest.mark.parametrize("batch", [1, 3, 700])
def test_chat_over_batches(spark, batch):
    turns = [(c, k, "assistant" if k % 2 else "user", f"{c}-{k}") for c, n in ((None, 3), (1, chat.PART + 5), (2, 1), (3, 2)) for k in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_turns(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: spoken([(r, t) for x, _, r, t in turns if x == c]) for c in (None, 1, 2, 3)}


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(spark, shards):
    rng = random.Random(shards)
    texts = [None, None, "", ""] + [rng.choice(["a", "b é", "c"]) if k % 3 == 0 else f"t{rng.randrange(150)}" for k in range(400)]
    df = spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sharding.shard_documents(df, shards).collect()
    counts = [sum(r.shard == s for r in got) for s in range(shards)]
    assert len(got) == len(texts) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(shards))
    by = {r.doc_id or 0: r for r in got}
    assert all(by[k].size == len((t or "").encode()) + 8 and by[k].text_crc32 == zlib.crc32((t or "").encode()) for k, t in enumerate(texts))
    where = {}
    for k, t in enumerate(texts):
        where.setdefault(t, []).append(by[k].shard)
    del where[None]
    assert by[0].links == by[1].cut == 0
    for k, t in enumerate(texts):
        if t is not None and k:
            assert (by[k].links, by[k].cut) == (len(where[t]) - 1, sum(s != by[k].shard for s in where[t]))
    small = [p for t, p in where.items() if 1 < len(p) < 5]
    torn = sum(len(set(p)) > 1 for p in small)
    assert torn <= 0.1 * len(small) + 1
    # links that are cut, against a placement by hash
    cut = sum(len(p) ** 2 - sum(p.count(s) ** 2 for s in set(p)) for p in where.values())
    chance = sum(len(p) * (len(p) - 1) for p in where.values()) * (1 - 1 / shards)
    assert cut <= (0.9 if shards == 24 else 0.4) * chance  # three texts have more copies than one of 24 shards has rows
    assert sharding.shard_documents(df.limit(0), shards).count() == 0


def test_sharding_keeps_large_groups_whole(spark):
    """A text with as many copies as fit in a shard isn't split; a larger one is, into as few parts as need be."""
    sizes = {"a": 1000, "b": 900, "c": 700, "d": 90, "e": 3}
    texts = [t for t, n in sizes.items() for _ in range(n)] + ["z" * 70_000] + [f"t{k}" for k in range(4000 - sum(sizes.values()) - 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in sharding.shard_documents(df, 4).collect()}
    counts = [sum(r.shard == s for r in got.values()) for s in range(4)]
    assert counts == [1000] * 4
    places = {t: {got[k].shard for k, x in enumerate(texts) if x == t} for t in sizes}
    assert all(len(places[t]) == 1 for t in "abcde") and sum(r.cut for r in got.values()) == 0
    got = {r.doc_id: r for r in sharding.shard_documents(df, 5).collect()}
    assert all(sum(got[k].shard == s for k in got) == 800 for s in range(5))
    assert len({got[k].shard for k, x in enumerate(texts) if x == "c"}) == 1


def nearest(ids, v, own, q, k=10):
    """(score, id) of the nearest rows but the query's own one, by brute force."""
    gap = np.sqrt(((v - q) ** 2).sum(axis=1))
    order = np.lexsort((ids, gap)).tolist()
    order.remove(next(i for i in order if ids[i] == own and (v[i] == q).all()))
    return [(gap[i], int(ids[i])) for i in order[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = np.float32(rng.normal(size=(3000, 24))).astype(float)
    rows = [(k, v[k].tolist()) for k in range(3000)]
    rows += [(3000 + k, v[5].tolist()) for k in range(20)] + [(7, v[7].tolist()), (7, v[8].tolist())]  # ties, repeated rows and ids
    rows += [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9004, [None] * 24), (None, v[0].tolist())]
    few = [(100 * k, [float(k), 1.0]) for k in range(1, 5)]  # another dimension
    df = spark.createDataFrame(rows + few, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    out = permutation_index.neighbours(df, df.where("vec_id % 100 = 0 or vec_id in (5, 7) or vec_id > 8000"), 10, segment=1000).collect()
    whole = [r for r in rows if r[1] and r[0] is not None and r[0] < 9000]
    ids, m = np.array([r[0] for r in whole]), np.array([r[1] for r in whole])
    asked = [(i, x) for i, x in whole if i % 100 == 0 or i in (5, 7)]
    assert {r.query_id for r in out} == {i for i, _ in asked}
    hit = total = 0
    for i, q in asked:
        want = nearest(ids, m, i, q)
        mine = [(r.score, r.vec_id) for r in out if r.query_id == i]
        hit += sum(any(abs(s - x) < 1e-9 and v == y for x, y in mine) for s, v in want)
        total += 10
        if i not in (7, *(100 * k for k in range(1, 5))):
            assert len(mine) == 10 and mine == sorted(mine)
    assert hit >= 0.9 * total
    assert sorted(r.vec_id for r in out if r.query_id == 5) == list(range(3000, 3010))
    assert len([r for r in out if r.query_id == 7]) == 30 and sum(r.score == 0 and r.vec_id == 7 for r in out if r.query_id == 7) == 2
    small = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == 200 and r.vec_id in (100, 300, 400) and r.score in (1.0, 2.0))
    assert small == [(1, 100, 1.0), (2, 300, 1.0), (3, 400, 2.0)]
    assert permutation_index.neighbours(df.limit(0), df).count() == 0 == permutation_index.neighbours(df, df.limit(0)).count()


def test_recall_on_many_vectors(spark, tmp_path):
    """50,000 vectors without any structure, the hardest case: recall is 0.9 or more with far from all vectors ranked exactly; with structure, few are."""
    rng = np.random.default_rng(3)
    for clusters, most in ((0, 0.3), (2000, 0.05)):
        v = rng.normal(size=(50_000, 48))
        if clusters:
            v = rng.normal(size=(clusters, 48))[rng.integers(0, clusters, 50_000)] + 0.3 * v
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        pq.write_table(pa.table({"vec_id": np.arange(50_000), "embedding": list(v)}), tmp_path / f"{clusters}.parquet")
        df = spark.read.parquet(str(tmp_path / f"{clusters}.parquet"))
        points = permutation_index.spread(permutation_index.usable(df, "vec_id", "embedding"), 512)
        index = permutation_index.build_index(permutation_index.usable(df, "vec_id", "embedding"), points)
        share = permutation_index.measured_share(index, v[:32], points, 10, 64)
        assert share < most
        out = permutation_index.neighbours(df, df.where("vec_id % 500 = 0"), 10).collect()
        found = {(r.query_id, r.vec_id) for r in out}
        want = {(q, i) for q in range(0, 50_000, 500) for _, i in nearest(np.arange(50_000), v, q, v[q])}
        assert len(found & want) >= 0.9 * len(want) == 0.9 * len(found)


def test_neighbours_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(60)], "vec_id long, embedding array<float>")
    once = {tuple(r) for r in permutation_index.neighbours(df, df, 3).collect()}
    monkeypatch.setattr(permutation_index, "BLOCK", 7)
    monkeypatch.setattr(permutation_index, "MANY", 2)
    assert {tuple(r) for r in permutation_index.neighbours(df, df, 3).collect()} == once

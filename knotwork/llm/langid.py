"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Code points are lower-cased one by one where that keeps one code point; runs of what isn't a letter count as one space. Grams of 1 to 3 characters
are hashed into BUCKETS features, with 1 + log(count), times the inverse document frequency over all training texts, normalised to length 1. Weights are fitted with
follow-the-regularised-leader (per-coordinate rates, elastic net, so most weights of useless features are exactly 0) on a sample
of distinct training texts, chosen by a 64-bit hash of the text: SAMPLE in proportion to the languages, but LEAST of each language that has as many, for up to
LANGUAGES of them (the most frequent ones), so a rare language is learned in a table of any size. Of each language every fourth chosen text is kept back to fit the temperature that calibrates the scores.

A text that is null or has no letter is `und` with score 0. Where nothing can be learned (no labelled text, or an empty table), all are. A tie goes to the language that sorts first.
Repeated rows are predicted each, very long texts whole. Extra columns are ignored, whatever their names; neither language, source nor id is an input of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm import sampling, store

BUCKETS = 1 << 15
SAMPLE = 8000
#: Texts of each language at least, if it has as many; languages at most.
LEAST, LANGUAGES = 150, 1000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.002, 0.0005, 3
#: Code points of a text that are handled at a time.
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")

_fold: list[np.ndarray] = []


def fold() -> np.ndarray:
    """For each code point: its lower case if that is one code point, a space for what isn't a letter or mark."""
    if not _fold:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LM":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold.append(t)
    return _fold[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    table = fold()
    for at in range(0, len(text), CHUNK):
        cp = table[np.frombuffer(text[max(0, at - 2) : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(cp), bool)
        keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
        cp = np.concatenate(([32], cp[keep], [32])).astype(np.uint32)
        gram, sizes = np.zeros(len(cp), np.uint32), []
        for n in range(1, 4):
            if len(cp) < n:
                break
            gram = gram[: len(cp) - n + 1] * np.uint32(0x01000193) ^ (cp[n - 1 :] * np.uint32(0x9E3779B1))
            sizes.append(gram)
        h = np.concatenate(sizes)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        counts += np.bincount((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def document_frequencies(docs: DataFrame, text: str, lang: str, languages: int = LANGUAGES) -> tuple[np.ndarray, int, dict[str, int]]:
    """In how many texts each feature occurs, the number of texts, and that of each of the most frequent languages; counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, spoken = np.zeros(BUCKETS, np.int64), Counter()
        for batch in batches:
            for t, tongue in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                df[features(t.as_py())[0]] += 1
                spoken[tongue] += 1
            if len(spoken) > 10 * languages:
                yield counts_of(spoken)
                spoken.clear()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([None] * len(at), pa.string()), pa.array(df[at])], names=["feature", "lang", "n"])
        yield counts_of(spoken)

    def counts_of(spoken: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([-1] * len(spoken), pa.int32()), pa.array(list(spoken), pa.string()), pa.array(list(spoken.values()), pa.int64())], names=["feature", "lang", "n"])

    given = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    found, path = store.keep(given.mapInArrow(run, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")), "frequencies")
    out = np.zeros(BUCKETS, np.int64)
    for r in found.where("feature >= 0").collect():  # BUCKETS at most
        out[r.feature] = r.n
    spoken = found.where("feature = -1")
    total = spoken.agg(F.sum("n")).first()[0] or 0
    most = {r.lang: r.n for r in spoken.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    store.drop(docs.sparkSession, path)
    return out, int(total), most


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = features(text)
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm > 0 else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        at, x = vector(text, self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return self.languages[int(p.argmax())], float(min(1.0, p.max() / p.sum()))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and bias by FTRL-proximal with elastic net, over rows (features, values, class) in their order."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    rows = [(np.append(at, BUCKETS), np.append(x, 1.0), y) for at, x, y in rows]
    for _ in range(epochs):
        for at, x, y in rows:
            here, seen = z[at], n[at]
            root = np.sqrt(seen)
            w = -(np.sign(here) * np.maximum(np.abs(here) - l1, 0)) / ((beta + root) / alpha + l2)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            seen += g * g
            z[at] = here + g - (np.sqrt(seen) - root) / alpha * w
            n[at] = seen
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What to divide logits by for the least log loss; by golden section over 1/20 to 20."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> Model | None:
    """A model of docs' texts and languages; None where no row has both."""
    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    df, n, spoken = document_frequencies(known, "text", "lang")
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    bounds = [(tongue, sampling.bound(max(sample * of / n, min(least, of)), of)) for tongue, of in spoken.items()]
    table = docs.sparkSession.createDataFrame(bounds, "lang string, below long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in rows], pa.list_(pa.int32()))], names=["h", "lang", "at", "n"])

    picked = sampling.chosen(known.join(F.broadcast(table), "lang"), F.col("below"), 2 * (sample + least * len(spoken)), "text", "lang", "below")
    table = picked.select("h", "text", "lang").mapInArrow(run, "h long, lang string, at array<int>, n array<int>").toArrow()
    if not len(table):
        return None
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    hashes = table.column("h").to_numpy()
    rows, kept_back, seen = [], [], Counter()
    for k in sorted(range(len(names)), key=lambda k: (hashes[k], names[k])):
        at, c = (np.asarray(table.column(x)[k].values) for x in ("at", "n"))
        x = (1 + np.log(c)) * idf[at]
        (kept_back if seen[names[k]] % 4 == 3 else rows).append((at, x / max(np.sqrt((x * x).sum()), 1e-12), languages.index(names[k])))
        seen[names[k]] += 1
    weights, bias = follow_the_leader(rows, len(languages))
    t = temperature(np.array([x @ weights[at] + bias for at, x, _ in kept_back]), np.array([y for *_, y in kept_back])) if kept_back else 1.0
    return Model(languages, idf, weights, bias, t)


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """doc_id, what `more` names, lang_pred, score. The model (a few MB, whatever the corpus) goes to the tasks as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(doc_id).alias("doc_id"), *more, F.col(text).cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = []
            for t in texts:
                s = t.as_py()
                out.append(shared.value.predict(s) if shared.value and has_letter(s) else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return given.mapInArrow(run, f"{fields}, lang_pred string, score double")

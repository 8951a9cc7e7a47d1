"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Documents are counted by vote pattern (at most
3 ** labellers patterns, whatever the corpus), and expectation-maximisation over all of them estimates the labellers' accuracies and the share of
bad documents. The posterior of a document's pattern is its soft label. A hashed linear scorer - logistic, on the relative frequencies of hashed byte-class
n-grams and of some hashed measures of the text - is trained on the soft labels of about SAMPLE distinct texts, and scores every whole text. The sample is
taken by a 64-bit hash of the text, so it is of one size for any table, and neither null nor repeated ids nor copies of one text swell it.

A document is kept if its score is at least 0.5. Where no labeller votes (few words with numbers, say), the label model has no ground to reject: by its rule of
abstention the document is kept whatever the score. A null text, or one without any word, is empty: score 0, not kept. Should no chosen text have a word, the label model's
posterior is the score. Ties: a score of exactly 0.5 is kept. Repeated rows are scored each, very long ones whole. An empty table gives no rows. Extra columns are passed on; where one has the name of a result,
the result is called quality_<name>. Only a model of fixed size is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm import sampling
from knotwork.llm.textbytes import LOWER, NONSPACE, span_hashes, text_slices, words

FEATURES = 1 << 14
SAMPLE = 6000
GOOD, BAD, NONE = 1, 2, 0

#: Byte classes: lower, upper, digit, blank, line end, other space; other bytes stand for themselves; non-ASCII counts as lower.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x20], _CLASS[0x0A], _CLASS[[0x09, 0x0B, 0x0C, 0x0D]] = 4, 5, 6
_IS_LETTER = (_CLASS == 1) | (_CLASS == 2)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*@^~|<>{}[]\\=+_"]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?;:"]] = True
_AFTER = np.zeros(256, bool)
_AFTER[[*b".,!?;:"]] = True

MEASURES = ("n_words", "upper", "symbols", "bangs", "bars", "distinct", "same_next", "mean_length", "ends", "wordlike")
LABELLERS = ("shouting", "symbols", "bangs", "menu", "vocabulary", "stutter", "sentences", "words")


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MEASURES of each text of a slice, by rows."""
    starts, ends, first = words(data, offsets, NONSPACE)
    n = np.diff(first)
    out = np.zeros((len(n), len(MEASURES)))
    if not len(data):
        return out

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    some, letters, size = np.maximum(n, 1), np.maximum(total(_IS_LETTER[data]), 1), np.maximum(np.diff(offsets), 1)
    h = span_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    repeat = np.zeros(len(h), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], float)
    out[:, 0] = n
    out[:, 1] = total((data >= 0x41) & (data <= 0x5A)) / letters
    out[:, 2] = total(_SYMBOL[data]) / size
    out[:, 3] = total(data == 0x21) / some
    out[:, 4] = total(data == 0x7C) / some
    out[:, 5] = distinct / some
    out[:, 6] = np.bincount(doc, weights=repeat, minlength=len(n)) / some
    out[:, 7] = np.bincount(doc, weights=ends - starts, minlength=len(n)) / some
    out[:, 8] = total(_STOP[data]) / some
    # words of letters alone, but for one sign at the end
    seen = np.concatenate(([0], np.cumsum(_IS_LETTER[data])))
    rest = ends - starts - (seen[ends] - seen[starts])
    out[:, 9] = np.bincount(doc, weights=(rest == 0) | ((rest == 1) & _AFTER[data[ends - 1]]), minlength=len(n)) / some
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """The labellers' votes (NONE, GOOD, BAD), a column each; texts without words get no vote."""
    n, upper, symbols, bangs, bars, distinct, same, length, ends, wordlike = m.T
    # What few words share is little evidence: repetition is judged against the least share expected at this length.
    expected = np.minimum(0.5, 6 / np.sqrt(np.maximum(n, 1)))
    never = np.zeros(len(n), bool)
    clean = (wordlike > 0.9) & (same < 0.08)
    prose = clean & (upper < 0.12) & (symbols < 0.005) & (bangs < 0.02) & (bars == 0)
    rules = [
        (upper > 0.35, never),
        (symbols > 0.04, never),
        (bangs > 0.25, never),
        (bars > 0.15, never),
        ((distinct < 0.35 * expected) & (n >= 20), (distinct > 0.7 * expected) & (n >= 20) & clean),
        (same > 0.3, never),
        ((ends < 0.008) & (n >= 40), (ends > 0.03) & (ends < 0.4) & clean),
        (((wordlike < 0.6) | (length > 14) | (length < 2.2)) & (n >= 20), prose & (length < 14) & (length > 2.2)),
    ]
    out = np.stack([np.where(bad, BAD, np.where(good, GOOD, NONE)) for bad, good in rules], axis=1)
    return np.where(n[:, None] > 0, out, NONE)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


@dataclass
class LabelModel:
    """share of bad documents; accuracy: how often each labeller is right when it votes."""

    share: float
    accuracy: np.ndarray
    iterations: int

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document with this pattern is bad; abstaining says nothing, so it is the share where no labeller votes."""
        v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
        weight = np.log(self.accuracy) - np.log(1 - self.accuracy)
        odds = ((v == BAD) * weight - (v == GOOD) * weight).sum(axis=1) + np.log(self.share) - np.log(1 - self.share)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        return dict(zip(LABELLERS, self.accuracy.tolist(), strict=True))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Accuracies and share of bad documents by EM over counted patterns: labellers err independently, are better than chance and at most 0.99 right. Smoothed by ten votes, nine of them right."""
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    model = LabelModel(0.1, np.full(len(LABELLERS), 0.9), 0)
    for k in range(rounds):
        p = model.posterior(patterns) if len(patterns) else np.zeros(0)
        right = (counts * p) @ (v == BAD) + (counts * (1 - p)) @ (v == GOOD)
        accuracy = np.clip((right + 9) / (counts @ (v != NONE) + 10), 0.55, 0.99)
        share = float(np.clip(((counts * p).sum() + 1) / (counts.sum() + 10), 0.001, 0.5))
        done = abs(share - model.share) < 1e-10 and np.abs(accuracy - model.accuracy).max() < 1e-10
        model = LabelModel(share, accuracy, k + 1)
        if done:
            break
    return model


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the byte-class 3- and 5-grams at each byte (over the end of a text they take a blank's class)."""
    c = _CLASS[data]
    pad = np.concatenate((c, np.full(5, 4, np.uint32)))
    # past a text's end: blank
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    codes = []
    for n in (3, 5):
        h = np.full(len(data), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + np.where(left > k, pad[k : k + len(data)], np.uint32(4)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        codes.append((h ^ (h >> np.uint32(13))) & np.uint32(FEATURES - 1))
    return codes[0], codes[1]


def measure_codes(m: np.ndarray) -> np.ndarray:
    """Hashed features of the binned measures of each text: rows x measures."""
    n, *rest = m.T  # upper, symbols, bangs, bars, distinct, same_next, mean_length, ends, wordlike
    expected = np.minimum(0.5, 6 / np.sqrt(np.maximum(n, 1)))
    scaled = np.stack([rest[0] * 10, rest[1] * 100, rest[2] * 20, rest[3] * 20, rest[4] / expected * 6, rest[5] * 16, np.minimum(rest[6], 20) * 0.6, rest[7] * 60, rest[8] * 12], axis=1)
    bins = np.minimum(np.floor(scaled), 12).astype(np.uint32)
    h = (bins + np.arange(bins.shape[1], dtype=np.uint32) * np.uint32(16) + np.uint32(1)) * np.uint32(0x9E3779B1)
    return ((h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B) >> np.uint32(7)) & np.uint32(FEATURES - 1)


@dataclass
class Scorer:
    """score: logistic of a weighted sum; weights has one table for grams and one for measures."""

    grams: np.ndarray
    measures: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray, m: np.ndarray) -> np.ndarray:
        z = np.full(len(m), self.bias)
        for codes in gram_codes(data, offsets):
            sums = np.concatenate(([0.0], np.cumsum(self.grams[codes], dtype=np.float64)))
            z += (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
        z += self.measures[measure_codes(m)].sum(axis=1)
        return np.where(m[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def fit_scorer(grams: np.ndarray, at: list[np.ndarray], measures: np.ndarray, good: np.ndarray, epochs: int = 12, rate: float = 0.5, l2: float = 1e-6) -> Scorer:
    """Logistic regression by AdaGrad in the rows' order: grams[i] are frequencies at features at[i], measures are codes, good the soft labels."""
    w, v, bias = np.zeros(FEATURES), np.zeros(FEATURES), 0.0
    gw, gv, gb = np.full(FEATURES, 1e-6), np.full(FEATURES, 1e-6), 1e-6
    for _ in range(epochs):
        for i in range(len(good)):
            z = grams[i] @ w[at[i]] + v[measures[i]].sum() + bias
            g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - good[i]
            step = g * grams[i] + l2 * w[at[i]]
            gw[at[i]] += step * step
            w[at[i]] -= rate * step / np.sqrt(gw[at[i]])
            gv[measures[i]] += g * g
            v[measures[i]] -= rate * 0.2 * g / np.sqrt(gv[measures[i]])
            gb += g * g
            bias -= rate * 0.2 * g / np.sqrt(gb)
    return Scorer(w.astype(np.float32), v, float(bias))


def label(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """What `more` names, with each text's vote pattern (-1: no words)."""
    given = docs.select(*more, F.col(text).cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                m = measure(data, offsets)
                p = np.where(m[:, 0] > 0, pattern(votes(m)), -1)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(p, pa.int32())], names=[*batch.schema.names[:-1], "pattern"])

    return given.mapInArrow(run, f"{fields}pattern int")


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, Scorer | None]:
    """The label model of all docs, and a scorer trained on the posterior labels of a sample of their distinct texts; None where no chosen text has a word."""
    counted = label(docs, text).groupBy("pattern").agg(F.count("*").alias("n")).where("pattern >= 0").toPandas().sort_values("pattern")
    model = expectation_maximisation(counted.pattern.to_numpy(np.int64), counted.n.to_numpy(float))
    total = int(counted.n.sum())
    if not total:
        return model, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                m = measure(data, offsets)
                codes, p, measures = gram_codes(data, offsets), pattern(votes(m)), measure_codes(m)
                rows, at, x = np.flatnonzero(m[:, 0]), [], []
                for i in rows:
                    one = slice(offsets[i], offsets[i + 1])
                    count = sum(np.bincount(c[one], minlength=FEATURES) for c in codes)
                    at.append(np.flatnonzero(count).astype(np.int32))
                    x.append(count[at[-1]] / (one.stop - one.start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + rows], pa.int64()), pa.array(p[rows], pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64())), pa.array(list(measures[rows].astype(np.int32)), pa.list_(pa.int32()))],
                    names=["h", "pattern", "at", "x", "m"],
                )

    texts = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
    rows = sampling.chosen(texts, sampling.bound(sample, total), 2 * sample).mapInArrow(run, "h long, pattern int, at array<int>, x array<double>, m array<int>").toArrow().to_pandas().sort_values("h", kind="stable")
    if not len(rows):
        return model, None
    good = 1 - model.posterior(rows.pattern.to_numpy(np.int64))
    return model, fit_scorer(rows["x"].tolist(), rows["at"].tolist(), np.stack(rows["m"].tolist()), good)


def classify(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: its columns, then pattern, p_bad (the label model's posterior), score (of the linear scorer) and keep."""
    model, scorer = train(docs, text, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, scorer))
    names = [f.name for f in docs.schema.fields]
    at = names.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label_model, own = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                m = measure(data, offsets)
                p = np.where(m[:, 0] > 0, pattern(votes(m)), -1)
                bad = np.where(p >= 0, label_model.posterior(np.maximum(p, 0)), 1.0)
                score = own.scores(data, offsets, m) if own else 1 - bad
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.int32()), pa.array(bad), pa.array(score), pa.array((score >= 0.5) | (p == 0))], names=[*(f"c{k}" for k in range(len(names))), "pattern", "p_bad", "score", "keep"])

    out = docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields)) + ", pattern int, p_bad double, score double, keep boolean")
    return out.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), *(F.col(c).alias(c if c not in names else f"quality_{c}") for c in ("pattern", "p_bad", "score", "keep")))

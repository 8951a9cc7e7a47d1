"""Line dedup by winnowing over line hashes.

A repeated passage may begin anywhere in a line and be wrapped anew, so a line here is any run of `span` words (white space parts words), of which there is one from
each word on: a rolling hash. In each window of `least` words the least line hash - the first, if several are least - is the window's fingerprint; neighbouring windows
mostly share it, and only these minima are stored. Two texts that share a run of `least` words share that run's fingerprint, at the same place in it: that is winnowing's guarantee.

Positions are joined by fingerprint. With each fingerprint goes the hash of all the text that its windows reach over, its region. Where all regions of a fingerprint are equal, the
match extends over them to both ends, and all but the first of them are repeated. Where they differ - at the ends of repeated runs - the match is extended both ways word by word: each
window of the first region of each kind is compared by a hash of its whole content. Both together mark exactly those windows of `least` words that
occurred before: in a document with a smaller id, or earlier in the same one without overlap. What these windows cover - whole maximal runs, to the word - is deleted, with the white space after it.

A fingerprint, region or window that occurs in more than one of sampling.HOT rows is joined by broadcast, of which there are fewer than that; minima and counts are combined before they are shuffled. So a passage in a third of all
rows is no hot group. The texts are shuffled once, for both passes that need them.

Rows with one doc_id and equal text are one document and share a fate; null ids come first. Ties of id go by the text's hash. Null, empty and wordless texts stay as they are, texts of fewer than `least` words, too. Very long texts are
read slice by slice or alone. An empty table gives no rows. Extra columns are passed on; where one has the name of a result, the result is called line_<name>.
Words and windows are compared by 64-bit hashes. A repeated line of fewer than `least` words stays where no longer run around it repeats: so short a line (a heading, a salutation) is no evidence of copying.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import sampling, store
from knotwork.llm.textbytes import NONSPACE, expand, mix, span_hashes, text_slices, words

MIN_WORDS = 50
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


class Runs:
    """Hashes of runs of words, by prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power, self.inverse = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
        power[0] = self.inverse[0] = 1
        power, self.inverse = np.cumprod(power), np.cumprod(self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def span_of(least: int) -> int:
    """Words of a line: a fifth of a window, so that a text has about one fingerprint for each two fifths of one."""
    return max(1, least // 5)


def winnow(runs: Runs, n: int, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end window, place) of each fingerprint: the least line hash of these windows stands at that word. first: each text's first word (one more than texts)."""
    span = span_of(least)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - span + 1)
    lines = runs.of(at, at + span)
    best, reach, want = at, 1, least - span + 1
    while reach < want:
        step = min(reach, want - reach)
        a, b = best[: len(best) - step], best[step:]
        best, reach = np.where(lines[b] < lines[a], b, a), reach + step
    windows = np.arange(len(best))
    doc = np.searchsorted(first, windows, "right") - 1
    ok = windows + least <= first[doc + 1]
    windows, best, doc = windows[ok], best[ok], doc[ok]
    new = np.ones(len(windows), bool)
    new[1:] = (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(windows)) - 1
    return windows[begin], windows[stop] + 1 if len(begin) else windows[:0], best[begin]


def _key(docs: DataFrame, doc_id: str, text: str) -> list:
    return [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash")]


def fingerprints(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(fingerprint, region, doc_id, text_hash, start, n): n windows from word `start` on have their fingerprint in common; region stands for all that they reach over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(2)):
                starts, ends, first = words(data, offsets, NONSPACE)
                runs = Runs(span_hashes(data, starts, ends))
                begin, stop, place = winnow(runs, len(starts), first, least)
                doc = np.searchsorted(first, begin, "right") - 1
                rows = pa.array(doc + lo)
                region = mix(runs.of(begin, stop - 1 + least) + (place - begin).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.of(place, place + span_of(least)).view(np.int64)), pa.array(region.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((begin - first[doc]).astype(np.int32)), pa.array((stop - begin).astype(np.int32))],
                    names=["fingerprint", "region", "doc_id", "text_hash", "start", "n"],
                )

    given = docs.select(*_key(docs, doc_id, text), F.col(text).cast("string"))
    return given.mapInArrow(run, "fingerprint long, region long, doc_id long, text_hash long, start int, n int")


_FIRST = "min(struct(doc_id, text_hash, start)) as first"
_SAME = "doc_id <=> first.doc_id and text_hash = first.text_hash"


def _later(least: int) -> str:
    """Whether a row stands elsewhere than the first one of its kind, and doesn't overlap it."""
    return f"(not ({_SAME}) or start >= first.start + {least})"


def repeated(docs: DataFrame, texts: DataFrame, doc_id: str, text: str, least: int) -> tuple[DataFrame, list[str]]:
    """(doc_id, text_hash, start, n): windows that occurred before, n of them from each start on; and the kept tables that it reads. texts: docs' rows as dedup() shuffles them."""
    spark = docs.sparkSession
    found, found_path = store.keep(fingerprints(docs, doc_id, text, least), "fingerprints", "lz4")
    counted = found.groupBy("fingerprint").agg(F.count("*").alias("times"), F.min("region").alias("low"), F.max("region").alias("high")).where("times > 1")
    counted, counted_path = store.keep(counted.select("fingerprint", "times", (F.col("low") != F.col("high")).alias("mixed")), "counted", "lz4")
    shared, shared_path = store.keep(sampling.join_split(found, counted, ["fingerprint"], found.count(), "times"), "shared", "lz4")
    store.drop(spark, found_path, counted_path)

    # a region is its fingerprint's, so it is the key where all are equal, too
    kinds, kinds_path = store.keep(shared.groupBy("region").agg(F.count("*").alias("alike"), F.expr(_FIRST)), "regions", "lz4")
    placed, placed_path = store.keep(sampling.join_split(shared, kinds, ["region"], shared.count(), "alike"), "placed", "lz4")
    store.drop(spark, shared_path, kinds_path)
    whole = placed.where(_later(least)).select("doc_id", "text_hash", "start", "n")

    asked = placed.where(f"mixed and not {_later(least)}").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("asked"))
    opened, opened_path = store.keep(_opened(texts, asked, least), "windows", "lz4")
    again, again_path = store.keep(opened.groupBy("window").agg(F.count("*").alias("alike"), F.expr(_FIRST)).where("alike > 1"), "again", "lz4")
    single = sampling.join_split(opened, again, ["window"], opened.count(), "alike").where(_later(least)).select("doc_id", "text_hash", "start", F.lit(1).alias("n"))
    return whole.unionByName(single), [placed_path, opened_path, again_path]


def _opened(texts: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(window, doc_id, text_hash, start): each window of the regions that are asked for, by the hash of its content; each document once."""
    joined = texts.join(asked.toDF("id", "th", "asked"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
    at, key = texts.columns.index("_text"), [texts.columns.index(c) for c in ("doc_id", "text_hash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                starts, ends, first = words(data, offsets, NONSPACE)
                runs = Runs(span_hashes(data, starts, ends))
                part = batch.column(batch.num_columns - 1).slice(lo, hi - lo)
                asked = part.flatten()
                doc = np.repeat(np.arange(hi - lo), np.asarray(pc.list_value_length(part)))
                begin, n = (np.asarray(asked.field(k)).astype(np.int64) for k in (0, 1))
                start = expand(begin, n)
                doc = np.repeat(doc, n)
                window = runs.of(first[doc] + start, first[doc] + start + least)
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), *(batch.column(k).take(rows) for k in key), pa.array(start.astype(np.int32))], names=["window", "doc_id", "text_hash", "start"])

    return joined.mapInArrow(run, "window long, doc_id long, text_hash long, start int")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with text but for its repeated runs, and then n_words and n_removed (words, before and gone)."""
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    # the same rows for both passes, so Spark shuffles them once
    texts = plain.select(*(c for c in plain.columns if c != f"c{at}"), F.col(f"c{at}").cast("string").alias("_text"), *_key(plain, f"c{names.index(doc_id)}", f"c{at}"))
    found, _ = repeated(docs, texts, doc_id, text, least)
    marks = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("marks")).toDF("id", "th", "marks")
    joined = texts.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left").drop("doc_id", "text_hash", "id", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a slice at a time, and texts that stay as they are without a copy
            for lo, hi, data, offsets in text_slices(batch.column(len(names) - 1)):
                part = batch.slice(lo, hi - lo)
                texts, marked = part.column(len(names) - 1), part.column(len(names))
                starts, _, first = words(data, offsets, NONSPACE)
                gone = np.zeros(hi - lo, np.int64)
                rows = np.flatnonzero(np.asarray(marked.is_valid()))
                if len(rows):
                    keep = np.ones(len(data), bool)
                    for i in rows.tolist():
                        n = int(first[i + 1] - first[i])
                        depth = np.zeros(n + 1, np.int64)
                        begin, many = (np.asarray(marked[i].values.field(k)).astype(np.int64) for k in (0, 1))
                        np.add.at(depth, begin, 1)
                        np.add.at(depth, begin + many - 1 + least, -1)
                        drop = np.cumsum(depth)[:n] > 0
                        edges = np.append(starts[first[i] : first[i + 1]], offsets[i + 1])
                        edges[0] = offsets[i]
                        keep[offsets[i] : offsets[i + 1]] = np.repeat(~drop, np.diff(edges))
                        gone[i] = drop.sum()
                    left = np.concatenate(([0], np.cumsum(keep)))[offsets].astype(np.int32)
                    valid = texts.is_valid()
                    texts = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(left), pa.py_buffer(data[keep]))
                    texts = pc.if_else(valid, texts, pa.scalar(None, pa.string()))
                others = part.columns[: len(names) - 1]
                yield pa.RecordBatch.from_arrays([*others[:at], texts, *others[at:], pa.array(np.diff(first), pa.int64()), pa.array(gone)], names=[*(f"c{k}" for k in range(len(names))), "n_words", "n_removed"])

    fields = ", ".join(f"c{k} {'string' if k == at else f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    done = joined.mapInArrow(run, f"{fields}, n_words long, n_removed long")
    return done.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), *(F.col(c).alias(c if c not in names else f"line_{c}") for c in ("n_words", "n_removed")))

"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document, as search engines do it: each row is a segment of some MB of text with
everything needed to answer a query over its documents - sorted terms, and per term the ascending list of its positions.
A query needs no shuffle: the test windows go to the segments, and in each of them the posting lists of a
window's terms, shifted by their offsets in the window, are intersected from the rarest term on.
The test windows travel in blocks of bounded size (an item longer than a block is cut into overlapping parts), and what was found is written out after each MANY blocks, so neither side has to fit in memory and
plans don't grow with the benchmark. In a segment, windows go in steps of at most STEP candidate places.

Null or wordless texts: no words, no hits. A null doc_id is kept as such; items without id or text are none, and repeated items one. Repeated rows: each row counts for itself. Very long texts are segments of their own, whole. An empty table
gives no rows; an empty benchmark hits nothing. There are no ties: all occurrences count. Extra columns are ignored, whatever their names.
Words are compared by 64-bit hashes (two of a million different words are equal with a chance below 1e-7).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store
from knotwork.llm.textbytes import ALNUM, LOWER, expand, span_hashes, text_slices, words

WINDOW = 13
#: Words of test items that one block (a broadcast) holds at most; blocks of one plan; candidate places that are looked at at a time.
BLOCK_WORDS, MANY, STEP = 1 << 18, 16, 1 << 21
#: Stands for a null doc_id inside the index.
NO_ID = -(1 << 63)
INDEX = "doc_ids binary, word_offsets binary, terms binary, term_offsets binary, positions binary"
HITS = "segment long, place int, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<long>"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of the positional index of docs; each keeps all postings of its texts."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                data = LOWER[data]
                starts, ends, first = words(data, offsets, ALNUM)
                h = span_hashes(data, starts, ends)
                order = np.argsort(h, kind="stable")
                ranked = h[order]
                new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(h) else np.zeros(0, np.int64)
                parts = (ids[lo:hi], first.astype(np.int64), ranked[new], np.append(new, len(h)).astype(np.int32), order.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["doc_ids", "word_offsets", "terms", "term_offsets", "positions"])

    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.col(text).cast("string")).mapInArrow(segments, INDEX)


class Segment:
    """One row of the index."""

    def __init__(self, doc_ids: bytes, word_offsets: bytes, terms: bytes, term_offsets: bytes, positions: bytes):
        self.doc_ids = np.frombuffer(doc_ids, np.int64)
        self.word_offsets = np.frombuffer(word_offsets, np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.term_offsets = np.frombuffer(term_offsets, np.int32).astype(np.int64)
        self.positions = np.frombuffer(positions, np.int32).astype(np.int64)
        self.n = int(self.word_offsets[-1])
        #: (term, position) pairs in one sorted array, for membership tests
        self.pairs = np.repeat(np.arange(len(self.terms)), np.diff(self.term_offsets)) * (self.n + 1) + self.positions

    def look_up(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in this segment, -1 where it doesn't occur."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < 0, 0, np.diff(self.term_offsets)[numbers] if len(self.terms) else 0)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word_offsets, positions, "right") - 1

    def phrases(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence; numbers has a row of term numbers for each window, lengths tells how many count."""
        many = np.where(np.arange(numbers.shape[1]) < lengths[:, None], self.counts(numbers), self.n + 1).min(axis=1)
        live = np.flatnonzero(many)
        # in steps: the rarest terms' places may be far more than the words of a segment
        step = np.cumsum(many[live]) // STEP
        parts = [self._phrases(live[a:b], numbers, lengths) for a, b in zip(*(lambda c: (c[:-1], c[1:]))([*np.flatnonzero(np.diff(step, prepend=-1)).tolist(), len(live)]), strict=True) if b > a]
        return tuple(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))  # type: ignore[return-value]

    def _phrases(self, chosen: np.ndarray, every: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases() of some windows."""
        numbers, lengths = every[chosen], sizes[chosen]
        width = numbers.shape[1]
        used = np.arange(width) < lengths[:, None]
        counts = np.where(used, self.counts(numbers), np.iinfo(np.int64).max)
        live = np.flatnonzero(counts.min(axis=1) > 0)
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ranks = np.argsort(counts[live], axis=1, kind="stable")
        rarest = ranks[:, 0]
        term = numbers[live, rarest]
        many = counts[live, rarest]
        window = np.repeat(np.arange(len(live)), many)
        start = self.positions[expand(self.term_offsets[term], many)] - rarest[window]
        last = start + lengths[live][window] - 1
        ok = (start >= 0) & (last < self.n)
        ok[ok] = self.documents(start[ok]) == self.documents(last[ok])
        window, start = window[ok], start[ok]
        for k in range(1, width):
            if not len(window):
                break
            offset = ranks[window, k]
            counted = offset < lengths[live][window]
            key = numbers[live[window], offset] * (self.n + 1) + start + offset
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            ok = ~counted | (self.pairs[at] == key)
            window, start = window[ok], start[ok]
        return chosen[live[window]], start

    def near(self, numbers: np.ndarray, slop: int) -> np.ndarray:
        """Places of the first of the terms that have each of the other terms within slop words, in the same text; the rarest of the others rule out first."""
        counts = self.counts(numbers)
        if not len(numbers) or counts.min() == 0:
            return np.zeros(0, np.int64)
        spans = [self.positions[self.term_offsets[t] : self.term_offsets[t + 1]] for t in numbers]
        place = spans[0]
        for k in np.argsort(counts[1:], kind="stable") + 1:
            if numbers[k] == numbers[0]:
                continue
            doc = self.documents(place)
            low = np.maximum(place - slop, self.word_offsets[doc])
            high = np.minimum(place + slop, self.word_offsets[doc + 1] - 1)
            place = place[np.searchsorted(spans[k], low) < np.searchsorted(spans[k], high, "right")]
        return place


@dataclass
class Windows:
    """Distinct windows of a block of items: term hashes by row, lengths, and the items of window w at items[owner[w]:owner[w + 1]]."""

    terms: np.ndarray
    lengths: np.ndarray
    owner: np.ndarray
    items: np.ndarray


def windows_of(ids: list[int], texts: list[str | None], size: int = WINDOW) -> Windows | None:
    """Windows of size words of each text; of all its words, if it has fewer."""
    terms, lengths, items = [np.zeros((0, size), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi, h, first in hashed(texts):
        for i in range(hi - lo):
            w = h[first[i] : first[i + 1]]
            if not len(w):
                continue
            n = min(size, len(w))
            of = np.zeros((len(w) - n + 1, size), np.uint64)
            of[:, :n] = np.lib.stride_tricks.sliding_window_view(w, n)
            terms.append(of)
            lengths.append(np.full(len(of), n))
            items.append(np.full(len(of), ids[lo + i], np.int64))
    rows = np.column_stack([np.concatenate(terms), np.concatenate(lengths).astype(np.uint64)])
    if not len(rows):
        return None
    keys, number = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.column_stack([number.reshape(-1), np.concatenate(items)]), axis=0)
    return Windows(np.ascontiguousarray(keys[:, :size]), keys[:, size].astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1)), pairs[:, 1])


def hashed(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in text_slices(pa.array(texts, pa.string())):
        data = LOWER[data]
        starts, ends, first = words(data, offsets, ALNUM)
        yield lo, hi, span_hashes(data, starts, ends), first


def blocks(items: DataFrame, item_id: str, text: str, most: int = BLOCK_WORDS, size: int = WINDOW) -> Iterator[list[tuple[int, str]]]:
    """The items, as many at a time as have no more words (by a bound: bytes / 2 + 1) than most; an item of more comes in parts that share size - 1 words, so each window is in one of them."""
    rows, held = [], 0
    given = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    for r in given.toLocalIterator(prefetchPartitions=False):
        n = len(r.t.encode()) // 2 + 1
        parts = [r.t]
        if n > most:
            w = _WORDS.findall(r.t)
            parts = [" ".join(w[k : k + most + size - 1]) for k in range(0, max(1, len(w) - size + 1), most)]
            n = min(n, most)
        for part in parts:
            if rows and held + n > most:
                yield rows
                rows, held = [], 0
            rows.append((r.i, part))
            held += n
    if rows:
        yield rows


_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(index: DataFrame, block: list[tuple[int, str]], size: int = WINDOW, keep_all: bool = True) -> DataFrame:
    """For each document of the index: the merged spans of words that windows of the block's items cover, and these items."""
    found = windows_of([i for i, _ in block], [t for _, t in block], size)
    shared = index.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        distinct, inverse = np.unique(windows.terms, return_inverse=True) if windows else (None, None)
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(batch.column(names.index(c)) for c in ("segment", "doc_ids", "word_offsets", "terms", "term_offsets", "positions")), strict=True):
                number, *parts = (x.as_py() for x in row)
                seg = Segment(*parts)
                spans: dict[int, list] = {}
                items: dict[int, set[int]] = {}
                if windows:
                    window, start = seg.phrases(seg.look_up(distinct)[inverse].reshape(windows.terms.shape), windows.lengths)
                    depth = np.zeros(seg.n + 1, np.int64)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + windows.lengths[window], -1)
                    covered = np.concatenate(([False], np.cumsum(depth)[:-1] > 0, [False]))
                    covered_doc = seg.documents(start)
                    for d, w in set(zip(covered_doc.tolist(), window.tolist(), strict=True)):
                        items.setdefault(d, set()).update(windows.items[windows.owner[w] : windows.owner[w + 1]].tolist())
                    for d in items:
                        base, stop = int(seg.word_offsets[d]), int(seg.word_offsets[d + 1])
                        inside = np.concatenate(([False], covered[base + 1 : stop + 1], [False])).astype(np.int8)
                        step = np.diff(inside)
                        spans[d] = [{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                places = range(len(seg.doc_ids)) if keep_all else sorted(items)
                counts = np.diff(seg.word_offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(places), pa.int64()), pa.array(places, pa.int32()), pa.array(seg.doc_ids[list(places)], pa.int64()), pa.array(counts[list(places)], pa.int64()),
                        pa.array([spans.get(d, []) for d in places], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([sorted(items.get(d, ())) for d in places], pa.list_(pa.int64())),
                    ],
                    names=["segment", "place", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, HITS)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs: doc_id, n_words, the merged spans of words hit by windows of items, and the items (sorted, distinct).

    The index is stored once in the shared folder and searched with one block of items after the other.
    """
    index, _ = store.keep(build_index(docs, doc_id, text), "postings")
    index = index.withColumn("segment", F.monotonically_increasing_id())
    parts: list[DataFrame] = []

    def joined() -> DataFrame:
        done = parts[0]
        for p in parts[1:]:
            done = done.unionByName(p)
        return done

    for k, block in enumerate(blocks(items, item_id, item_text, block_words, size)):
        if len(parts) == MANY:  # write what was found so far, or the plan grows with the benchmark
            parts[:] = [store.keep(joined(), "found")[0]]
        parts.append(search(index, block, size, keep_all=k == 0))
    if len(parts) < 2:
        return (parts or [search(index, [], size)])[0].select("doc_id", "n_words", "spans", "items")
    union = joined()
    merged = """aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:bigint,stop:bigint>>), (a, s) ->
        case when size(a) > 0 and element_at(a, -1).stop >= s.start
        then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, s.stop))))
        else concat(a, array(s)) end)"""
    return union.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.expr(merged).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select("doc_id", "n_words", "spans", "items")


def digest(hits: DataFrame, least: int = 20) -> DataFrame:
    """n_hit, n_items, a digest of the items, and whether 1 of each `least` words or more is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        F.expr(f"nullif(doc_id, {NO_ID + 1} - 1)").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 and {least} * n_hit >= n_words"))


def excise(docs: DataFrame, hits: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the words that hits (doc_id, n_words, spans, as contamination() gives them) names, and without what stands between these words.

    A text's hits are told by its id and number of words. Texts without hits, null texts and other columns stay as they are.
    """
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    marks = hits.where("size(spans) > 0").groupBy("doc_id").agg(F.collect_set(F.struct("n_words", "spans")).alias("marks")).withColumnRenamed("doc_id", "id")
    joined = plain.join(marks, F.col(f"c{names.index(doc_id)}").cast("long") == F.col("id"), "left").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(len(names))
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(at)
                rows = np.flatnonzero(np.asarray(marked.slice(lo, hi - lo).is_valid()))
                if len(rows):
                    starts, ends, first = words(LOWER[data], offsets, ALNUM)
                    out = texts.to_pylist()
                    for i in rows.tolist():
                        n = int(first[i + 1] - first[i])
                        keep = np.ones(int(offsets[i + 1] - offsets[i]), bool)
                        for m in marked[lo + i].as_py():
                            for span in m["spans"] if m["n_words"] == n else ():
                                a, b = first[i] + span["start"], first[i] + span["stop"] - 1
                                keep[starts[a] - offsets[i] : ends[b] - offsets[i]] = False
                        if out[i] is not None:
                            out[i] = data[offsets[i] : offsets[i + 1]][keep].tobytes().decode()
                    texts = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], texts, *part.columns[at + 1 : len(names)]], names=[f"c{k}" for k in range(len(names))])

    fields = ", ".join(f"c{k} {'string' if k == at else f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return joined.mapInArrow(run, fields).toDF(*names)


def find_phrases(index: DataFrame, phrases: list[str], slop: int | None = None) -> DataFrame:
    """(doc_id, phrase number, word position) of each exact match, or, with slop, of each place of the phrase's first word with all its other words within slop words.

    phrases is a stated query set, of bounded size; a phrase without words matches nothing.
    """
    asked = [h[f[i] : f[i + 1]] for lo, hi, h, f in hashed(phrases) for i in range(hi - lo)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.names.index(c)) for c in ("doc_ids", "word_offsets", "terms", "term_offsets", "positions")), strict=True):
                seg = Segment(*(x.as_py() for x in row))
                for k, terms in enumerate(asked):
                    if not len(terms):
                        continue
                    numbers = seg.look_up(terms)
                    at = seg.phrases(numbers[None, :], np.array([len(terms)]))[1] if slop is None else seg.near(numbers, slop)
                    d = seg.documents(at)
                    yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids[d]), pa.array([k] * len(at), pa.int32()), pa.array(at - seg.word_offsets[d], pa.int64())], names=["doc_id", "phrase", "position"])

    return index.mapInArrow(run, "doc_id long, phrase int, position long")

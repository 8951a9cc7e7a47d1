"""Approximate nearest neighbours with a permutation index.

A vector is represented by its LENGTH nearest of PIVOTS pivots in order. Each segment of some thousand vectors posts its vectors in
the inverted files of their pivots, with the pivot's place in the vector's order. A query reads only the files of its own pivots - an eighth of all postings -
and ranks a segment's vectors by the truncated footrule distance of the two orders (a pivot missing from one of them stands
at the place after the last); the best share of each segment is ranked anew by the exact distance. How large a share it takes is measured: for a bounded sample of vectors as queries, against all rows,
each true neighbour's place in its segment's footrule ranking is found, and the share takes in WANTED of these places. So it is small where vectors have structure, and as large as recall needs where they have none;
segments of any size are treated alike. Queries go to the segments in blocks of bounded size.

Only the pivots and the share are fitted on samples (bounded numbers of distinct vectors, least hashes first); every vector is indexed.
Vectors that are null, zero or hold null or non-finite components take no part, as queries or as candidates, nor do null ids. Vectors of several dimensions are as many tables: a query meets those of its own. Rows that repeat an id are candidates each, and queries each;
only the query's own row - one of those with its id and its very vector - isn't its neighbour. Equal distances rank by id. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm import sampling, store
from knotwork.llm.textbytes import expand

PIVOTS, LENGTH = 512, 64
#: Vectors of a segment at most; the least number and share of a segment's vectors that are ranked exactly.
SEGMENT, LEAST, FLOOR = 4096, 32, 0.005
#: The sample of queries that the share is measured with, the part of their neighbours that it must take in, and what it is widened by.
SAMPLE, WANTED, WIDER = 64, 0.98, 1.2
#: Queries of a block at most; blocks of one plan.
BLOCK, MANY = 2048, 16


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part; v is array<double>."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return v.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def spread(vectors: DataFrame, most: int, seed: int = 3) -> np.ndarray:
    """Up to `most` distinct vectors, least hashes first; equal vectors hash alike and meet only after each task has made them distinct."""
    h = F.xxhash64("v", F.lit(seed))
    rows = vectors.select("v").where(h <= F.lit(sampling.bound(16 * most, vectors.count()))).distinct().orderBy(h, "v").limit(most).collect()
    return np.array([r.v for r in rows]) if rows else np.zeros((0, 0))


def orders(v: np.ndarray, points: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the `length` nearest pivots of each row, nearest first, ties to the smaller number."""
    far = (v * v).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * v @ points.T
    return np.argsort(far, axis=1, kind="stable")[:, : min(length, len(points))]


def build_index(vectors: DataFrame, points: np.ndarray, length: int = LENGTH, segment: int = SEGMENT) -> DataFrame:
    """Segments of vectors, all of the pivots' dimension: ids, vectors, and the inverted file of each pivot (offsets; members; the pivot's places), as binary columns."""
    dim = points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), segment):
                part = batch.slice(at, segment)
                v = np.asarray(part.column(1).flatten()).reshape(len(part), dim)
                order = orders(v, points, length)
                flat = order.ravel()
                by_pivot = np.argsort(flat, kind="stable")
                offsets = np.searchsorted(flat[by_pivot], np.arange(len(points) + 1)).astype(np.int32)
                members = (by_pivot // order.shape[1]).astype(np.int32)
                places = (by_pivot % order.shape[1]).astype(np.int32)
                parts = (part.column(0).to_numpy(), v, offsets, members, places)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], names=["ids", "vectors", "offsets", "members", "places"])

    return vectors.select("id", "v").mapInArrow(run, "ids binary, vectors binary, offsets binary, members binary, places binary")


class Segment:
    """One row of the index."""

    def __init__(self, row: list[bytes], dim: int, length: int):
        self.ids, self.vectors = np.frombuffer(row[0], np.int64), np.frombuffer(row[1]).reshape(-1, dim)
        self.offsets, self.members, self.places = (np.frombuffer(x, np.int32) for x in row[2:])
        self.length = length

    def saved(self, order: np.ndarray) -> np.ndarray:
        """By how much each vector's footrule distance to an order of pivots is less than that of one without a common pivot, from the files of the order's pivots alone."""
        first = self.offsets[order].astype(np.int64)
        many = self.offsets[order + 1] - first
        at = expand(first, many)
        place, other = np.repeat(np.arange(len(order)), many), self.places[at]
        gain = 2 * self.length - place - other - np.abs(place - other)
        return np.bincount(self.members[at], weights=gain, minlength=len(self.ids))

    def distances(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        gap = self.vectors[at] - q
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _segments(batch: pa.RecordBatch, dim: int, length: int) -> Iterator[Segment]:
    for row in zip(*(batch.column(c) for c in range(5)), strict=True):
        yield Segment([x.as_py() for x in row], dim, length)


def measured_share(index: DataFrame, sample: np.ndarray, points: np.ndarray, k: int, length: int, wanted: float = WANTED) -> float:
    """The share of each segment that takes in `wanted` of the sample's true neighbours; by exact distances of the sample (a stated number of vectors) to all rows."""
    dim = points.shape[1]
    shared = index.sparkSession.sparkContext.broadcast((sample, orders(sample, points, length)))
    depth = min(length, len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, order = shared.value
        for batch in batches:
            for seg in _segments(batch, dim, depth):
                for i in range(len(q)):
                    far = seg.distances(np.arange(len(seg.ids)), q[i])
                    far[far == 0] = np.inf  # the vector itself
                    best = np.argsort(far, kind="stable")[:k]
                    best = best[np.isfinite(far[best])]
                    saved = seg.saved(order[i])
                    before = np.array([(saved > saved[b]).sum() + 1 for b in best]) / len(saved)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(far[best]), pa.array(before, pa.float64())], names=["q", "far", "place"])

    found = index.mapInArrow(run, "q long, far double, place double")
    near = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("far", "place"))).where(f"n <= {k}").select("place").toPandas().place.to_numpy()
    return float(min(1.0, max(FLOOR, WIDER * np.quantile(near, wanted)))) if len(near) else 1.0


def search(index: DataFrame, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, points: np.ndarray, k: int, length: int, share: float, least: int = LEAST) -> DataFrame:
    """(q, query_id, vec_id, score, same): the k + 1 nearest that are found in each segment for one block of queries; same: a row with the query's id and vector."""
    shared = index.sparkSession.sparkContext.broadcast((numbers, ids, queries, orders(queries, points, length)))
    dim, depth = points.shape[1], min(length, len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, q, order = shared.value
        for batch in batches:
            for seg in _segments(batch, dim, depth):
                n = len(seg.ids)
                take = min(n, max(least, k + 1, int(np.ceil(share * n))))
                out: list[tuple[np.ndarray, ...]] = []
                for i in range(len(q)):
                    best = np.argpartition(-seg.saved(order[i]), take - 1)[:take] if take < n else np.arange(n)
                    score = seg.distances(best, q[i])
                    first = np.lexsort((seg.ids[best], score))[: k + 1]
                    at = best[first]
                    same = (seg.ids[at] == own[i]) & (seg.vectors[at] == q[i]).all(axis=1)
                    out.append((np.full(len(at), number[i]), np.full(len(at), own[i]), seg.ids[at], score[first], same))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(5)], names=["q", "query_id", "vec_id", "score", "same"])

    return index.mapInArrow(run, "q long, query_id long, vec_id long, score double, same boolean")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", length: int = LENGTH, most: int = PIVOTS, segment: int = SEGMENT, least: int = LEAST, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors by Euclidean distance, found for each row of queries (same columns), with the measured share unless one is given; a query isn't its own neighbour."""
    spark = vectors.sparkSession
    own, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in sorted(r[0] for r in asked.select(F.size("v")).distinct().collect()):
        of = F.size("v") == dim
        found = _neighbours(own.where(of), asked.where(of), k, length, most, segment, least, share)
        out = out.unionByName(found) if found is not None else out
    return out


def _neighbours(own: DataFrame, asked: DataFrame, k: int, length: int, most: int, segment: int, least: int, share: float | None) -> DataFrame | None:
    """neighbours() for vectors of one dimension."""
    points = spread(own, most)
    if not len(points):
        return None
    index, _ = store.keep(build_index(own, points, length, segment), "permutations", "lz4")
    part = measured_share(index, spread(own, SAMPLE, 4), points, k, length) if share is None else share
    found: list[DataFrame] = []
    rows: list = []
    count = 0

    def joined() -> DataFrame:
        done = found[0]
        for f in found[1:]:
            done = done.unionByName(f)
        return done

    def block() -> None:
        nonlocal count
        if len(found) == MANY:  # so many queries: write what was found so far, or the plan grows with them
            found[:] = [store.keep(joined(), "found")[0]]
        found.append(search(index, np.arange(count, count + len(rows)), np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows]), points, k, length, part, least))
        count += len(rows)
        rows.clear()

    for r in asked.toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            block()
    if rows:
        block()
    if not found:
        return None
    # of the rows that have the query's id and vector, one is the query's own
    others = joined().withColumn("n", F.row_number().over(W.partitionBy("q", "same").orderBy("score", "vec_id"))).where(f"n <= {k} + 1 and not (same and n = 1)")
    ranked = others.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", F.col("rank").cast("int"), "vec_id", "score")

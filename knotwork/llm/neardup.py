"""Near-duplicates by a chosen-path set similarity join (Christiani, Pagh; CPSJoin with Sivertsen).

Documents with equal shingle sets are one class from the start, so copies cost nothing further. Each class is
represented by minwise tokens. A number of independent trees branch the classes: the root of a tree sends a class to the child named by
one of its tokens; a node that is still large chooses some coordinates of its own and sends each class on to the children
named by the tokens there. Nodes that have become small are compared exhaustively by sketches, and
what may be similar enough is confirmed on the full shingle sets. No node's size is a limit.

A pair at the threshold s is missed by one tree with a chance of 1 - s at most where nodes are small after the root
(0.2 at 0.8), so by 12 trees with 4e-9, plus about 1e-6 for the sketch; pairs that are split further still have each level's 1 - (1 - s)**branches.

In large nodes only a spanning set of pairs is confirmed first; then the pairs between what is not yet connected. So all components are as if all pairs had been linked.
Pairs are confirmed on both texts' whole sets, of 64-bit shingle hashes; a class with more than HUB partners meets them in groups of about HUB, so no task has all pairs of a hub. A node that is still large at the
greatest depth - more than LEAF different sets that all agree in seven tokens - is first linked by random blocks that share a leader, and compared block against block only if that leaves it more than one component; this alone is quadratic in the node.

Null or wordless texts have an empty set and link with nothing. A null doc_id links with nothing and is kept. Rows that
repeat a doc_id count each by their own text. Ties don't matter: the smallest doc_id stands for a group. Very long texts are compared whole. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm import sampling, store
from knotwork.llm.components import components
from knotwork.llm.textbytes import LOWER, NONSPACE, gram_hashes, mix, span_hashes, text_slices, words

TOKENS, TREES, BRANCHES, DEPTH = 64, 12, 2, 6
LEAF = 1024
#: Nodes up to this size give all their candidate pairs at once.
SMALL = 16
#: Candidate pairs of nodes that leave a task together.
PAIRS = 1 << 17
#: Partners of a class that its text is sent to at a time.
HUB = 64
#: Of TOKENS, as many must agree for a pair to be confirmed; for a similarity of 0.8 fewer do with a chance of 1e-6.
AGREE = 34

_rng = np.random.default_rng(4)
_MUL = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64)
_SIDE = np.uint64(0xD6E8FEB86659FD93)


def agreement(similarity: float) -> int:
    """How many of the tokens must agree: 4.9 standard deviations below what is expected at this similarity."""
    return max(1, int(TOKENS * similarity - 4.9 * (TOKENS * similarity * (1 - similarity)) ** 0.5) - 1) if similarity != 0.8 else AGREE


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, where each row's begin) for slices: per row its distinct shingles of n words, sorted."""
    for lo, hi, data, offsets in text_slices(texts):
        data = LOWER[data]
        starts, ends, first = words(data, offsets, NONSPACE)
        grams, begin = gram_hashes(span_hashes(data, starts, ends), first, n)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            grams[a:b].sort()
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        new[begin[:-1][np.diff(begin) > 0]] = True
        yield lo, hi, grams[new], np.concatenate(([0], np.cumsum(new)))[begin]


def sketches(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, tokens): h1 and h2 stand for the set, tokens are its minwise tokens (32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams, begin in shingle_sets(batch.column(1), n):
                sizes = np.diff(begin)
                full = np.flatnonzero(sizes)
                h = np.zeros((2, hi - lo), np.uint64)
                tokens = np.zeros((hi - lo, TOKENS), np.uint32)
                if len(full):
                    at = begin[:-1][full]
                    h[0, full] = np.add.reduceat(mix(grams ^ _SIDE), at)
                    h[1, full] = np.add.reduceat(mix(grams + _SIDE), at)
                    for k in range(TOKENS):
                        tokens[full, k] = np.minimum.reduceat((((grams + _ADD[k]) * _MUL[k]) >> np.uint64(32)).astype(np.uint32), at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), fixed(tokens)],
                    names=["doc_id", "n_shingles", "h1", "h2", "tokens"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, tokens binary")


def fixed(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, len(rows) * width + 1, width or 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(tokens: pa.Array) -> np.ndarray:
    """The inverse of fixed(), for tokens."""
    if not len(tokens):
        return np.zeros((0, TOKENS), np.uint32)
    offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1 + tokens.offset)[tokens.offset :]
    return np.frombuffer(tokens.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32).reshape(-1, TOKENS)


def _roots(trees: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = matrix(batch.column(1))
            nodes = np.stack([mix(tokens[:, t].astype(np.uint64) + (np.uint64(t + 1) << np.uint64(40))) for t in range(trees)], axis=1)
            reps = np.repeat(batch.column(0).to_numpy(), trees)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(reps)], names=["node", "rep"])

    return run


def _branch(trees: int) -> Callable:
    """Each node chooses BRANCHES coordinates, other than the roots', by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            tokens = matrix(batch.column(2))
            base = (mix(node) % np.uint64(TOKENS - trees)).astype(np.int64)
            for k in range(BRANCHES):
                coordinate = trees + (base + k * 7) % (TOKENS - trees)
                child = mix(mix(node + np.uint64(k + 1)) ^ mix(tokens[np.arange(len(node)), coordinate].astype(np.uint64) + np.uint64(k)))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1)], names=["node", "rep"])

    return run


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens agree for each row of a and each row of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(TOKENS):
        out += a[:, k, None] == b[None, :, k]
    return out


def _compare(similarity: float, spanning: bool) -> Callable:
    """Candidate pairs of each node; rows (node, rep, n_shingles, comp, tokens) come sorted by node, and pairs leave PAIRS at a time, so memory hangs on one node alone. spanning: large nodes give a star around each of their densest members; else they give all pairs whose components differ."""
    agree = agreement(similarity)

    def near_of(rep: np.ndarray, size: np.ndarray, same: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        low, high = np.minimum(size[rows, None], size[None, :]), np.maximum(size[rows, None], size[None, :])
        return (same >= agree) & (low >= similarity * high - 1e-6) & (rep[rows, None] != rep[None, :])

    def pairs_of(rep: np.ndarray, size: np.ndarray, comp: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(rep)
        if not spanning or m <= SMALL:
            # the largest component has no pairs of its own to find
            _, which, counts = np.unique(comp, return_inverse=True, return_counts=True)
            rest = which != counts.argmax()
            rows = np.flatnonzero(rest)
            near = near_of(rep, size, _agreeing(tokens[rows], tokens), rows) & (comp[rows, None] != comp[None, :])
            a, b = np.nonzero(near)
            a = rows[a]
            once = ~rest[b] | (a < b)
            return rep[a[once]], rep[b[once]]
        same = _agreeing(tokens, tokens)
        near = near_of(rep, size, same, slice(None))
        degree = near.sum(axis=1)
        free, out_a, out_b = degree > 0, [], []
        for v in np.argsort(-degree, kind="stable"):
            if not free[v]:
                continue
            others = np.flatnonzero(near[v] & free)
            if not len(others):
                others = np.array([np.argmax(np.where(near[v], same[v], 0))])
            free[v] = False
            free[others] = False
            out_a.append(np.full(len(others), rep[v]))
            out_b.append(rep[others])
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (rep[:0], rep[:0])

    def of_nodes(rep: np.ndarray, size: np.ndarray, comp: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        counts = np.diff(offsets)
        two = offsets[:-1][counts == 2]
        if len(two):
            ok = ((tokens[two] == tokens[two + 1]).sum(axis=1) >= agree) & (np.minimum(size[two], size[two + 1]) >= similarity * np.maximum(size[two], size[two + 1]) - 1e-6) & (comp[two] != comp[two + 1])
            yield rep[two[ok]], rep[two[ok] + 1]
        for g in np.flatnonzero(counts > 2):
            s = slice(offsets[g], offsets[g + 1])
            yield pairs_of(rep[s], size[s], comp[s], tokens[s])

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Columns and where nodes begin; a node whose rows go on in the next batch waits for it."""
        held = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(k).to_numpy() for k in range(4)] + [matrix(batch.column(4))]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            begin = np.concatenate(([0], np.flatnonzero(np.diff(cols[0])) + 1))
            held = [x[begin[-1] :].copy() for x in cols]
            if len(begin) > 1:
                yield [x[: begin[-1]] for x in cols[1:]], begin
        if held is not None:
            yield held[1:], np.array([0, len(held[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, offsets in whole_nodes(batches):
            out, n = [], 0
            for found in of_nodes(*cols, offsets):
                out.append(found)
                n += len(found[0])
                if n >= PAIRS:
                    yield batch_of(out)
                    out, n = [], 0
            if n:
                yield batch_of(out)

    return run


def _confirm(n: int, percent: int) -> Callable:
    """Pairs whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, min(len(batch), 256))
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                sets = [[g[b[i] : b[i + 1]] for lo, hi, g, b in shingle_sets(part.column(k), n) for i in range(hi - lo)] for k in (2, 3)]
                keep = np.zeros(len(part), bool)
                for i, (x, y) in enumerate(zip(*sets, strict=True)):
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = common > 0 and 100 * common >= percent * (len(both) - common)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is that one).

    Rows link if the sets of their n-word shingles (white space parts words, A-Z lower-cased; all words if fewer) have a Jaccard similarity of percent / 100 or more.
    """
    spark = docs.sparkSession
    similarity = percent / 100
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known, known_path = store.keep(sketches(docs, doc_id, text, n), "sketches", "lz4")
    key = ["n_shingles", "h1", "h2"]
    classes, class_path = store.keep(known.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("tokens").alias("tokens"), F.count("*").alias("copies")), "classes", "lz4")
    # copies of one text may be a third of all rows; what has no class isn't joined at all
    held = sampling.join_split(known.where("n_shingles > 0 and doc_id is not null").select("doc_id", *key), classes.select(*key, "rep", "copies"), key, known.count(), "copies")
    bare = known.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))
    members, _ = store.keep(held.select("doc_id", "n_shingles", "rep").unionByName(bare), "members")
    store.drop(spark, known_path)
    by_rep = classes.select("rep", "n_shingles", "tokens")

    # Branch until nodes are small; what stays large at the last level goes on as pairs of blocks.
    nodes = classes.select("rep", "tokens").mapInArrow(_roots(trees), "node long, rep long")
    levels, paths, deep = [], [], None
    for level in range(depth):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
        shared, path = store.keep(nodes.join(sizes, "node"), "nodes", "lz4")
        paths.append(path)
        levels.append(shared.where(f"members <= {leaf}"))
        large = shared.where(f"members > {leaf}")
        if not large.limit(1).count():
            break
        nodes = large.select("node", "rep").join(classes.select("rep", "tokens"), "rep").select("node", "rep", "tokens").mapInArrow(_branch(trees), "node long, rep long")
    else:
        # first random blocks, in each of which stands the node's leader, so blocks of one cluster are connected through it
        half = max(1, leaf // 2)
        deep = large.withColumn("of", F.ceil(F.col("members") / half)).withColumn("own", F.expr("pmod(xxhash64(rep), of)"))
        lead = deep.groupBy("node").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "own", "of")).alias("first")).select("node", "first.*")
        others = lead.withColumn("block", F.explode(F.expr("filter(sequence(0, of - 1), k -> k <> own)"))).select(F.xxhash64("node", "block").alias("node"), "rep")
        levels.append(deep.select(F.xxhash64("node", "own").alias("node"), "rep").unionByName(others).withColumn("members", F.lit(0).cast("long")))
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)

    def compared(chosen: DataFrame, labels: DataFrame | None) -> DataFrame:
        at = by_rep if labels is None else by_rep.join(labels.toDF("rep", "comp"), "rep", "left")
        full = chosen.select("node", "rep").join(at.select("rep", "n_shingles", (F.col("rep") if labels is None else F.coalesce("comp", "rep")).alias("comp"), "tokens"), "rep")
        sorted_ = full.select("node", "rep", "n_shingles", "comp", "tokens").repartition("node").sortWithinPartitions("node")
        return sorted_.mapInArrow(_compare(similarity, labels is None), "a long, b long").distinct()

    def confirmed(found: DataFrame) -> tuple[DataFrame, str]:
        pairs, pairs_path = store.keep(found, "pairs", "lz4")
        groups = pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / HUB).alias("groups"))
        groups, groups_path = store.keep(groups.where("groups > 1"), "hubs", "lz4")
        of_hubs = sampling.join_split(pairs, groups, ["a"], pairs.count(), "n").select("a", "b", F.expr("pmod(xxhash64(b), groups)").alias("part"))
        others = pairs.join(groups, "a", "left_anti") if groups.limit(1).count() else pairs
        split = of_hubs.unionByName(others.select("a", "b", F.lit(0).cast("long").alias("part")))
        sides = split.select("a", "part").distinct().join(texts.toDF("a", "text_a"), "a")
        both = split.join(texts.toDF("b", "text_b"), "b").join(sides, ["a", "part"]).select("a", "b", "text_a", "text_b")
        links, path = store.keep(both.mapInArrow(_confirm(n, percent), "a long, b long").distinct(), "links")
        store.drop(spark, pairs_path, groups_path)
        return links, path

    links, links_path = confirmed(compared(rows, None))
    labels = components(links)
    again = rows.where(f"members > {SMALL}").select("node", "rep")
    if deep is not None:
        # block against block only in nodes that aren't one component by now, and there all but the largest component with all
        named = deep.join(labels.toDF("rep", "comp"), "rep", "left").select("node", "rep", F.coalesce("comp", "rep").alias("comp"))
        counts = named.groupBy("node", "comp").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"))
        torn = counts.where("all > most.n").select("node", F.col("most.comp").alias("main"), F.ceil(F.col("most.n") / half).alias("mains"), F.ceil((F.col("all") - F.col("most.n")) / half).alias("rests"))
        sides = named.join(torn, "node").withColumn("inside", F.expr("comp = main")).withColumn("own", F.expr("pmod(xxhash64(rep), if(inside, mains, rests))"))
        across = sides.withColumn("other", F.explode(F.expr("sequence(0, if(inside, rests, mains) - 1)")))
        again = again.unionByName(across.select(F.expr("xxhash64(node, if(inside, own, other), if(inside, other, own), 1)").alias("node"), "rep"))
        among = sides.where("not inside and rests > 1").withColumn("other", F.explode(F.expr("sequence(0, rests - 1)"))).where("other <> own")
        again = again.unionByName(among.select(F.expr("xxhash64(node, least(own, other), greatest(own, other), 0)").alias("node"), "rep"))
    if again.limit(1).count():
        more, more_path = confirmed(compared(again, labels))
        if more.limit(1).count():
            labels = components(links.union(more))
        store.drop(spark, more_path)
    store.drop(spark, links_path, class_path)
    store.drop(spark, *paths)
    out = members.join(labels.toDF("rep", "component"), "rep", "left").select("doc_id", "n_shingles", F.expr("if(doc_id is null, null, coalesce(component, rep, doc_id))").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))

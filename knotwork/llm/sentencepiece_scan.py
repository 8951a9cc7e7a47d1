"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

Documents of up to GIANT characters are encoded whole by the library. A giant document is cut into chunks of CHUNK characters, which are encoded apart: those of up to FAN chunks one after the other where the document is, those
of larger documents spread over the cluster.
The state at a border is the piece that covers the character before it - how far it reaches back and over. For each state at a chunk's start, a forward pass gives
the best score of reaching each state at its end: a transfer matrix over (max, +). Matrices are combined associatively, FAN neighbours at a time in a tree, so no task has more than FAN of them however long
the text; the best way through the borders is read off from the tree's top down, and each chunk traces its pieces back from its two states, independently of the others.

For a unigram model a piece weighs its score. For a merge model (BPE), a piece after another weighs 0 if merging the two
together would leave exactly these two pieces, and minus infinity otherwise: merging is local, so a sequence whose neighbours all agree is
the one that merging the whole text gives. So both kinds give what the library gives. Where no piece of the model goes on over the beginning of a word (a word-begin mark after
another character), all states are alike there, so a pass goes from a chunk's first whole word to its last at once, with the words' own scores (all 0 in a merge model) and pieces, which are remembered.

Null texts have null ids; an empty text has none, and both have a row. Repeated rows are encoded each. Ties of scores go to the later start of the last piece. An empty table gives no rows. Only the text and what
the caller names are read, so other columns may have any names; a named column called ids, n_tokens or round_trip stands beside the result of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm import store

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of more characters are giant; CHUNK must exceed the longest piece; matrices that are combined at a time.
GIANT, CHUNK, FAN = 1 << 14, 1 << 12, 64
#: Pairs and words that a worker remembers at most.
REMEMBER = 200_000
_WORD = "\u2581"
_WORDS = re.compile(f"{_WORD}+[^{_WORD}]*")
_NEVER = float("-inf")


class Model:
    """A SentencePiece model file: pieces, scores, and how two pieces may follow each other."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {}
        self.score = {}
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)):
                p = self.sp.id_to_piece(i)
                self.ids[p], self.score[p] = i, self.sp.get_score(i)
        self.longest = max(map(len, self.ids))
        #: what some piece begins with
        self.beginnings = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.merges = self._is_merge_model()
        self.unknown = min(self.score.values()) - 10
        #: whether no piece goes on over a word's beginning
        self.by_word = all(_WORD not in p.lstrip(_WORD) for p in self.ids)
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._words: dict[str, tuple[float, list[str]]] = {}

    def _is_merge_model(self) -> bool:
        """trainer_spec.model_type of the model's protocol buffer: 2 is BPE; unigram is the default."""
        data = self.sp.serialized_model_proto()

        def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
            at = 0

            def number() -> int:
                nonlocal at
                n = shift = 0
                while True:
                    n |= (b[at] & 127) << shift
                    shift += 7
                    at += 1
                    if b[at - 1] < 128:
                        return n

            while at < len(b):
                key = number()
                if key & 7 == 0:
                    yield key >> 3, number()
                else:
                    size = {1: 8, 5: 4}.get(key & 7) or number()
                    yield key >> 3, b[at : at + size]
                    at += size

        for field, value in fields(data):
            if field == 2 and isinstance(value, bytes):
                return any(f == 3 and v == 2 for f, v in fields(value))
        return False

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: again and again the leftmost of the best-scored neighbours becomes one piece."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > _NEVER:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], _NEVER)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], _NEVER)
        return parts

    def is_whole(self, piece: str) -> bool:
        """Whether a piece is what merging its own characters gives."""
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return known

    def fits(self, before: str, piece: str) -> bool:
        known = self._fits.get((before, piece))
        if known is None:
            if len(self._fits) > REMEMBER:
                self._fits.clear()
            known = self._fits[before, piece] = self.merged(before + piece) == [before, piece]
        return known

    def weight(self, before: str | None, piece: str) -> float:
        if self.merges:
            return 0.0 if before is None or self.fits(before, piece) else _NEVER
        return self.score.get(piece, self.unknown)

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that may start at this place; a single character always may."""
        out = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            p = text[at : at + n]
            if p not in self.beginnings:
                break
            if p in self.ids and (not self.merges or self.is_whole(p)):
                out.append(p)
        return out

    def word(self, word: str) -> tuple[float, list[str]]:
        """The best score of a word from its beginning to its end, and its pieces."""
        known = self._words.get(word)
        if known is None:
            if self.merges:
                known = 0.0, self.merged(word)
            else:
                best: list[tuple[float, str]] = [(0.0, "")] + [(_NEVER, "")] * len(word)
                for i in range(len(word)):
                    for p in self.starting(word, i):
                        s = best[i][0] + self.weight(None, p)
                        if s > best[i + len(p)][0]:
                            best[i + len(p)] = s, p
                at, pieces = len(word), []
                while at:
                    pieces.append(best[at][1])
                    at -= len(best[at][1])
                known = best[-1][0], pieces[::-1]
            if len(self._words) > REMEMBER:
                self._words.clear()
            self._words[word] = known
        return known

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
                continue
            for ch in p:
                fallback = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in ch.encode()]
                out.extend(fallback if all(self.sp.is_byte(i) for i in fallback) else [self.sp.unk_id()])
        return out

    def normalised(self, text: str) -> str:
        """The text as pieces spell it."""
        return self.sp.normalize(text)


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


#: A state: (start, end) of the piece that covers the character before a border, in characters of the whole text.
State = tuple[int, int]


def states_at(model: Model, text: str, border: int, base: int = 0) -> list[State]:
    """The states that are possible at a border; text begins at character base of the whole."""
    out = []
    for a in range(max(base, border - model.longest), border):
        out.extend((a, a + len(p)) for p in model.starting(text, a - base) if a + len(p) >= border)
    return out


#: (end, piece): score, and the piece before; or, after whole words, where the first of them begins.
Reach = dict[int, dict[str, tuple[float, "str | int | None"]]]


def _last_word(text: str, end: int) -> int:
    """Where the word begins that ends here."""
    at = text.rfind(_WORD, 0, end)
    while at > 0 and text[at - 1] == _WORD:
        at -= 1
    return at


def forward(model: Model, text: str, base: int, entry: State | None, stop: int, against: Reach | None = None) -> tuple[Reach, float | None]:
    """From an entry state, the reachable (end, piece) with score and what came before, for pieces that start before stop.

    against: another entry's result; where the two are alike from some place on but for a constant, the pass ends, and that difference of scores is given, too.
    """
    reach: Reach = {}
    i = base if entry is None else entry[1]
    reach[i] = {"" if entry is None else text[entry[0] - base : entry[1] - base]: (0.0, None)}
    begin, far, alike, gap, size = i, i, 0, None, len(text)
    while i < stop and i <= far:  # far: what is reached at all; some entries lead nowhere
        here = reach.get(i)
        if against is not None and i > begin:
            there = against.get(i)
            if here and there and here.keys() == there.keys():
                d = {here[p][0] - there[p][0] for p in here}
                alike = alike + 1 if len(d) == 1 and d == {gap} else 0
                gap = d.pop() if len(d) == 1 else None
            elif here or there:
                alike, gap = 0, None
            else:
                alike += 1 if gap is not None else 0
            if alike > model.longest:
                return reach, gap
        if not here:
            i += 1
            continue
        at = i - base
        if model.by_word and text[at] == _WORD and (at == 0 or text[at - 1] != _WORD) and (at > 0 or base == 0):
            # a word's beginning: the states here differ by their scores alone
            last = max(here, key=lambda x: here[x][0])
            if against is not None and i > begin and against.get(i):
                return reach, here[last][0] - max(v for v, _ in against[i].values())
            # the last word that begins at the border or before it, and whose beginning is known; what is between is whole words
            end = text.rfind(_WORD, at, min(stop - base, size - 1) + 1)
            while end > at and text[end - 1] == _WORD:
                end -= 1
            if end > at:
                score = sum(model.word(w)[0] for w in _WORDS.findall(text, at, end)) if not model.merges else 0.0
                reach[i] = {last: here[last]}
                reach[base + end] = {model.word(text[_last_word(text, end) : end])[1][-1]: (here[last][0] + score, i)}
                i = far = base + end
                continue
        for p in model.starting(text, at):
            best, came = _NEVER, None
            for before, (score, _) in here.items():
                w = model.weight(before or None, p)
                if score + w > best:
                    best, came = score + w, before
            if best > _NEVER:
                far = max(far, i + len(p))
                end = reach.setdefault(i + len(p), {})
                if p not in end or best > end[p][0]:
                    end[p] = (best, came)
        if not model.merges and i != begin:
            # without merging only the best way to a place matters
            p = max(here, key=lambda x: here[x][0])
            reach[i] = {p: here[p]}
        i += 1
    return reach, None


def transfer(model: Model, text: str, base: int, start: int, stop: int, end: int) -> dict[State | None, dict[State, float]]:
    """A chunk's matrix: for each state at its start (None at the text's start), the states at its end with their best scores."""
    entries: list[State | None] = [None] if start == 0 else list(states_at(model, text, start, base))
    rows: dict[State | None, dict[State, float]] = {}
    first: Reach | None = None
    for entry in entries:
        reach, shift = forward(model, text, base, entry, stop, first)
        row: dict[State, float] = {}
        if shift is not None and first is not None:
            # The two go on alike: what the first reaches, shifted by the scores' difference.
            row = {s: v + shift for s, v in rows[first_entry].items()}
        else:
            for e, pieces in reach.items():
                if stop <= e <= end:
                    for p, (score, _) in pieces.items():
                        if p and e - len(p) < stop:
                            row[e - len(p), e] = max(score, row.get((e - len(p), e), _NEVER))
            if first is None and row:
                first, first_entry = reach, entry
        rows[entry] = row
    return rows


def combine(left: dict, right: dict) -> dict:
    """The (max, +) product of two neighbouring matrices."""
    out: dict = {}
    for entry, row in left.items():
        best: dict[State, float] = {}
        for mid, s in row.items():
            for leave, w in right.get(mid, {}).items():
                if s + w > best.get(leave, _NEVER):
                    best[leave] = s + w
        out[entry] = best
    return out


def product(matrices: list[dict]) -> dict:
    """The product of neighbouring matrices, by a tree of pairs."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def choose(matrices: list[dict], entry: State | None, leave: State | None, end: int) -> list[State]:
    """The states at the matrices' ends on the best way from an entry state to a leaving one; without the latter, to the text's end."""
    prefix: list[dict[State | None, float]] = [{entry: 0.0}]
    for m in matrices:
        prefix.append(combine({None: prefix[-1]}, m)[None])
    if leave is None:
        last = {s: v for s, v in prefix[-1].items() if s[1] == end}
        leave = max(last, key=lambda s: (last[s], s[0]))
    out = [leave]
    for k in range(len(matrices) - 1, 0, -1):
        came = [(v + matrices[k][s][out[-1]], s) for s, v in prefix[k].items() if out[-1] in matrices[k].get(s, {})]
        out.append(max(came)[1])
    return out[::-1]


def trace(model: Model, text: str, base: int, entry: State | None, leave: State, stop: int) -> list[str]:
    """The pieces after the entry state's up to and with the leaving state's."""
    reach, _ = forward(model, text, base, entry, stop)
    at, p = leave[1], text[leave[0] - base : leave[1] - base]
    pieces: list[str] = []
    begin = base if entry is None else entry[1]
    while at > begin:
        came = reach[at][p][1]
        if isinstance(came, int):
            pieces += [p for w in _WORDS.findall(text, came - base, at - base) for p in model.word(w)[1]][::-1]
            at, p = came, next(iter(reach[came]))
            continue
        pieces.append(p)
        at -= len(p)
        p = came if came is not None else ""
        if not p and at > begin:
            raise ValueError("the way back is broken")
    return pieces[::-1]


def chunks(length: int, size: int, longest: int) -> list[tuple[int, int]]:
    """Borders of chunks of about size characters; none shorter than two of the longest pieces."""
    size = max(size, 2 * longest)
    cuts = list(range(0, max(1, length - 2 * longest), size)) or [0]
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], length], strict=True)]


def scan_encode(model: Model, text: str, size: int = CHUNK) -> list[int]:
    """The whole scan in one task."""
    t = model.normalised(text)
    if not t:
        return []
    parts = chunks(len(t), size, model.longest)
    matrices = [transfer(model, t, 0, a, b, len(t)) for a, b in parts]
    ways: list[State | None] = [None, *choose(matrices, None, None, len(t))]
    return model.numbers([p for k, (_, b) in enumerate(parts) for p in trace(model, t, 0, ways[k], ways[k + 1], b)])


def encode(docs: DataFrame, text: str = "text", *more: Column, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """What `more` names, ids (array<int>), n_tokens, and round_trip: whether decoding gives the text back."""
    given = docs.select(*(c.alias(f"c{k}") for k, c in enumerate(more)), F.col(text).cast("string").alias("text"))
    names = [docs.select(c).columns[0] for c in more]
    fields = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(given.schema.fields[:-1]))
    out = f"{fields}ids array<int>, n_tokens long, round_trip boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = m.sp.encode([t or "" for t in texts], num_threads=1)
                back = m.sp.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([None if t is None else np.asarray(i, np.int32) for t, i in zip(texts, ids, strict=True)], pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array([None if t is None else t == b for t, b in zip(texts, back, strict=True)])],
                    names=[*part.schema.names[:-1], "ids", "n_tokens", "round_trip"],
                )

    size = F.char_length("text")
    common = given.where(F.coalesce(size, F.lit(0)) <= giant).mapInArrow(whole, out)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for k in range(len(batch)):
                part = batch.slice(k, 1)
                t = part.column(part.num_columns - 1)[0].as_py()
                ids = scan_encode(m, t, chunk)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([ids], pa.list_(pa.int32())), pa.array([len(ids)], pa.int64()), pa.array([m.sp.decode(ids) == t])], names=[*part.schema.names[:-1], "ids", "n_tokens", "round_trip"])

    common = common.unionByName(given.where((size > giant) & (size <= fan * chunk)).mapInArrow(scanned, out))

    # Giants of more chunks: a row for each chunk, with a margin for the pieces over its borders.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for number, raw in zip(*(batch.column(c) for c in (0, 1)), strict=True):
                t = m.normalised(raw.as_py())
                parts = chunks(len(t), chunk, m.longest)
                for k, (a, b) in enumerate(parts):
                    base, top = max(0, a - m.longest), min(len(t), b + m.longest)
                    yield pa.RecordBatch.from_pydict({"doc": [number.as_py()], "k": [k], "base": [base], "a": [a], "b": [b], "stop": [len(t)], "piece": [t[base:top]]})

    numbers = lambda *names: pa.schema([(c, pa.int64()) for c in names])

    def flat(m: dict) -> list[float]:
        return [x for e, row in m.items() for s, v in row.items() for x in (*(e or (-1, -1)), *s, v)]

    def rows_of(cells: list[float]) -> dict:
        m: dict = {}
        for x in range(0, len(cells), 5):
            a, b, c, d, v = cells[x : x + 5]
            m.setdefault(None if a < 0 else (int(a), int(b)), {})[int(c), int(d)] = v
        return m

    cells = "doc long, k long, stop long, cells array<double>"
    kept = numbers("doc", "k", "stop").append(pa.field("cells", pa.list_(pa.float64())))

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"doc": [r["doc"]], "k": [r["k"]], "stop": [r["stop"]], "cells": [flat(transfer(m, r["piece"], r["base"], r["a"], r["b"], r["stop"]))]}, schema=kept)

    def combined(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("k").to_pylist()
        return pa.table({"doc": [rows[0]["doc"]], "k": [rows[0]["up"]], "stop": [rows[0]["stop"]], "cells": [flat(product([rows_of(r["cells"]) for r in rows]))]}, schema=kept)

    def ways(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("k").to_pylist()
        state = lambda a, b: None if a is None or a < 0 else (a, b)
        path = choose([rows_of(r["cells"]) for r in rows], state(rows[0]["ea"], rows[0]["eb"]), state(rows[0]["la"], rows[0]["lb"]), rows[0]["stop"])
        before = [(rows[0]["ea"], rows[0]["eb"]), *path[:-1]]
        return pa.table({"doc": [r["doc"] for r in rows], "k": [r["k"] for r in rows], "ea": [s[0] for s in before], "eb": [s[1] for s in before], "la": [s[0] for s in path], "lb": [s[1] for s in path]}, schema=numbers("doc", "k", "ea", "eb", "la", "lb"))

    def best_states(pieces: DataFrame, tasks: int, paths: list[str]) -> DataFrame:
        """(doc, k, ea, eb, la, lb): the states at each chunk's start and end; matrices go up a tree, states down."""
        up = F.expr(f"k div {fan}").alias("up")
        level, path = store.keep(pieces.repartition(tasks, "doc", "k").mapInArrow(matrix, cells), "matrices")
        levels = [level]
        paths.append(path)
        while (levels[-1].agg(F.max("k")).first()[0] or 0) >= fan:
            level, path = store.keep(levels[-1].withColumn("up", up).groupBy("doc", "up").applyInArrow(combined, cells), "matrices")
            levels.append(level)
            paths.append(path)
        states = levels[-1].select("doc").distinct().select("doc", F.lit(0).cast("long").alias("up"), *(F.lit(-1).cast("long").alias(c) for c in ("ea", "eb", "la", "lb")))
        for level in reversed(levels):
            states = level.withColumn("up", up).join(states, ["doc", "up"]).groupBy("doc", "up").applyInArrow(ways, "doc long, k long, ea long, eb long, la long, lb long")
            if level is not levels[0]:
                states, path = store.keep(states.withColumnRenamed("k", "up"), "states")
                paths.append(path)
        return states

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for r in batch.to_pylist():
                entry = None if r["ea"] < 0 else (r["ea"], r["eb"])
                ids = m.numbers(trace(m, r["piece"], r["base"], entry, (r["la"], r["lb"]), r["b"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["doc"]]), pa.array([r["k"]], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc", "k", "part"])

    giants, _ = store.keep(given.where((size > giant) & (size > fan * chunk)).withColumn("doc", F.monotonically_increasing_id()), "giants")
    if not giants.limit(1).count():
        return common.toDF(*names, "ids", "n_tokens", "round_trip")
    # many small tasks: a giant's chunks are spread over the cluster
    spread = giants.select("doc", "text").mapInArrow(cut, "doc long, k long, base long, a long, b long, stop long, piece string")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, or small chunks are put together in few tasks
    pieces, pieces_path = store.keep(spread, "chunks")
    paths = [pieces_path]
    chosen = best_states(pieces, tasks, paths)
    # by another hash than the join's, or the few partitions that it is put together in stay
    traced = pieces.join(chosen, ["doc", "k"]).repartition(tasks, F.xxhash64("doc", "k")).mapInArrow(back, "doc long, k long, part array<int>")
    traced, _ = store.keep(traced, "pieces")
    store.drop(docs.sparkSession, *paths)
    joined = traced.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("ids"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            ids, texts = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            ok = [m.sp.decode(i.as_py()) == t.as_py() for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], ids, pa.array([len(i) for i in ids], pa.int64()), pa.array(ok)], names=[*batch.schema.names[:-2], "ids", "n_tokens", "round_trip"])

    large = giants.join(joined, "doc").select(*(f"c{k}" for k in range(len(more))), "text", "ids").mapInArrow(check, out)
    return common.unionByName(large).toDF(*names, "ids", "n_tokens", "round_trip")


def decode(encoded: DataFrame, ids: str = "ids", *more: Column, model: str = MODEL) -> DataFrame:
    """What `more` names, and text: what the ids stand for. Null ids: null; no ids: empty."""
    given = encoded.select(*(c.alias(f"c{k}") for k, c in enumerate(more)), F.col(ids).cast("array<int>").alias("ids"))
    names = [encoded.select(c).columns[0] for c in more]
    fields = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(given.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            texts = [None if i is None else m.sp.decode(i) if i else "" for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return given.mapInArrow(run, f"{fields}text string").toDF(*names, "text")

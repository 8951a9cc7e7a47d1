r"""Chat formatting by columnar byte assembly.

Each turn becomes `<turn ROLE>\n`, its text and `</turn>\n`. Inside roles and texts a backslash is doubled and `<turn `, `</turn>` become
`<\turn `, `<\/turn>` (in roles also `>` becomes `\>`), so the marks occur nowhere else and dropping each backslash that
precedes a character gives the text back. Lengths, cumulative offsets and scatter indices are computed for a whole batch in numpy, and heads,
contents and ends are copied into one preallocated buffer that becomes an Arrow column.

A conversation's rows are ordered by turn (null first), ties by role and then text, and read as a stream; each PART turns make a row of the result,
so a conversation, or a text, of any length needs bounded memory (a batch, or one text). As its turns are in order, one conversation is read by one task. Null text and null role are empty, repeated rows are turns each. Rows with a null conv_id form one conversation of their own.
An empty table gives no rows. Only the four named columns are read, under names of the operator's own, so extra columns are ignored whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.textbytes import expand

#: Turns of one row of the result at most.
PART = 512
FORMATTED = "conv_id long, part long, last boolean, n_turns long, formatted string, loss_starts array<long>, loss_lengths array<long>"
_END = "</turn>\n"
_TURN = re.compile(rb"<turn ((?:[^>\\]|\\.)*)>\n(.*?)</turn>\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def escape(col: pa.Array, role: bool = False) -> pa.Array:
    col = pc.replace_substring(col.fill_null("") if col.null_count else col, "\\", "\\\\")
    for control in ("turn ", "/turn>"):
        col = pc.replace_substring(col, "<" + control, "<\\" + control)
    return pc.replace_substring(col, ">", "\\>") if role else col


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data) if b"\\" in data else data


def _raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1 + col.offset)[col.offset :]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' strings of all columns, row by row, in one buffer; and where each cell begins (rows x columns, then the end)."""
    raw = [_raw(c) for c in columns]
    lengths = np.stack([np.diff(off) for _, off in raw], axis=1)
    begin = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.ravel(), out=begin[1:])
    out = np.empty(int(begin[-1]), np.uint8)
    for k, (data, off) in enumerate(raw):
        out[expand(begin[:-1].reshape(lengths.shape)[:, k], lengths[:, k])] = data[off[0] : off[-1]]
    return out, begin


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Rows (conv_id, part, last, n_turns, formatted, loss_starts, loss_lengths): the loss mask's spans are in bytes of formatted and cover the texts of the role `trained`.

    A partition holds all parts of a conversation one after the other; most conversations have one.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))

    def build(block: pa.Table, first_part: int, ended: bool) -> pa.RecordBatch:
        """One row for each conversation of the block; the first is continued from before as part first_part, the last goes on unless ended."""
        conv = block.column("c").combine_chunks()
        null = np.asarray(conv.is_null())
        key = conv.fill_null(0).to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
        part = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        roles = block.column("r").combine_chunks()
        kinds = roles.dictionary_encode()
        heads = pc.binary_join_element_wise("<turn ", escape(kinds.dictionary, role=True), ">\n", "").take(kinds.indices)
        ends = pa.array(np.full(1, _END)).take(pa.array(np.zeros(len(key), np.int32)))
        out, begin = assemble([heads, escape(block.column("x").combine_chunks()), ends])
        # a part ends with its conversation or after PART turns
        begins = np.flatnonzero(new | (part % PART == 0))
        cells = begin[:-1].reshape(-1, 3)
        offsets = np.append(cells[begins, 0], begin[-1])
        loss = np.asarray(pc.equal(roles, trained))
        spans = np.flatnonzero(loss)
        owner = np.searchsorted(begins, spans, "right") - 1
        bounds = np.searchsorted(spans, np.append(begins, len(key))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x, pa.int64())) for x in (cells[spans, 1] - offsets[owner], cells[spans, 2] - cells[spans, 1])]
        numbers = part[begins] // PART
        numbers[begins < (np.flatnonzero(new)[1] if new.sum() > 1 else len(key))] += first_part
        last = np.append(new[begins[1:]], ended)
        formatted = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
        return pa.RecordBatch.from_arrays([conv.take(pa.array(begins)), pa.array(numbers, pa.int64()), pa.array(last), pa.array(np.diff(np.append(begins, len(key))), pa.int64()), formatted, *lists], names=["conv_id", "part", "last", "n_turns", "formatted", "loss_starts", "loss_lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        done = 0  # parts of the conversation that rest belongs to
        for batch in batches:
            if not len(batch):
                continue
            block = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            # Hold back the turns of the last conversation, but for whole parts.
            conv = block.column("c").combine_chunks()
            last = conv[-1].as_py()
            same = np.asarray(pc.is_null(conv) if last is None else pc.fill_null(pc.equal(conv, last), False))
            start = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            whole = (len(conv) - start - 1) // PART * PART
            cut = start + whole
            if cut:
                yield build(block.slice(0, cut), done, ended=whole == 0)
                done = whole // PART + (done if start == 0 else 0)
            rest = block.slice(cut)
        if rest is not None and len(rest):
            yield build(rest, done, ended=True)

    return rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(run, FORMATTED)


def parse(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted rows and their masks: counts and digests of its turns and of what is under the mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = chars = loss = 0
        turns, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for conv, last, text, starts, lengths in zip(*(batch.column(batch.schema.names.index(c)) for c in ("conv_id", "last", "formatted", "loss_starts", "loss_lengths")), strict=True):
                data = text.as_py().encode()
                chars += len(text.as_py())
                for role, said in parse(data):
                    n += 1
                    turns.update(role + b"\n" + said + b"\n")
                for a, k in zip(starts.as_py(), lengths.as_py(), strict=True):
                    said = unescape(data[a : a + k])
                    masked.update(said)
                    loss += len(said.decode())
                if last.as_py():
                    out.append((conv.as_py(), n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                    n = chars = loss = 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return formatted.mapInArrow(run, schema)

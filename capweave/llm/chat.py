"""Chat formatting by columnar byte assembly.

A turn becomes `<s>[INST] ROLE [/INST]TEXT</s>`. Control strings inside roles and texts are escaped: every
`<` or `[` that, after any number of backslashes, goes on as `s>`, `/s>`, `INST]` or `/INST]` gets one more
backslash; reading back takes one away. The loss mask covers the (escaped) text of each assistant turn.

Rows are dealt by conv_id and sorted by (turn, role, text); each Arrow batch is assembled at once: segment
lengths, their cumulative offsets and scatter indices come from numpy, and headers and contents are copied
into one preallocated buffer, which is the output column. A conversation that runs over several batches
comes out in several parts, so memory is bounded by the batch, however long the conversation is.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own; null turns come first.
Repeated rows are turns of their own. A table without rows gives none. Only conv_id, turn, role, text are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, table

HEAD, MIDDLE, TAIL = b"<s>[INST] ", b" [/INST]", b"</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
BATCH_BYTES = 8 << 20
FORMATTED = "conv_id long, part int, formatted string, mask array<struct<start:int,length:int>>"


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), _CONTROL, r"\1\\\2\3")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and the length of each row."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data else np.zeros(0, np.uint8)
    return raw, np.diff(offs)


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted strings of the conversations whose turns begin at `first`; of each turn, start and length of its text in code points."""
    role, text = escaped(role), escaped(text)
    (role_raw, role_n), (text_raw, text_n) = _bytes(role), _bytes(text)
    n = len(role_n)
    sizes = np.stack((np.full(n, len(HEAD)), role_n, np.full(n, len(MIDDLE)), text_n, np.full(n, len(TAIL))), 1)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, HEAD), (2, MIDDLE), (4, TAIL)):
        out[starts[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, raw, size in ((1, role_raw, role_n), (3, text_raw, text_n)):
        source = np.cumsum(size) - size
        out[np.arange(len(raw)) + np.repeat(starts[:, k] - source, size)] = raw
    edges = np.append(starts[first, 0], len(out)).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(out)).cast(pa.string())
    chars = np.asarray(pc.utf8_length(text)).astype(np.int64)
    whole = chars + np.asarray(pc.utf8_length(role)) + len(HEAD) + len(MIDDLE) + len(TAIL)
    before = np.cumsum(whole) - whole
    base = np.repeat(before[first], np.diff(np.append(first, n))) if n else before
    return column, before - base + whole - chars - len(TAIL), chars


def _format(batches):
    last, part = (), 0
    for b in batches:
        step = max(1, b.num_rows * BATCH_BYTES // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            piece = b.slice(at, step)
            ids = piece.column(0)
            known, value = np.asarray(pc.is_valid(ids)), np.asarray(pc.fill_null(ids, 0))
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (known[1:] != known[:-1])
            first = np.flatnonzero(new)
            formatted, start, length = assemble(piece.column(1), piece.column(2), first)
            parts = np.zeros(len(first), np.int32)
            part = part + 1 if (bool(known[0]), int(value[0])) == last else 0
            parts[0] = part
            part = part if len(first) == 1 else 0
            last = (bool(known[-1]), int(value[-1]))
            said = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(piece.column(1), "assistant"), False)))
            counts = np.searchsorted(said, np.append(first, len(value))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(start[said], pa.int32()), pa.array(length[said], pa.int32())], ["start", "length"])
            mask = pa.ListArray.from_arrays(pa.array(counts), spans)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(parts), formatted, mask], ["conv_id", "part", "formatted", "mask"])


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, formatted, mask (code points of the part), in order within each partition."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return by_batches(rows.select("conv_id", "role", "text"), _format, FORMATTED)


def _read_back(batches):
    """Digests of each conversation, from its formatted parts and masks alone."""
    state = None

    def row():
        conv, turns, n, loss, chars, total = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
    for b in batches:
        rows = []
        for conv, part, formatted, mask in zip(*[b.column(i).to_pylist() for i in range(4)]):
            if not part:
                if state:
                    rows.append(row())
                state = [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in _TURN.findall(formatted):
                state[1].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                state[2] += 1
            for span in mask:
                said = unescaped(formatted[span["start"] : span["start"] + span["length"]])
                state[3].update(said.encode())
                state[4] += len(said)
            state[5] += len(formatted)
        if rows:
            yield pack(rows)
    if state:
        yield pack([row()])


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation; formatted: as format_chats() returns it, neither dealt nor sorted anew."""
    return by_batches(formatted, _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for t, r in ((0, "user"), (1, "assistant"))])))
    return chat_digests(format_chats(turns.unionByName(extra)))


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS x FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(role) + length(x) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

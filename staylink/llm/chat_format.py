r"""Chat formatting by columnar byte assembly.

Template, one turn after another:

    ### <Role>:\n<escaped text></turn>\n

Control strings inside texts and roles are escaped reversibly: every backslash becomes
two, "###" becomes "\###" and "</turn>" becomes "\</turn>"; in roles ":" becomes "\:". So
an unescaped marker is always the template's own.

A batch is assembled in numpy: the lengths of all segments (marker, role, marker, text,
marker per turn) give cumulative offsets and scatter indices, and every byte goes into
one preallocated Arrow buffer. Rows of a conversation are streamed in turn order; a
conversation that spans batches continues in the next, so no conversation is ever held
whole.
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

from staylink.llm.shared import columns
from staylink.llm.words import buffers, slices

OPEN, AFTER_ROLE, CLOSE = b"### ", b":\n", b"</turn>\n"


def escaped(column: pa.Array, also: str = "") -> pa.Array:
    column = pc.fill_null(column, "").cast(pa.large_string())
    for control in ("\\", "###", "</turn>", *also):
        column = pc.replace_substring(column, control, "\\" + control)
    return column



def assemble(roles: pa.Array, texts: pa.Array, loss_roles: frozenset[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted turns, start, end): one string for each row, sharing one buffer, and the byte
    span in it under the loss mask (empty for roles that are not learned)."""
    n = len(texts)
    parts = [np.frombuffer(OPEN, np.uint8), None, np.frombuffer(AFTER_ROLE, np.uint8), None, np.frombuffer(CLOSE, np.uint8)]
    bodies = {1: buffers(escaped(roles, ":")), 3: buffers(escaped(texts))}
    lengths = np.empty((n, 5), np.int64)
    for k, part in enumerate(parts):
        lengths[:, k] = np.diff(bodies[k][1]) if part is None else len(part)
    offsets = np.zeros(n * 5 + 1, np.int64)
    np.cumsum(lengths.ravel(), out=offsets[1:])
    begin = offsets[:-1].reshape(n, 5)
    out = np.empty(offsets[-1], np.uint8)
    for k, part in enumerate(parts):
        if part is not None:
            out[(begin[:, k, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
        else:
            raw, own = bodies[k]
            out[np.arange(len(raw)) + np.repeat(begin[:, k] - own[:-1], lengths[:, k])] = raw
    rows = np.append(begin[:, 0], offsets[-1]) if n else np.zeros(1, np.int64)
    formatted = pa.LargeStringArray.from_buffers(n, pa.py_buffer(rows), pa.py_buffer(out))
    learned = np.isin(np.array(roles.to_pylist(), dtype=object), list(loss_roles)) if n else np.zeros(0, bool)
    start = begin[:, 3] - begin[:, 0]
    return formatted, start, np.where(learned, start + lengths[:, 3], start)


def format_turns(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end) for every row, in turn order within partitions.

    The formatted turns of a conversation, in order, are its formatted text; the loss span
    is in bytes of the formatted turn. Null texts and roles are empty; rows of equal turn
    are ordered by role, then text; null turns come first; null ids are one conversation.
    Nothing is dropped or merged. One shuffle, by conversation.
    """
    rows = columns(conversations, conv_id=conv, turn=turn, role=role, text=text)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = [ordered.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = frozenset(loss_roles)
        for batch in batches:
            for part in slices(batch, "text"):
                formatted, start, end = assemble(part.column("role"), part.column("text"), learned)
                arrays = [part.column("conv_id"), part.column("turn"), formatted.cast(pa.string()), pa.array(start), pa.array(end)]
                yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return ordered.mapInArrow(assembled, f"conv_id {kinds[0]}, turn {kinds[1]}, formatted string, loss_start long, loss_end long")


#: A role holds no bare colon or backslash, so the first bare colon ends it.
TURN = re.compile(r"### ((?:[^\\:]|\\(?:###|</turn>|\\|:))*):\n(.*)</turn>\n", re.S)


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn, read back from the template alone."""
    found = TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return _plain(found[1]), _plain(found[2])


def _plain(text: str) -> str:
    """Undo the escapes from left to right: a backslash protects the control string after it."""
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out.append(text[at:k])
        skip = next((c for c in ("###", "</turn>", "\\", ":") if text.startswith(c, k + 1)), None)
        if skip is None:
            raise ValueError("a lone backslash is never written")
        out.append(skip)
        at = k + 1 + len(skip)
    return "".join([*out, text[at:]])


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from the formatted turns: incremental over the
    partition's order, so a conversation of any length needs only its two hash states."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        done: list[tuple] = []
        ids, now, state = None, object(), None

        def close() -> None:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, formatted, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if hi > lo:
                    learned = _plain(formatted.encode()[lo:hi].decode())
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            if done:
                yield flush()
        if state is not None:
            close()
            yield flush()

    return turns.mapInArrow(digest, schema)


def formatted_chars_sql(role: str, text: str) -> str:
    """DuckDB SQL for the characters that a turn takes in the template."""
    grown = " + ".join(f"length({c}) + (length({c}) - length(replace({c}, '\\', ''))) + (length({c}) - length(replace({c}, '###', ''))) // 3 + (length({c}) - length(replace({c}, '</turn>', ''))) // 7" for c in (role, text))
    grown += f" + length({role}) - length(replace({role}, ':', ''))"
    return f"{len(OPEN) + len(AFTER_ROLE) + len(CLOSE)} + {grown}"


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = columns(table, conv_id="conv_id", turn="turn", role="role", text="text")
    planted = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], own.schema)
    return read_back(format_turns(own.unionByName(more)))


SQL = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) as turns_sha256,
  cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when r = 'assistant' then t else '' end, '' order by turn nulls first, r, t)) as loss_sha256,
  cast(sum({formatted_chars_sql("r", "t")}) as bigint) as formatted_chars
from rows group by conv_id
"""

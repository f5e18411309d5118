"""Fill-in-middle transformation with piece tables.

A batch of texts is one immutable buffer; the sentinels are another. A document is a list of
descriptors (buffer, start, length) over the two, and nothing else is ever moved:

- cutting splits the document's one descriptor into prefix, middle and suffix;
- an arrangement permutes them and puts sentinel descriptors between;
- the output is read by streaming the descriptors, into a hash or into an Arrow buffer;
- restoring finds the sentinels in the output, cuts the output there, and applies the inverse
  permutation.

Cut points come from hashes of the document id, so a retried task makes the same output. Every
document is transformed alone: no shuffle, and memory bounded by one slice of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from staylink.llm.shared import columns
from staylink.llm.words import buffers, slices

PREFIX, MIDDLE, SUFFIX = range(3)
#: The sentinels of prefix, middle and suffix, and the immutable buffer that holds them.
SENTINELS = (b"<P>", b"<M>", b"<S>")
SENTINEL_BUFFER = b"".join(SENTINELS)
#: Form: the order of the pieces, each behind its sentinel.
ARRANGEMENTS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The restored text is always prefix, middle, suffix: where each stands in an arrangement.
INVERSE = {form: tuple(order.index(part) for part in range(3)) for form, order in ARRANGEMENTS.items()}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_NEXT_POINT = np.zeros(256, bool)  # bytes that begin a code point
_NEXT_POINT[:128] = _NEXT_POINT[192:] = True

TEXT, SENTINEL = 0, 1


@dataclass(frozen=True)
class Rates:
    """Percent of documents that stay plain, and percent of the others in the spm form."""

    plain: int = 10
    spm: int = 20


class Pieces:
    """The piece table of a slice of texts: units, cuts and forms of every document."""

    def __init__(self, ids: list, texts: pa.Array, rates: Rates):
        self.raw, self.at = buffers(texts)
        self.view = memoryview(self.raw)
        raw, lo, hi = self.raw, self.at[:-1], self.at[1:]
        letter = _LETTER[raw]
        begins = _NEXT_POINT[raw]
        after = np.zeros(len(raw), bool)  # a letter right behind a letter of the same text
        after[1:] = letter[:-1]
        after[lo[lo < hi]] = False
        starts = np.flatnonzero(begins & ~(letter & after))
        first = np.searchsorted(starts, self.at)
        self.n = np.diff(first)
        draws = np.array([draw(i) for i in ids], np.int64).reshape(-1, 4)
        one, two = draws[:, 0] % (self.n + 1), draws[:, 1] % (self.n + 1)
        units = np.append(starts, len(raw))
        self.cut1, self.cut2 = (self._byte(units, first, hi, c) for c in (np.minimum(one, two), np.maximum(one, two)))
        points = np.concatenate(([0], np.cumsum(begins)))
        self.prefix_chars = points[self.cut1] - points[lo]
        self.middle_chars = points[self.cut2] - points[self.cut1]
        plain = (hi == lo) | self._marked() | (draws[:, 2] % 100 >= 100 - rates.plain)
        self.form = np.where(plain, "plain", np.where(draws[:, 3] % 100 < rates.spm, "spm", "psm")).tolist()
        self.plain = plain

    def _byte(self, units, first, hi, cut) -> np.ndarray:
        """The byte at which unit number `cut` of each text starts; its end behind the last unit."""
        return np.where(cut < self.n, units[np.minimum(first[:-1] + cut, len(units) - 1)], hi)

    def _marked(self) -> np.ndarray:
        """Texts that hold a sentinel."""
        raw, out = self.raw, np.zeros(len(self.at) - 1, bool)
        at = np.flatnonzero(raw[:-2] == 0x3C) if len(raw) > 2 else np.zeros(0, np.int64)
        at = at[(raw[at + 2] == 0x3E) & np.isin(raw[at + 1], np.frombuffer(b"PMS", np.uint8))]
        doc = np.searchsorted(self.at, at, "right") - 1
        out[doc[at + 3 <= self.at[doc + 1]]] = True
        return out

    def cut(self, i: int) -> list[tuple[int, int, int]]:
        """The document's descriptor split in three: prefix, middle, suffix."""
        lo, a, b, hi = self.at[i], self.cut1[i], self.cut2[i], self.at[i + 1]
        return [(TEXT, lo, a - lo), (TEXT, a, b - a), (TEXT, b, hi - b)]

    def arranged(self, i: int) -> list[tuple[int, int, int]]:
        """The descriptors of the output."""
        if self.plain[i]:
            return [(TEXT, self.at[i], self.at[i + 1] - self.at[i])]
        parts = self.cut(i)
        out = []
        for part in ARRANGEMENTS[self.form[i]]:
            out += [(SENTINEL, 3 * part, 3), parts[part]]
        return out

    def stream(self, descriptors: list[tuple[int, int, int]]) -> Iterator[memoryview]:
        for buffer, start, length in descriptors:
            source = self.view if buffer == TEXT else memoryview(SENTINEL_BUFFER)
            yield source[start : start + length]


def draw(doc_id) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the id alone; a missing id draws as an empty one."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def restored(output: bytes, form: str) -> list[tuple[int, int]]:
    """(start, length) in the output, in the order of the text: its exact inverse from output and form.

    The text holds no sentinel where the form is not plain, and none can arise where two pieces
    meet, so each sentinel occurs once.
    """
    if form == "plain":
        return [(0, len(output))]
    order = ARRANGEMENTS[form]
    marks = [output.index(SENTINELS[part]) for part in order]
    ends = [*marks[1:], len(output)]
    pieces = [(m + 3, e - m - 3) for m, e in zip(marks, ends, strict=True)]
    return [pieces[k] for k in INVERSE[form]]


def _sha256(parts) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def transform(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    n counts the units (a run of ASCII letters, or any other single code point) between which a
    text may be cut. A null text is empty; an empty text, and one that holds a sentinel, stays
    plain. Rows of equal id are cut by the same draws, each over its own units; rows without an id
    draw as an empty id. Other columns, whatever their names, are left out.

    With ``digests`` the output column is replaced by output_sha256 (the descriptors streamed into a hash) and
    restored_sha256 (the text rebuilt from the output and the form).
    """
    own = columns(docs, doc_id=id_col, text=text_col)
    schema = SCHEMA + (", output_sha256 string, restored_sha256 string" if digests else ", output string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                pieces = Pieces(ids.to_pylist(), part.column("text"), rates)
                none = pa.array(pieces.plain)
                out = [ids.cast(pa.int64()), pa.array(pieces.n.astype(np.int64)), pa.array(pieces.form, pa.string())]
                out += [pa.array(c.astype(np.int64), mask=np.asarray(none)) for c in (pieces.prefix_chars, pieces.middle_chars)]
                if digests:
                    pairs = [_digests(pieces, i) for i in range(part.num_rows)]
                    out += [pa.array([p[k] for p in pairs], pa.string()) for k in range(2)]
                    names = ["output_sha256", "restored_sha256"]
                else:
                    out.append(outputs(pieces))
                    names = ["output"]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "form", "prefix_chars", "middle_chars", *names])

    return own.mapInArrow(run, schema)


def _digests(pieces: Pieces, i: int) -> tuple[str, str]:
    output = b"".join(pieces.stream(pieces.arranged(i)))
    back = memoryview(output)
    return _sha256(pieces.stream(pieces.arranged(i))), _sha256(back[s : s + n] for s, n in restored(output, pieces.form[i]))


def outputs(pieces: Pieces) -> pa.Array:
    """All outputs of the slice in one buffer."""
    descriptors = [pieces.arranged(i) for i in range(len(pieces.form))]
    size = [sum(d[2] for d in ds) for ds in descriptors]
    offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    out = bytearray(int(offsets[-1]))
    at = 0
    for ds in descriptors:
        for piece in pieces.stream(ds):
            out[at : at + len(piece)] = piece
            at += len(piece)
    whole = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(bytes(out)))
    return whole.cast(pa.string())


def restore(transformed: DataFrame) -> DataFrame:
    """(doc_id, text): the texts rebuilt from (doc_id, form, output) of :func:`transform`.

    Null outputs or forms give a null text.
    """
    own = columns(transformed, doc_id="doc_id", form="form", output="output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for form, output in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist(), strict=True):
                if form is None or output is None:
                    texts.append(None)
                    continue
                raw = output.encode()
                texts.append(b"".join(raw[s : s + n] for s, n in restored(raw, form)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return own.mapInArrow(run, "doc_id long, text string")


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    return transform(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents
), u as (
  select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') u, cast('0x' || h[1:8] as bigint) h1, cast('0x' || h[9:16] as bigint) h2,
    cast('0x' || h[17:24] as bigint) h3, cast('0x' || h[25:32] as bigint) h4 from d
), c as (
  select *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form
  from u
), p as (
  select *, array_to_string(u[1:a], '') prefix, array_to_string(u[a + 1:b], '') middle, array_to_string(u[b + 1:], '') suffix from c
)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256,
  sha256(t) restored_sha256
from p
"""

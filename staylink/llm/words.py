"""Vectorised word spans and hashes over Arrow string columns.

Everything works on the UTF-8 bytes of a whole slice of texts at once: word
boundaries are byte-class changes, a word's hash is a weighted sum of its bytes,
and a window of words is a short polynomial over word hashes. Null texts are
empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_ODD2 = U64(0xD6E8FEB86659FD93)

#: White space of the word contracts: 0x20 and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)

#: Positions whose weights a worker keeps (512 KB a salt), and elements that one step of a hash handles.
_KEPT = 1 << 16
_STEP = 1 << 18


def _weights(first: int, last: int, salt: np.uint64) -> np.ndarray:
    """Pseudo-random odd 64-bit weights of the positions first to last - 1."""
    return mix(np.arange(first + 1, last + 1, dtype=U64) * _ODD2 ^ salt) | U64(1)


@lru_cache(maxsize=4)
def _kept_weights(salt: int) -> np.ndarray:
    return _weights(0, _KEPT, U64(salt))


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = _BYTE, salt: np.uint64 = _ODD) -> np.ndarray:
    """A hash of raw[start:end] for every span, a function of the values and their number alone.

    Each place in a span has a pseudo-random weight of its own. A polynomial in one base modulo
    2**64 has not: whatever the base, it takes some different texts of 1024 letters for equal.
    Spans are handled in steps of bounded size; nothing larger than the weights of one step is kept.
    Another salt gives an independent hash. raw is bytes looked up in table, or 64-bit values.
    """
    out = np.zeros(len(starts), U64)
    size = (ends - starts).astype(np.int64)
    some = np.flatnonzero(size)
    total = np.cumsum(size[some])
    kept = _kept_weights(int(salt))
    lo = 0
    while lo < len(some):
        base = total[lo] - size[some[lo]]
        hi = max(lo + 1, int(np.searchsorted(total, base + _STEP, "right")))
        if hi == lo + 1 and size[some[lo]] > _KEPT:  # one long span
            begin, end = int(starts[some[lo]]), int(ends[some[lo]])
            for at in range(begin, end, _STEP):
                piece = raw[at : min(at + _STEP, end)]
                piece = piece if table is None else table[piece]
                out[some[lo : lo + 1]] += (piece * _weights(at - begin, at - begin + len(piece), salt)).sum(dtype=U64)
        else:
            own, n = some[lo:hi], size[some[lo:hi]]
            first = total[lo:hi] - n - base
            flat = np.arange(int(n.sum()))
            place = flat - np.repeat(first, n)
            values = raw[flat + np.repeat(starts[own] - first, n)]
            weight = kept if int(n.max()) <= _KEPT else _weights(0, int(n.max()), salt)
            out[own] = np.add.reduceat((values if table is None else table[values]) * weight[place], first)
        lo = hi
    return mix(out + size.astype(U64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_INV = {int(b): U64(pow(int(b), -1, 1 << 64)) for b in (_ODD, _ODD2)}


class RangeHashes:
    """Position-independent polynomial hashes of values[start:end] for ranges that may overlap:
    running sums made once, two look-ups a range.

    Only for finding candidates: some different long texts have equal hashes.
    """

    def __init__(self, values: np.ndarray, base: np.uint64):
        self.total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * _powers(int(base), len(values)), out=self.total[1:])
        self.inverse = _powers(int(_INV[int(base)]), len(values) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(U64) * _ODD)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[start:start + size] equals the same of b, for every pair of starts; sizes above 0."""
    out = np.ones(len(size), bool)
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        base = total[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(total, base + _STEP, "right")))
        n = size[lo:hi]
        begin = total[lo:hi] - n - base
        flat = np.arange(int(n.sum()))
        equal = a[flat + np.repeat(a_starts[lo:hi] - begin, n)] == b[flat + np.repeat(b_starts[lo:hi] - begin, n)]
        out[lo:hi] = np.logical_and.reduceat(equal, begin)
        lo = hi
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together and the offsets (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if at else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give freed memory back to the system. Workers live on from stage to stage: what one stage
    has freed would else still count when the next one runs."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most max_bytes of text each (one longer text stands alone).

    Bounds the working memory of the numpy passes; no text is cut.
    """
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    lo, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > max_bytes:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lo < len(lengths):
        yield batch.slice(lo)
    release()


class Words:
    """Words of a slice of texts: byte spans, and the first word of each text."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False):
        raw, self.offsets = buffers(texts)
        self.raw = LOWER[raw] if lower else raw
        inside = ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside
        here = np.zeros(len(raw) + 1, bool)
        here[:-1] = inside
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text number of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, salt: np.uint64 = _ODD) -> np.ndarray:
        """One 64-bit hash for each word, a function of its bytes alone."""
        return spans_hash(self.raw, self.starts, self.ends, salt=salt)

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """(which, values): the number of every word's value, and the different values, equal by their bytes."""
        size = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(size)))
        cover = np.zeros(len(self.raw) + 1, np.int8)
        cover[self.starts] += 1
        cover[self.ends] -= 1
        body = self.raw[np.cumsum(cover[:-1], dtype=np.int8).view(bool)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(body)]).dictionary_encode()
        raw, at = buffers(coded.dictionary)
        raw = raw.tobytes()
        return np.asarray(coded.indices), [raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def strangers(self, first: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Words whose bytes differ from those of the word first[which], their group's first."""
        size = self.ends - self.starts
        peer = first[which]
        odd = size != size[peer]
        rest = np.flatnonzero(~odd & (peer != np.arange(len(peer))))
        odd[rest] = ~same_bytes(self.raw, self.starts[rest], self.raw, self.starts[peer[rest]], size[rest])
        return odd

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every run of k words inside one text."""
        n = max(0, len(hashes) - k + 1)
        doc = self.doc
        start = np.flatnonzero(doc[:n] == doc[k - 1 : k - 1 + n])
        h = np.zeros(n, U64)
        for j in range(k):
            h = h * _ODD2 + hashes[j : j + n]
        return start, mix(h[start] + U64(k) * _ODD)

    def sequences(self, hashes: np.ndarray, salt: np.uint64 = _ODD) -> np.ndarray:
        """One hash of each text's whole word sequence."""
        return spans_hash(hashes, self.first[:-1], self.first[1:], None, salt)

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text i (those where keep is true) joined by one space."""
        lo, hi = self.first[i], self.first[i + 1]
        starts, ends = self.starts[lo:hi], self.ends[lo:hi]
        if keep is not None:
            starts, ends = starts[keep[lo:hi]], ends[keep[lo:hi]]
        if not len(starts):
            return b""
        sizes = ends - starts + 1
        at = np.concatenate(([0], np.cumsum(sizes)))
        source = np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)
        out = self.raw[np.minimum(source, len(self.raw) - 1)].copy()
        out[at[1:] - 1] = 0x20
        return out[:-1].tobytes()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

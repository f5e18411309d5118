"""Repeated passages: windows of words that already start in an earlier document are removed.

1. Every k-word window has one anchor: its run of a few words with the smallest hash. The
   anchor depends on the window's words alone, so equal windows have equal anchors.
2. Documents are dealt into blocks of bounded bytes. Blocks send each different anchor
   once; anchors that two documents share are *recurring passages* to confirm.
3. Each block compiles the phrases of its own recurring anchors into an Aho-Corasick
   automaton over its words (the automata are shards of the corpus-wide one) and streams its
   documents through it. The windows around every occurrence are candidates.
4. Blocks send each candidate window once with its smallest document; the smallest over all
   blocks comes back, and confirms the windows that start in an earlier document.

No step collects a passage's documents: a passage that a third of all documents share
costs one row for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylink.llm.shared import columns, total_bytes, written, written_buckets
from staylink.llm.words import Words, signed

#: Words of a window, and of its anchor.
WINDOW, ANCHOR = 13, 4
#: Bytes of text that a block holds on average.
BLOCK_BYTES = 6 << 20


def anchors(words: Words, hashes: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, anchor word, anchor hash) of every window; the leftmost of equal hashes."""
    at, h = words.windows(hashes, size)
    start, _ = words.windows(hashes, window)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    full = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    full[at] = h
    best, where = full[start], np.zeros(len(start), np.int64)
    for k in range(1, window - size + 1):
        other = full[start + k]
        less = other < best
        best = np.where(less, other, best)
        where[less] = k
    return start, start + where, best


#: Words are spelled in digits of this base: a node of the automaton then has few children,
#: which it searches one by one.
BASE = 64  # 6 bits


def spelled(numbers: np.ndarray, digits: int) -> np.ndarray:
    """Each number as `digits` letters; every place has letters of its own, so that a match can
    only start at a word."""
    place = np.arange(digits)
    return (numbers[..., None] // BASE**place % BASE + BASE * place + 1).astype(np.uint32).reshape(*numbers.shape[:-1], -1)


def automaton(phrases: np.ndarray, digits: int):
    """Aho-Corasick over spelled words: one phrase of word numbers (a row) per key."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    size = phrases.shape[1] * digits
    letters = spelled(phrases, digits).tobytes().decode("utf-32-le")
    for at in range(0, len(letters), size):
        out.add_word(letters[at : at + size])
    out.make_automaton()
    return out


def occurrences(words: Words, hashes: np.ndarray, recurring: np.ndarray, size: int) -> np.ndarray:
    """True for every word at which a recurring phrase starts, found by the block's automaton."""
    found = np.zeros(len(hashes), bool)
    at, h = words.windows(hashes, size)
    mine, first = np.unique(h, return_index=True)
    first = first[np.isin(mine, recurring)]
    if not len(first):
        return found
    different, number = np.unique(hashes, return_inverse=True)
    digits = max(1, -(-(len(different) - 1).bit_length() // 6))
    machine = automaton(number[at[first][:, None] + np.arange(size)], digits)
    letters = spelled(number, digits)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= size:
            text = letters[lo * digits : hi * digits].tobytes().decode("utf-32-le")
            ends = np.array([e for e, _ in machine.iter(text)], np.int64)
            found[lo + (ends + 1) // digits - size] = True
    return found


class Block:
    """The documents of one block: words, hashes, and the window anchors."""

    def __init__(self, table: pa.Table, window: int, size: int):
        self.ids = table.column("doc_id").combine_chunks()
        self.words = Words(table.column("text"))
        self.hashes = self.words.hashes()
        self.start, self.anchor, self.key = anchors(self.words, self.hashes, window, size)
        doc = self.words.doc
        self.doc = doc[self.start] if len(self.start) else self.start
        #: ids as numbers; rows without an id are no one's predecessor and have none
        self.number = np.asarray(self.ids.fill_null(np.iinfo(np.int64).max), dtype=np.int64)
        self.valid = ~np.asarray(self.ids.is_null())

    def rows(self, block: int, keys: np.ndarray, docs: np.ndarray) -> pa.Table:
        """(key, block, low): each key once with its smallest id; the block is given as -1 - block
        if documents of different ids in it share the key. Rows without an id send nothing."""
        keep = self.valid[docs]
        keys, ids = keys[keep], self.number[docs[keep]]
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(keys)) - 1 if len(new) else new
        owner = np.where(ids[new] < ids[last], -1 - block, block).astype(np.int32)
        return pa.table({"key": pa.array(signed(keys[new])), "block": pa.array(owner), "low": pa.array(ids[new])})


def _shared(rows: DataFrame, *carry: str) -> DataFrame:
    """The keys that documents of different ids share, for each block that has them, with the
    smallest id as `first`. A key has at most one row per block, so its window is no larger
    than the number of blocks, however many documents share it."""
    over = Window.partitionBy("key")
    marked = rows.withColumn("n", F.count("*").over(over)).withColumn("first", F.min("low").over(over) if "low" in rows.columns else F.lit(None))
    return marked.filter("n > 1 or block < 0").select(F.when(F.col("block") < 0, -1 - F.col("block")).otherwise(F.col("block")).cast("int").alias("block"), "key", *carry)


def repeated(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) for every row; text is the kept words.

    doc_id must be a number. A window counts as seen if its words also start in a row with
    a smaller doc_id; rows of equal id do not remove each other's words; rows with a null
    id are never earlier and never lose words. Null texts are empty. Windows are judged on
    the input.
    """
    own = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks = max(1, -(-total_bytes(own, "text") // block_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    dealt = written_buckets(dealt, "blocks", "block", blocks)

    def block_of(key: tuple[pa.Scalar, ...]) -> int:
        return key[0].as_py()

    def send_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Block(table, window, size)
        return b.rows(block_of(key), b.key, b.doc).drop_columns("low")

    def send_windows(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, window, size)
        recurring = np.asarray(right.column("key"), dtype=np.int64).view(np.uint64)
        candidate = occurrences(b.words, b.hashes, recurring, size)[b.anchor] & np.isin(b.key, recurring)
        _, h = b.words.windows(b.hashes, window)
        return b.rows(block_of(key), h[candidate], b.doc[candidate])

    def remove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, window, size)
        keys = np.asarray(right.column("key"), dtype=np.int64).view(np.uint64)
        first = np.asarray(right.column("first"), dtype=np.int64)
        order = np.argsort(keys)
        keys, first = keys[order], first[order]
        keep = np.ones(len(b.hashes) + 1, bool)
        if len(keys) and len(b.start):
            _, h = b.words.windows(b.hashes, window)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            seen = b.start[(keys[at] == h) & (first[at] < b.number[b.doc]) & b.valid[b.doc]]
            depth = np.zeros(len(b.hashes) + 1, np.int64)
            depth[seen] += 1
            np.subtract.at(depth, seen + window, 1)
            keep = np.cumsum(depth) == 0
        texts = [b.words.joined(i, keep) for i in range(len(b.ids))]
        total = np.concatenate(([0], np.cumsum(~keep[: len(b.hashes)])))
        out = {
            "doc_id": b.ids, "n_words": pa.array(b.words.counts.astype(np.int64)),
            "n_removed": pa.array(np.diff(total[b.words.first]).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        return pa.table(out | ({"text": pa.array(texts, pa.binary()).cast(pa.string())} if keep_text else {}))

    anchor_rows = dealt.groupBy("block").applyInArrow(send_anchors, "key long, block int")
    recurring = written(_shared(anchor_rows), "recurring")
    window_rows = dealt.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(send_windows, "key long, block int, low long")
    confirmed = _shared(window_rows, "first")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return dealt.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(remove, schema)


def op1_phrase_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from w where len(w) >= 13)
), early as (
  select g, min(doc_id) d from win group by g
), gone as (
  select distinct doc_id, p from (select win.doc_id, unnest(range(i, i + 13)) p from win join early using (g) where early.d < win.doc_id)
), word as (
  select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from w where len(w) > 0
), kept as (
  select doc_id, count(*) n, string_agg(x, ' ' order by p) t from word anti join gone using (doc_id, p) group by doc_id
)
select w.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""

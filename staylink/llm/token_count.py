"""Token counts by the whole-token shortcut.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then merges the
bytes of each. Offline, once per Python worker, every vocabulary string is encoded
alone; those that come back as one token are *proven* whole tokens. A pre-token in
that set counts as one; only the others go through the merges (each different one
once per worker, in a bounded cache).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import columns
from staylink.llm.words import Words, slices

#: Merged pre-tokens, and runs, that one worker remembers; a cache is emptied when it is full.
#: Longer strings than CACHED_BYTES are not kept: about 30 MB a cache at most.
CACHE, CACHED_BYTES = 250_000, 64
#: Runs of the shortcut end at a space only.
ONE_SPACE = np.arange(256) == 0x20


#: Texts of these characters alone take the standard `re` engine: ASCII without the four
#: controls on which engines differ, and Latin letters. Others take `regex`.
SAFE = "\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ"
CLASSES = {r"\p{L}": "A-Za-zÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9", r"\s": "\t-\r "}


class Cutter:
    """findall of a pre-tokenizer pattern, on the faster of two engines that agree on the text."""

    def __init__(self, pattern: str):
        import re

        import regex

        name = r"\\p\{[LN]\}|\\s"
        inside = re.sub(rf"\[\^?(?:{name})+\]", lambda m: re.sub(name, lambda c: CLASSES[c[0]], m[0]), pattern)
        outside = re.sub(name, lambda c: f"[{CLASSES[c[0]]}]", inside)
        self.quick = re.compile(outside.replace(r"\S", f"[^{CLASSES[chr(92) + 's']}]")).findall
        self.full = regex.compile(pattern).findall
        self.odd = re.compile(f"[^{SAFE}]").search

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.odd(text) else self.quick(text)


class ByteLetters:
    """Text as the letters that byte-level vocabularies use for its UTF-8 bytes."""

    def __init__(self):
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        spare = iter(range(256, 512))
        self.of = {b: chr(b if b in kept else next(spare)) for b in range(256)}
        self.byte = {c: b for b, c in self.of.items()}

    def __call__(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.of)


def special_pattern(added: list[dict]):
    """Matches the special tokens' strings, longest first; None without any."""
    import re

    found = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


class WholeTokens:
    """Counter of tokens for one tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str):
        import json
        import re

        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("the shortcut is proven for byte-level BPE without a normaliser only")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = Cutter(public_tokenizers.PATTERN)
        self.gap = re.compile(r"[\t-\r ][\t-\r ]").search
        self.letters = ByteLetters()
        self.special = special_pattern(spec["added_tokens"])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.whole = self._prove(spec["model"]["vocab"])
        #: tokens of a pre-token: 1 for the proven ones, and what the merges gave for others
        self.table = dict.fromkeys(self.whole, 1)
        #: the same sums for whole runs after one space
        self.spaced: dict[bytes, int] = {}

    def _prove(self, vocab: dict[str, int]) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        texts = []
        for piece in vocab:
            try:
                texts.append(bytes(self.letters.byte[c] for c in piece).decode("utf-8"))
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: never a pre-token by itself
        alone = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return frozenset(t for t, e in zip(texts, alone, strict=True) if len(e.ids) == 1 and self.cut(t) == [t])

    def _merged(self, piece: str) -> int:
        """Tokens of a pre-token that the merges make; forgets earlier ones when the cache is full."""
        if len(self.table) >= len(self.whole) + CACHE:
            self.table = dict.fromkeys(self.whole, 1)
        n = len(self.tokenizer.model.tokenize(self.letters(piece)))
        if len(piece) <= CACHED_BYTES:
            self.table[piece] = n
        return n

    def _pieces(self, text: str) -> int:
        return sum(self.table.get(p) or self._merged(p) for p in self.cut(text))

    def _run(self, run: bytes) -> int:
        if len(self.spaced) >= CACHE:
            self.spaced.clear()
        n = self._pieces(" " + run.decode())
        if len(run) <= CACHED_BYTES:
            self.spaced[run] = n
        return n

    def _whole_text(self, text: str) -> int:
        if self.special is None:
            return self._pieces(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._pieces, parts))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text; a special token's string counts as one token, as the library has it.

        In a text without white space next to white space, no pre-token crosses into a
        space that another one begins with: it falls into runs, each with the space
        before it. Equal runs of a slice are counted once, the sums are taken in numpy.
        """
        odd = {
            i for i, t in enumerate(texts)
            if t[:1].isspace() or t[-1:].isspace() or self.cut.odd(t) or self.gap(t) or any(token in t for token in self.specials)
        }
        words = Words(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()), ONE_SPACE)
        _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        # equal hashes are not yet equal runs: texts with a run unlike its group's first are counted alone
        odd |= set((np.searchsorted(words.first, np.flatnonzero(words.strangers(first, which)), "right") - 1).tolist())
        raw, known = words.raw.tobytes(), self.spaced.get
        found = [known(r) or self._run(r) for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True) if (r := raw[s:e])]
        each = np.array(found, np.int64)[which] if found else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(each)))
        out = np.diff(total[words.first]).tolist()
        for i, text in enumerate(texts):
            if i in odd:
                out[i] = self._whole_text(text)
            elif lo := text.split(" ", 1)[0]:  # the first run has no space before it
                out[i] += self._pieces(lo) - int(each[words.first[i]])
        return out

    def pretoken_report(self, texts: list[str]) -> Counter:
        """How many pre-tokens took the shortcut and how many were merged."""
        seen: Counter = Counter()
        for text in texts:
            for p in self.cut(text):
                seen["whole" if p in self.whole else "merged"] += 1
        return seen


@lru_cache(maxsize=2)
def counter_for(path: str) -> WholeTokens:
    return WholeTokens(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, repeated rows and null ids included.

    A null text counts as the empty text (0 bytes, 0 tokens). Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter_for(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = model.counts(pc.fill_null(part.column("text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64())], ["id", "n_tokens"])

    ids = columns(docs, id=id_col, text=text_col)
    kind = ids.schema["id"].dataType.simpleString()
    # the byte count rides along in the id struct: one pass over the texts
    keyed = ids.select(F.struct("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).alias("id"), "text")
    counted = keyed.mapInArrow(count, f"id struct<id:{kind},n:bigint>, n_tokens long")
    return counted.select(
        F.col("id.id").alias("doc_id"), F.col("id.n").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

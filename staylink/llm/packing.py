"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids plus an end id, cut into pieces only where they are longer
than a sequence. Full pieces are sequences by themselves. The others are dealt evenly
into shards of bounded size; each shard is solved by several islands (own seeds). An
island evolves whole packings: crossover injects well-filled bins of one parent into
the other, removes the bins that now hold a piece twice, and best-fits the displaced
pieces. Between rounds each island's elite packing migrates to the next island of its
shard. Then the poorly filled bins of all shards are pooled and solved once more.
"""

from __future__ import annotations

import random
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import columns, written
from staylink.llm.token_count import ByteLetters, Cutter, special_pattern
from staylink.llm.words import Words, same_bytes, slices

#: Runs and words whose ids one worker remembers; emptied when full. Longer ones than CACHED_BYTES
#: are not kept: some 45 bytes a run and 150 a word, about 40 MB in all.
CACHE, CACHED_WORDS, CACHED_BYTES = 600_000, 60_000, 64


class RunIds:
    """Ids of the runs met so far in numpy arrays, found by hash and then by their bytes: a dictionary
    of bytes objects takes five times the memory, in every worker."""

    def __init__(self):
        self.hash = np.zeros(0, np.int64)  # sorted; of runs with equal hashes the first met is kept
        #: rows start, size (of the run's bytes in `raw`), first, n (of its ids in `ids`)
        self.place = np.zeros((4, 0), np.int32)
        self.raw, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The column of `place` of every run, -1 for those not kept."""
        at = np.searchsorted(self.hash, hashes)
        seen = np.flatnonzero(at < len(self))
        seen = seen[(self.hash[at[seen]] == hashes[seen]) & (self.place[1, at[seen]] == sizes[seen])]
        seen = seen[same_bytes(raw, starts[seen], self.raw, self.place[0, at[seen]].astype(np.int64), sizes[seen])]
        out = np.full(len(hashes), -1)
        out[seen] = at[seen]
        return out

    def keep(self, hashes: np.ndarray, runs: list[bytes], ids: list[bytes]) -> None:
        """Adds runs; forgets all earlier ones when there would be more than CACHE."""
        _, one = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hash, hashes[one])
        new = at == len(self)
        new[~new] = self.hash[at[~new]] != hashes[one[~new]]
        one = one[new]
        if len(self) + len(one) > CACHE:
            self.__init__()
            one = np.unique(hashes, return_index=True)[1][:CACHE]
        raw, flat = (np.frombuffer(b"".join([x[k] for k in one.tolist()]), kind) for x, kind in ((runs, np.uint8), (ids, "<u4")))
        size, n = (np.fromiter((len(x[k]) for k in one.tolist()), np.int64, len(one)) for x in (runs, ids))
        n //= 4
        place = np.array([np.cumsum(size) - size + len(self.raw), size, np.cumsum(n) - n + len(self.ids), n]).astype(np.int32)
        at = np.searchsorted(self.hash, hashes[one])
        self.hash, self.place = np.insert(self.hash, at, hashes[one]), np.insert(self.place, at, place, axis=1)
        self.raw, self.ids = np.concatenate((self.raw, raw)), np.concatenate((self.ids, flat))


class WordIds:
    """Ids of a lower-casing BPE tokenizers file; each different word is merged once."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"]:
            raise ValueError("the word cache is proven for NFC, lower case and one split pattern only")
        self.tokenizer = Tokenizer.from_file(path)
        self.cut = Cutter(steps[0]["pattern"]["Regex"])
        self.letters = ByteLetters()
        self.special = special_pattern(spec["added_tokens"])
        self.ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        #: ids of pre-tokens, and of whole runs between white space, which no pre-token crosses
        self.table: dict[str, bytes] = {}
        self.runs = RunIds()

    def _word(self, word: str) -> bytes:
        if len(self.table) >= CACHED_WORDS:
            self.table.clear()
        found = [t.id for t in self.tokenizer.model.tokenize(self.letters(word))]
        out = pack_numbers(f"<{len(found)}I", *found)
        if len(word) <= CACHED_BYTES:
            self.table[word] = out
        return out

    def _cut(self, text: str) -> bytes:
        return b"".join([self.table.get(w) or self._word(w) for w in self.cut(text)])

    def _folded(self, text: str) -> str:
        if not text.isascii():
            # the library lower-cases character by character: no final-sigma rule
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; special strings are their tokens."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._cut(self._folded(text[at : m.start()])), self.ids[m.group()]]
            at = m.end()
        return b"".join([*out, self._cut(self._folded(text[at:]))])

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """encode of every text: equal runs of a slice (by their bytes) are looked up once, ids gathered in numpy."""
        folded = [self._folded(t) for t in texts]
        alone = [i for i, t in enumerate(folded) if self.cut.odd(t) or any(token in texts[i] for token in self.ids)]
        rest = dict.fromkeys(alone)
        words = Words(pa.array(["" if i in rest else t for i, t in enumerate(folded)], pa.large_string()))
        which, runs = words.distinct()
        raw, size = np.frombuffer(b"".join(runs), np.uint8), np.fromiter(map(len, runs), np.int64, len(runs))
        hashes = np.fromiter(map(hash, runs), np.int64, len(runs))
        known = self.runs.find(hashes, raw, np.cumsum(size) - size, size)
        new = np.flatnonzero(known < 0)
        made = [self._cut(runs[k].decode()) for k in new.tolist()]
        sizes, begin = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        old = np.flatnonzero(known >= 0)
        begin[old], sizes[old] = self.runs.place[2:, known[old]]
        sizes[new] = np.fromiter(map(len, made), np.int64, len(made)) // 4
        begin[new] = np.cumsum(sizes[new]) - sizes[new] + len(self.runs.ids)
        flat = np.concatenate((self.runs.ids, np.frombuffer(b"".join(made), "<u4")))
        short = np.flatnonzero(size[new] <= CACHED_BYTES)
        self.runs.keep(hashes[new[short]], [runs[k] for k in new[short].tolist()], [made[k] for k in short.tolist()])
        total = np.concatenate(([0], np.cumsum(sizes[which])))
        bounds = total[words.first]
        for i in range(len(texts)):
            if i in rest:
                yield self.encode(texts[i])
                continue
            lo, hi = words.first[i], words.first[i + 1]
            own, n = which[lo:hi], bounds[i + 1] - bounds[i]
            at = np.arange(n) + np.repeat(begin[own] - (total[lo:hi] - bounds[i]), sizes[own])
            yield flat[at].tobytes()


@lru_cache(maxsize=2)
def ids_for(path: str) -> WordIds:
    return WordIds(path)


# ---------------------------------------------------------------- genetic algorithm


class Bins:
    """One packing: bins of piece numbers, found by remaining room."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def _list(self, b: int) -> None:
        r = self.room[b]
        self.by_room.setdefault(r, []).append(b)
        self.mask |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        self.items.append(items)
        self.room.append(self.capacity - sum(self.lengths[i] for i in items))
        self._list(len(self.items) - 1)

    def best_fit(self, order: list[int]) -> None:
        """Every piece into the bin with the least room that still holds it, else a new bin."""
        lengths = self.lengths
        for i in order:
            n = lengths[i]
            fits = self.mask >> n
            if not fits:
                self.add_bin([i])
                continue
            r = n + (fits & -fits).bit_length() - 1
            held = self.by_room[r]
            b = held.pop()
            if not held:
                self.mask &= ~(1 << r)
            self.items[b].append(i)
            self.room[b] = r - n
            self._list(b)

    def score(self) -> tuple[int, float]:
        """Fewer bins first, then fuller bins (lower is better)."""
        return len(self.items), -sum((self.capacity - r) ** 2 for r in self.room) / self.capacity**2


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: by volume, and by pieces that cannot share (Martello and Toth)."""
    best = -(-sum(lengths) // capacity)
    values = np.sort(np.asarray(lengths, dtype=np.int64))
    total = np.concatenate(([0], np.cumsum(values)))
    for small in np.unique(values[values <= capacity // 2]).tolist():
        lo, mid, hi = np.searchsorted(values, [small, capacity // 2, capacity - small], side="right")
        lo = int(np.searchsorted(values, small))
        large, middle = len(values) - hi, hi - mid
        free = middle * capacity - int(total[hi] - total[mid])
        rest = int(total[mid] - total[lo]) - free
        best = max(best, int(large + middle + max(0, -(-rest // capacity))))
    return best


def crossover(a: Bins, b: Bins, rng: random.Random, share: float = 0.3) -> Bins:
    """a with some whole well-filled bins of b; displaced pieces go by best fit, longest first."""
    full = sorted(range(len(b.items)), key=b.room.__getitem__)[: max(1, len(b.items) // 2)]
    chosen = rng.sample(full, max(1, int(len(full) * share)))
    injected = {i for k in chosen for i in b.items[k]}
    child = Bins(a.lengths, a.capacity)
    displaced: list[int] = []
    for items in a.items:
        if injected.isdisjoint(items):
            child.add_bin(list(items))
        else:
            displaced += [i for i in items if i not in injected]
    for k in chosen:
        child.add_bin(list(b.items[k]))
    child.best_fit(sorted(displaced, key=a.lengths.__getitem__, reverse=True))
    return child


def mutated(a: Bins, rng: random.Random) -> Bins:
    """a without its emptiest bins and a few others, whose pieces go in again by best fit."""
    order = sorted(range(len(a.items)), key=a.room.__getitem__, reverse=True)
    gone = set(order[: max(2, len(order) // 50)]) | set(rng.sample(order, min(len(order), 3)))
    child = Bins(a.lengths, a.capacity)
    for k, items in enumerate(a.items):
        if k not in gone:
            child.add_bin(list(items))
    loose = [i for k in gone for i in a.items[k]]
    child.best_fit(sorted(loose, key=lambda i: a.lengths[i] * rng.uniform(0.9, 1.1), reverse=True))
    return child


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[int]], generations: int, population: int) -> list[int]:
    """The bin number of every piece in the best packing found. elites: migrants as such lists."""
    rng = random.Random(seed)
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    people: list[Bins] = []
    for elite in elites:
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(elite):
            groups.setdefault(b, []).append(i)
        one = Bins(lengths, capacity)
        for items in groups.values():
            one.add_bin(items)
        people.append(one)
    if not people:
        one = Bins(lengths, capacity)
        one.best_fit(order)
        people.append(one)
    least = lower_bound(lengths, capacity)
    best = min(people, key=Bins.score)
    while len(people) < population and len(best.items) > least:
        one = Bins(lengths, capacity)
        one.best_fit(sorted(order, key=lambda i: lengths[i] * rng.uniform(0.8, 1.2), reverse=True))
        people.append(one)
    for _ in range(generations):
        people.sort(key=Bins.score)
        best = people[0]
        if len(best.items) <= least:
            break
        a, b = rng.sample(people[: max(2, population // 2 + 1)], 2) if len(people) > 1 else (best, best)
        child = crossover(a, b, rng) if rng.random() < 0.7 else mutated(a, rng)
        if child.score() < people[-1].score():
            people[-1] = child
    best = min(people, key=Bins.score)
    out = [0] * len(lengths)
    for b, items in enumerate(best.items):
        for i in items:
            out[i] = b
    return out


# ---------------------------------------------------------------- Spark


def tokenize(docs: DataFrame, path: str, capacity: int, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every row.

    A null text is the empty text: one piece, the end id alone. Only rows of more than
    capacity ids are cut.
    """
    ids = columns(docs, doc_id=id_col, text=text_col)
    kind = ids.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ids_for(path)
        for batch in batches:
            for part in slices(batch, "text"):
                row, piece, start, length, crc, body = [], [], [], [], [], []
                for i, body_ids in enumerate(model.encode_all(pc.fill_null(part.column("text"), "").to_pylist())):
                    data = body_ids + end
                    for k, at in enumerate(range(0, len(data), step)):
                        own = data[at : at + step]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            body.append(own)
                out = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array(body, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return ids.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def _solved(items: DataFrame, capacity: int, islands: int, rounds: int, generations: int, population: int, per_shard: int, name: str) -> DataFrame:
    """(key, bin) of the items (key, length): bins numbered within shards, as shard * 2**32 + bin.

    Shards are dealt by a hash of the unique key, so they hold about per_shard items
    however the input is skewed.
    """
    n = items.count()
    shards = max(1, -(-n // per_shard))
    dealt = written(items.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), name + "-shards")
    copies = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elites = None

    def island_for(turn: int):
        def island(table: pa.Table) -> pa.Table:
            table = table.sort_by("key")
            lengths = table.column("length").to_pylist()
            shard, number = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
            own = [table.column(c).to_pylist() for c in table.column_names if c.startswith("elite")]
            bins = evolve(lengths, capacity, shard * 1000 + number * 100 + turn, own, generations, population)
            return pa.table({"shard": table.column("shard"), "island": table.column("island"), "key": table.column("key"), "length": table.column("length"), "bin": pa.array(bins, pa.int64())})

        return island

    for turn in range(rounds):
        state = copies
        if elites is not None:  # migration: the elite of island i goes to island i + 1 of its shard
            moved = elites.select("key", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bin").alias("elite_in"))
            state = elites.withColumnRenamed("bin", "elite_own").join(moved, ["key", "island"]).select("key", "length", "shard", "island", "elite_own", "elite_in")
        elites = written(state.groupBy("shard", "island").applyInArrow(island_for(turn), "shard long, island int, key long, length long, bin long"), name + "-elites")
    sizes = elites.groupBy("shard", "island").agg(F.countDistinct("bin").alias("bins"))
    best = sizes.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    return elites.join(best, ["shard", "island"]).select("key", "length", (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin"))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, islands: int = 2, rounds: int = 2, generations: int = 24, population: int = 6, per_shard: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and gapless offset there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    keep_ids the ids (little-endian unsigned 32-bit). Repeated rows and null ids are
    packed as rows of their own; empty and null texts are one piece of the end id; an
    empty table gives an empty table.
    """
    pieces = written(tokenize(docs, path, capacity, end_id, keep_ids, id_col, text_col), "pieces").withColumn("key", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    open_ = pieces.filter(F.col("length") < capacity).select("key", "length")
    options = dict(capacity=capacity, islands=islands, rounds=rounds, generations=generations, population=population, per_shard=per_shard)
    first = written(_solved(open_, **options, name="first"), "packed")
    fill = first.groupBy("bin").agg(F.sum("length").alias("used"))
    poor = fill.filter(F.col("used") < int(capacity * 0.95)).select("bin")
    again = _solved(first.join(poor, "bin", "left_semi").select("key", "length"), **options, name="second")
    # ids: full pieces 3 * key, first solution 3 * rank + 1, second 3 * rank + 2 - any distinct numbers do
    placed = (
        first.join(poor, "bin", "left_anti").select("key", "length", (F.col("bin") * 2).alias("sequence_id"))
        .unionByName(again.select("key", "length", (F.col("bin") * 2 + 1).alias("sequence_id")))
    )
    running = placed.withColumn("offset", F.expr("sum(length) over (partition by sequence_id order by key rows between unbounded preceding and current row) - length"))
    out = pieces.join(running.select("key", "sequence_id", "offset"), "key", "left")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", -1 - F.col("key")).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

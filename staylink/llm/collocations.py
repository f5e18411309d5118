"""Phrase collocations by best-first branch-and-bound growth.

A phrase of two to four words scores its worst cut: a / (l + r), with a its own count and l, r
those of the two parts. A prefix x bounds all phrases that begin with it: they occur at most
f(x) times, and the part behind a cut at least as often as the phrase, so no cut within x gives
more than f(x) / (f(first part) + f(x)). The best phrases are therefore found without counting
most long ones:

1. Words, then pairs of words that are frequent themselves, are counted in two passes.
2. Each language has a threshold, at first a score that a few times `top` of its pairs reach.
   The frontier holds the prefixes whose bound reaches it, best first in the sense that no
   prefix below the threshold is grown before the ones above are settled.
3. One pass grows the frontier's pairs to three words, one those of its triples to four. The
   passes also count the phrases that may drop a scoring one (a word longer on either side).
4. A language is settled when `top` phrases above its threshold survive: whatever was not
   grown scores less. The others go on with a lower threshold; at zero nothing is left out.

Phrases are tuples of word ids, 64-bit hashes of language and word that a pass over all different
words has proven free of collisions (else the words are numbered with another seed), so counts are
exact. Tasks learn the frontier from bitmaps of bounded size; a phrase that passes by mistake is
counted too, and its count is as exact as any. Each task counts the phrases of a slice before
they are shuffled: a phrase in every document is one row for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylink.llm.shared import Tables, columns, written
from staylink.llm.words import U64, Words, mix, signed, slices

#: Occurrences of a candidate, phrases of a language, percent of its occurrences at which a longer phrase drops one.
LEAST, TOP, PERCENT = 30, 2000, 80
#: The first threshold is a score that so many times `top` pairs reach; each further round takes WIDER times as many.
FIRST, WIDER = 4, 8
#: Bits of a frontier bitmap for each phrase, and at most (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True


class Stream:
    """The words of a slice as ids, and which phrases lie inside one piece of one text."""

    def __init__(self, part: pa.RecordBatch, seed: int, dropped_bits: int = 0):
        self.lang = part.column("lang")
        self.words = Words(part.column("text"), _SEPARATORS, lower=True)
        doc = self.words.doc
        names = Words(self.lang, np.zeros(256, bool))
        mark = np.zeros(len(self.lang), np.uint64)
        mark[names.counts > 0] = names.hashes()
        self.ids = mix(self.words.hashes(U64(seed)) ^ mark[doc]) >> U64(dropped_bits)
        broken = np.concatenate(([0], np.cumsum(_BREAKS[self.words.raw])))
        n = len(self.ids)
        self.joined = np.zeros(max(0, n), bool)  # this word and the next are neighbours in a piece
        if n > 1:
            self.joined[:-1] = (doc[1:] == doc[:-1]) & (broken[self.words.starts[1:]] == broken[self.words.ends[:-1]])

    def runs(self, k: int) -> np.ndarray:
        """Whether a phrase of k words starts at each word."""
        out = np.ones(len(self.ids), bool)
        for j in range(k - 1):
            out[: len(out) - j] &= self.joined[j:]
            out[len(out) - j :] = False
        return out


def grouped(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first position, count) of every different row of the columns."""
    code = np.zeros(len(parts[0]), np.int64)
    for p in parts:
        _, dense = np.unique(p, return_inverse=True)
        _, code = np.unique(code * (int(dense.max(initial=0)) + 1) + dense, return_inverse=True)
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return first, count


def phrase_key(parts: list[np.ndarray]) -> np.ndarray:
    """One number for each phrase, for bitmaps only."""
    key = parts[0]
    for p in parts[1:]:
        key = mix(key * U64(0x9E3779B97F4A7C15) + p)
    return key


@dataclass
class Bitmap:
    """A set of phrases with false members: two bits for each, in at most MOST_BITS."""

    words: np.ndarray  # 32-bit

    @staticmethod
    def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple((k & U64(bits - 1)).astype(np.int64) for k in (mix(key), mix(key ^ U64(0xD1B54A32D192ED03))))

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for at in self.places(key, len(self.words) * 32):
            out &= (self.words[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
        return out


def bitmap_of(phrases: DataFrame, names: list[str]) -> Bitmap:
    """The bitmap of the phrases in the named id columns: set in the tasks, combined word by word."""
    wanted = BITS_EACH * max(1, phrases.count())
    bits = min(MOST_BITS, 1 << max(10, (wanted - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = phrase_key([np.asarray(c, dtype=np.int64).view(np.uint64) for c in batch.columns])
            at = np.unique(np.concatenate(Bitmap.places(key, bits)))
            if len(at):
                slot, first = np.unique(at >> 5, return_index=True)
                word = np.bitwise_or.reduceat(np.int64(1) << (at & 31), first)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word)], ["slot", "word"])

    rows = phrases.select(*names).mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word"))
    table = rows.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[np.asarray(table.column("slot"), dtype=np.int64)] = np.asarray(table.column("word"), dtype=np.int64).astype(np.uint32)
    return Bitmap(out)


def _strings(words: Words, at: np.ndarray) -> pa.Array:
    """The words at these positions as strings."""
    size = words.ends[at] - words.starts[at]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    flat = np.arange(int(offsets[-1])) + np.repeat(words.starts[at] - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(words.raw[flat].tobytes())).cast(pa.string())


def _score(a: str, left: str, right: str) -> str:
    """SQL of floor(2000000 a / (l + r)), exact beyond 64 bits."""
    return f"(cast({a} as decimal(20,0)) * 2000000) div cast({left} + {right} as decimal(20,0))"


def _worst(*cuts: tuple[str, str]):
    """The lowest-scoring cut of a phrase: (score, k, l, r), the smallest k of equal scores."""
    options = ", ".join(f"named_struct('score', {_score('a', lo, hi)}, 'k', {k}, 'l', {lo}, 'r', {hi})" for k, (lo, hi) in enumerate(cuts, 1))
    return F.expr(f"array_min(array({options}))")


def _bound(*prefixes: str):
    """No phrase that begins with this one scores more: the least over the cuts inside it."""
    options = ", ".join(_score("a", p, "a") for p in prefixes)
    return F.expr(f"array_min(array({options}))")


class Miner:
    """Counts and rounds over one corpus of (lang, text)."""

    def __init__(self, docs: DataFrame, least: int, top: int, percent: int, dropped_bits: int = 0):
        self.spark, self.docs = docs.sparkSession, docs
        self.least, self.top, self.percent = least, top, percent
        self.tables = Tables(self.spark)
        self.seed, self.dropped_bits = 1, dropped_bits

    def counted(self, docs: DataFrame, size: int, select, optional: int = 0) -> DataFrame:
        """(w1, .., w{size}, a) of the phrases that select(stream) names: pairs of a start mask and a
        number of words; shorter phrases have null last words."""
        seed, dropped = self.seed, self.dropped_bits
        names = [f"w{k}" for k in range(1, size + 1)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    stream = Stream(part, seed, dropped)
                    for mask, k in select(stream):
                        at = np.flatnonzero(mask)
                        if not len(at):
                            continue
                        ids = [stream.ids[at + j] for j in range(k)]
                        first, n = grouped(ids)
                        out = [pa.array(signed(i[first])) for i in ids]
                        out += [pa.nulls(len(first), pa.int64())] * (size - k)
                        yield pa.RecordBatch.from_arrays([*out, pa.array(n)], [*names, "n"])

        rows = docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
        return rows.groupBy(*names).agg(F.sum("n").alias("a"))

    def words(self) -> DataFrame:
        """(w, lang, word, f) of every word; the seed changes until no two words share an id."""
        for seed in range(1, 100):
            self.seed = seed
            dropped = self.dropped_bits

            def run(batches: Iterator[pa.RecordBatch], seed: int = seed, dropped: int = dropped) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in slices(batch, "text"):
                        s = Stream(part, seed, dropped)
                        # by id and a second hash, so that two words of one id stay two rows
                        first, n = grouped([s.ids, s.words.hashes(U64(seed + 1000))])
                        lang = s.lang.take(pa.array(s.words.doc[first])) if len(first) else s.lang.slice(0, 0)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(s.ids[first])), lang, _strings(s.words, first), pa.array(n)], ["w", "lang", "word", "n"])

            rows = self.docs.mapInArrow(run, "w long, lang string, word string, n long")
            out = self.tables.written(rows.groupBy("w", "lang", "word").agg(F.sum("n").alias("f")), "words")
            if out.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
                return out
            self.dropped_bits = 0
        raise RuntimeError("no seed gives every word its own id")

    def run(self) -> DataFrame:
        least = self.least
        every = self.words()
        total = every.groupBy("lang").agg(F.sum("f").alias("n"))
        word = every.filter(F.col("f") >= least)
        known = self.spark.sparkContext.broadcast(bitmap_of(word, ["w"]).words)

        def pairs_of(s: Stream):
            often = Bitmap(known.value).has(s.ids)
            mask = s.runs(2) & often
            mask[:-1] &= often[1:]
            yield mask, 2

        pairs = self.counted(self.docs, 2, pairs_of).filter(F.col("a") >= least)
        pairs = pairs.join(word.select(F.col("w").alias("w1"), "lang", F.col("f").alias("f1")), "w1").join(word.select(F.col("w").alias("w2"), F.col("f").alias("f2")), "w2")
        pairs = self.tables.written(pairs.select("lang", "w1", "w2", "a", "f1", "f2", _worst(("f1", "f2")).alias("cut"), _bound("f1").alias("bound")), "pairs")
        known_pairs = self.spark.sparkContext.broadcast(bitmap_of(pairs, ["w1", "w2"]).words)

        found, open_langs, reach = [], pairs.select("lang").distinct(), FIRST * self.top
        while True:
            limits = self.tables.written(self.thresholds(pairs.join(open_langs, "lang", "left_semi"), reach), "limits")
            if limits.isEmpty():
                break
            alive = self.tables.written(self.survivors(pairs, limits, known_pairs), "alive")
            size = alive.groupBy("lang").agg(F.count("*").alias("size"))
            state = limits.join(size, "lang", "left")
            done = state.filter((F.col("limit") == 0) | (F.coalesce("size", F.lit(0)) >= self.top))
            found.append(alive.join(done.select("lang"), "lang", "left_semi"))
            open_langs = self.tables.written(state.join(done.select("lang"), "lang", "left_anti").select("lang"), "open")
            if open_langs.isEmpty():
                break
            reach *= WIDER
        return written(self.ranked(found, word, total), "collocations")

    def thresholds(self, pairs: DataFrame, reach: int) -> DataFrame:
        """(lang, limit): a score that at least `reach` pairs of the language have, else 0; by classes
        of 1000, so that a language has at most 1001 rows in the window."""
        classes = pairs.groupBy("lang", F.expr("cut.score div 1000").alias("class")).agg(F.count("*").alias("c"))
        above = Window.partitionBy("lang").orderBy(F.desc("class"))
        reached = classes.withColumn("c", F.sum("c").over(above))
        return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("c") >= reach, F.col("class") * 1000)), F.lit(0)).alias("limit"))

    def survivors(self, pairs: DataFrame, limits: DataFrame, known_pairs) -> DataFrame:
        """(lang, w1..w4, a, l, r, score): all phrases that reach their language's limit and are not dropped."""
        share = self.spark.sparkContext.broadcast
        docs = self.docs.join(limits.select("lang"), "lang", "left_semi").select("lang", "text")
        mine = pairs.join(limits, "lang")
        grow = mine.filter("bound >= limit")
        score2 = self.tables.written(mine.filter("cut.score >= limit"), "scoring-pairs")
        front, scoring = share(bitmap_of(grow, ["w1", "w2"]).words), share(bitmap_of(score2, ["w1", "w2"]).words)

        def pair_marks(s: Stream):
            """Phrases of three words of frequent pairs, and those that the first pass counts."""
            key = phrase_key([s.ids, np.roll(s.ids, -1)])
            often = s.runs(2) & Bitmap(known_pairs.value).has(key)
            three = s.runs(3) & often
            three[:-1] &= often[1:]
            wanted = Bitmap(front.value).has(key)
            wanted[:-1] |= Bitmap(scoring.value).has(key[1:])
            return key, three, three & wanted

        triples = self.counted(docs, 3, lambda s: [(pair_marks(s)[2], 3)]).filter(F.col("a") >= self.least)
        head = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), "f1", "f2")
        tail = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
        triples = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).join(limits, "lang")
        triples = triples.withColumn("cut", _worst(("f1", "f23"), ("f12", "f3"))).withColumn("bound", _bound("f1", "f12"))
        triples = self.tables.written(triples, "triples")
        grow3, score3 = triples.filter("bound >= limit"), triples.filter("cut.score >= limit")
        front3, scoring3 = share(bitmap_of(grow3, ["w1", "w2", "w3"]).words), share(bitmap_of(score3, ["w1", "w2", "w3"]).words)
        ends = share(bitmap_of(grow3, ["w2", "w3"]).words)

        def longer(s: Stream):
            """Phrases of four words; and the three-word ends of those that the pass before left out."""
            key, three, counted = pair_marks(s)
            key3 = phrase_key([key, np.roll(s.ids, -2)])
            wanted = Bitmap(front3.value).has(key3)
            wanted[:-1] |= Bitmap(scoring3.value).has(key3[1:])
            four = s.runs(4) & three & wanted
            four[:-1] &= three[1:]
            yield four, 4
            yield three & ~counted & Bitmap(ends.value).has(key), 3

        rest = self.tables.written(self.counted(docs, 4, longer).filter(F.col("a") >= self.least), "longer")
        quads = rest.filter("w4 is not null")
        three = triples.select("w1", "w2", "w3", "a").unionByName(rest.filter("w4 is null").select("w1", "w2", "w3", "a"))
        head = triples.select("lang", "limit", "w1", "w2", "w3", "f1", "f12", F.col("a").alias("f123"))
        tail = three.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("a").alias("f234"))
        back = pairs.select(F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("a").alias("f34"), F.col("f2").alias("f4"))
        scored = quads.join(head, ["w1", "w2", "w3"]).join(tail, ["w2", "w3", "w4"]).join(back, ["w3", "w4"])
        scored = scored.withColumn("cut", _worst(("f1", "f234"), ("f12", "f34"), ("f123", "f4"))).filter("cut.score >= limit")

        def kept(phrases: DataFrame, names: list[str], longer_ones: list[DataFrame]) -> DataFrame:
            """Without those that a one word longer phrase nearly always surrounds (one of two words
            more implies one of one word more, which occurs as often at least)."""
            most = longer_ones[0].unionByName(longer_ones[1]).groupBy(*names).agg(F.max("b").alias("b"))
            joined = phrases.join(most, names, "left")
            return joined.filter(f"b is null or cast(b as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {self.percent}")

        b = F.col("a").alias("b")
        pairs_kept = kept(score2, ["w1", "w2"], [triples.select("w1", "w2", b), triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), b)])
        triples_kept = kept(score3, ["w1", "w2", "w3"], [quads.select("w1", "w2", "w3", b), quads.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), b)])
        none = F.lit(None).cast("long")
        out = [pairs_kept.withColumns({"w3": none, "w4": none}), triples_kept.withColumn("w4", none), scored]
        out = [d.select("lang", "w1", "w2", "w3", "w4", "a", "cut.l", "cut.r", "cut.score") for d in out]
        return out[0].unionByName(out[1]).unionByName(out[2])

    def ranked(self, found: list[DataFrame], word: DataFrame, total: DataFrame) -> DataFrame:
        empty = "lang string, w1 long, w2 long, w3 long, w4 long, a long, l long, r long, score long"
        rows = self.spark.createDataFrame([], empty)
        for part in found:
            rows = rows.unionByName(part)
        for k in range(1, 5):
            rows = rows.join(word.select(F.col("w").alias(f"w{k}"), F.col("word").alias(f"t{k}")), f"w{k}", "left")
        rows = rows.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3", "t4"))
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        rows = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= self.top)
        return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = PERCENT, lang_col: str = "lang", text_col: str = "text", dropped_bits: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words.

    Texts are lower-cased (A-Z), cut at . , ; : ! ? and line ends, and split at spaces and tabs.
    A phrase counts with `least` occurrences or more; it scores the lowest of floor(2000000 a / (l + r))
    over its cuts; it goes if a longer phrase holds it in `percent` percent of its occurrences or more.
    A null language is `und`, a null text empty; equal rows count as often as they stand; an empty
    table, or one without a frequent phrase, gives no rows. Other columns are never read.
    `dropped_bits` shortens the first seed's ids, for tests of the collision check.
    """
    own = columns(docs, lang=lang_col, text=text_col)
    own = own.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    miner = Miner(own, least, top, percent, dropped_bits)
    try:
        return miner.run()
    finally:
        miner.tables.drop()


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w
  from documents
), g as materialized (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') p, count(*) f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from pieces, (select unnest([1, 2, 3, 4]) k) where len(w) >= k) group by all
), c as materialized (
  select lang, k, p, f a, string_split(p, ' ') w from g where k > 1 and f >= {LEAST}
), cuts as (
  select c.lang, c.p, c.a, x, array_to_string(w[1:x], ' ') p1, array_to_string(w[x + 1:], ' ') p2 from c, (select unnest([1, 2, 3]) x) where x < k
), scored as (
  select cuts.lang, cuts.p, a, x, l.f l, r.f r, cast((2000000::hugeint * a) // (l.f + r.f) as bigint) score
  from cuts join g l on l.lang = cuts.lang and l.p = p1 join g r on r.lang = cuts.lang and r.p = p2
), worst as (
  select * from scored qualify row_number() over (partition by lang, p order by score, x) = 1
), dropped as (
  select distinct s.lang, s.p from (
    select lang, a b, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, k - m + 2)]) p from (select *, unnest(range(2, k)) m from c)
  ) s join c on c.lang = s.lang and c.p = s.p where 100::hugeint * b >= {PERCENT} * a
), total as (
  select lang, cast(sum(f) as bigint) n from g where k = 1 group by lang
)
select lang, row_number() over (partition by lang order by score desc, a desc, p) as rank, p phrase, a, l, r, n, score
from worst anti join dropped using (lang, p) join total using (lang)
qualify row_number() over (partition by lang order by score desc, a desc, p) <= {TOP}
"""

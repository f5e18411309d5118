"""Line dedup by a segment-partition edit join.

A line is removed if an equal line, or one within a few edits, stands earlier in the
corpus (smaller document id, or the same document and an earlier line). A line of length l
is split into tau + 1 segments; by the pigeonhole principle a line within tau edits holds
one of them unchanged, near the same place. So each different line files its segments
under (length, segment number), and probes with its own substrings at the few positions
and lengths that can match. Lines that meet are verified with a banded bit-parallel edit
distance, many pairs at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import runs, written
from staylink.llm.words import _ODD, _ODD2, U64, RangeHashes, mix, signed, slices, spans_hash

#: Edits that still make two lines copies, and the characters of the shortest line that counts.
TAU, MIN_CHARS = 2, 24
#: Bytes of text that one numpy step takes; code points and their hashes need twelve times as many.
SLICE = 1 << 20
#: Lines of one segment that a task compares with as many others.
CHUNK = 512
#: Lines of a group whose pairs are all collected, and code points of the pairs that one step compares.
SMALL, STEP = 96, 1 << 18
#: Code points after which pairs that have grown too different drop out, and pairs of a round in larger groups.
BLOCK, ROUND = 16, 4096

#: mix(c + 1) of the code points of the basic plane (512 KB).
_POINT = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


class Lines:
    """The lines of a slice of texts as spans of code points."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(self.points == 10)
        self.starts = np.concatenate(([0], breaks + 1))
        self.ends = np.append(breaks, len(self.points))
        counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.starts)) - self.first[self.doc]
        if len(self.points) and self.points.max() >> 16:
            self.values = mix(self.points.astype(np.uint64) + U64(1))
        else:
            self.values = _POINT[self.points]

    def long(self, least: int) -> np.ndarray:
        return np.flatnonzero(self.ends - self.starts >= least)

    def hashes(self, at: np.ndarray, salt=_ODD) -> np.ndarray:
        return spans_hash(self.values, self.starts[at], self.ends[at], None, salt)

    def text(self, i: int) -> str:
        return self.points[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass")


def segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i (from 0) of lines of these lengths; the later ones are longer by one."""
    size, more = length // (tau + 1), length % (tau + 1)
    short = tau + 1 - more
    return i * size + np.maximum(0, i - short), size + (i >= short)


def signatures(lines: Lines, at: np.ndarray, tau: int, probe: bool | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of at, key, is probe): the filed segments, then the probes of equal and shorter
    lengths; with probe, only those or only the others.

    A probe at a segment's own place in a line of equal length is the filed key itself, so
    it is left out. Probe positions follow the multi-match-aware selection of segment joins.
    """
    start, length = lines.starts[at], lines.ends[at] - lines.starts[at]
    ranges = RangeHashes(lines.values, _ODD)

    def key(begin: np.ndarray, size: np.ndarray, indexed: np.ndarray, i: int) -> np.ndarray:
        return mix(ranges.of(begin, begin + size) ^ (indexed * (tau + 1) + i).astype(np.uint64) * _ODD2)

    every = np.arange(len(at))
    for i in range(tau + 1) if not probe else ():
        p, size = segment(length, i, tau)
        yield every, key(start + p, size, length, i), False
    for delta in range(tau + 1) if probe in (None, True) else ():
        indexed = length - delta
        for i in range(tau + 1):
            p, size = segment(indexed, i, tau)
            for shift in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
                if delta == 0 and shift == 0:
                    continue
                begin = p + shift
                where = np.flatnonzero((begin >= 0) & (begin + size <= length) & (indexed > tau))
                yield where, key(start[where] + begin[where], size[where], indexed[where], i), True


def within(a: list[np.ndarray], b: list[np.ndarray], tau: int) -> np.ndarray:
    """Whether each pair of code point arrays is within tau edits.

    Bit d of row e says: the first i points of a reach the first i + d - tau points of b
    with e errors. Only the band of 2 tau + 1 diagonals is kept, so a row is a small
    integer, and all pairs step together. Pairs that can no longer be within tau edits
    drop out after every block of BLOCK points, so unlike lines cost their beginnings only.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.abs(n - m) <= tau
    at = np.flatnonzero(out)
    if not len(at):
        return out
    n, m = n[at], m[at]
    outside = np.full(1, 0xFFFFFFFF, np.uint32)  # equals no code point
    left, right = np.concatenate([*(a[i] for i in at), outside]), np.concatenate([*(b[i] for i in at), outside])
    left_at, right_at = np.cumsum(n) - n, np.cumsum(m) - m
    full = np.uint16((1 << (2 * tau + 1)) - 1)
    rows = np.array([[((1 << (e + 1)) - 1) << tau & int(full)] for e in range(tau + 1)], np.uint16).repeat(len(at), axis=1)
    good, open_, lo = np.zeros(len(at), bool), np.arange(len(at)), 0
    while True:
        ended = n[open_] == lo
        now = open_[ended]
        good[now] = (rows[tau][ended] >> (m[now] - lo + tau).astype(np.uint16)) & np.uint16(1)
        stay = ~ended & (rows[tau] > 0)
        open_, rows = open_[stay], rows[:, stay]
        if not len(open_):
            break
        hi = min(lo + BLOCK, int(n[open_].min()))
        place = np.arange(lo - tau, hi + tau)
        valid = (place >= 0) & (place < m[open_][:, None])
        other = right[np.where(valid, right_at[open_][:, None] + place, len(right) - 1)]
        own = left[left_at[open_][:, None] + np.arange(lo, hi)]
        match = np.zeros((hi - lo, len(open_)), np.uint16)
        for d in range(2 * tau + 1):
            match |= (own == other[:, d : d + hi - lo]).T.astype(np.uint16) << np.uint16(d)
        rows = list(rows)
        for step in match:
            new = [rows[0] & step]
            for e in range(1, tau + 1):
                before = rows[e - 1]
                new.append(((rows[e] & step) | before | (before >> np.uint16(1)) | (new[e - 1] << np.uint16(1))) & full)
            rows = new
        rows, lo = np.array(rows), hi
    out[at] = good
    return out


def repeated_later(lines: list[np.ndarray], rank: np.ndarray, filed: np.ndarray, left: np.ndarray, right: np.ndarray, tau: int) -> np.ndarray:
    """Positions of `right` lines that an earlier line of `left`, or of `left` lines that an
    earlier line of `right`, repeats. The earliest lines are compared first, in rounds of twice as
    many up to ROUND pairs; lines found drop out, so a large family costs few rounds."""
    found = np.zeros(len(lines), bool)
    order = np.argsort(rank)
    for side, other in ((left, right), (right, left)) if not np.array_equal(left, right) else ((left, left),):
        is_side, is_other = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
        is_side[side], is_other[other] = True, True
        waiting, earlier = order[is_side[order]], order[is_other[order]]
        lo, many = 0, 1
        while lo < len(earlier):
            waiting, some = waiting[~found[waiting]], earlier[lo : lo + many]
            a, b = np.nonzero((rank[waiting] > rank[some][:, None]) & (filed[waiting] | filed[some][:, None]))
            pairs = Pairs(tau)
            for i, j in zip(some[a].tolist(), waiting[b].tolist(), strict=True):
                pairs.put(lines[i], lines[j], j)
            found[pairs.found()] = True
            lo += many
            many = max(1, min(2 * many, ROUND // max(1, len(waiting))))
    return np.flatnonzero(found)


class Pairs:
    """Pairs of lines of many small groups, compared together."""

    def __init__(self, tau: int):
        self.tau, self.size = tau, 0
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.later: list[int] = []

    def add(self, lines: list[np.ndarray], filed: list[bool], h: list[int]) -> None:
        """All pairs of a group in order of rank of which a line is filed and the lengths are near."""
        for j in range(1, len(lines)):
            for i in range(j):
                if filed[i] or filed[j]:
                    self.put(lines[i], lines[j], h[j])

    def put(self, left: np.ndarray, right: np.ndarray, later: int) -> None:
        """A pair, if the lengths are near."""
        if abs(len(left) - len(right)) <= self.tau:
            self.left.append(left)
            self.right.append(right)
            self.later.append(later)
            self.size += len(left)

    def found(self) -> np.ndarray:
        """The later lines of the pairs within tau edits; the pairs are forgotten. Pairs of like
        length go together, so that a step is hardly larger than its lines."""
        size = np.array([len(x) for x in self.left], np.int64)
        order, out, lo = np.argsort(size, kind="stable"), [], 0
        while lo < len(order):
            wide = size[order[lo:]] * np.arange(1, len(order) - lo + 1)  # this step's matrix, were each its last
            hi = lo + max(1, int(np.searchsorted(wide, STEP, "right")))
            part = order[lo:hi].tolist()
            good = within([self.left[k] for k in part], [self.right[k] for k in part], self.tau)
            out += [self.later[k] for k, g in zip(part, good.tolist(), strict=True) if g]
            lo = hi
        self.__init__(self.tau)
        return np.unique(np.array(out, np.int64))


def _spread(rows: DataFrame, group: str, item: str, chunk: int) -> DataFrame:
    """rows with i, j, side: every pair of chunks of a group's rows is a block of its own."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / chunk).cast("int").alias("m"))
    dealt = rows.join(sizes, group).withColumn("c", F.pmod(F.xxhash64(item), F.col("m")).cast("int"))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0, m - 1)")).alias("o"))
    return dealt.select(*rows.columns, F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"))


def removed_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, chunk: int = CHUNK, short: bool = False) -> DataFrame:
    """docs (doc_id, t, text), t a hash of the text, to (doc_id, t, gone): the numbers (from 0) of the lines to remove.

    short: non-empty lines of fewer than min_chars characters are grouped too, by equality alone.
    """
    docs = docs.filter("doc_id is not null and text is not null")

    def mapped(schema: str, emit) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    lines = Lines(part.column("text").to_pylist())
                    yield from emit(part.select(["doc_id", "t"]), lines)

        return docs.mapInArrow(run, schema)

    names = [f"s{i}" for i in range(tau + 1)]

    def places(ids, lines):
        at = lines.long(1 if short else min_chars)
        where, h = pa.array(lines.doc[at]), lines.hashes(at)
        enough = np.flatnonzero(lines.ends[at] - lines.starts[at] >= min_chars)
        one = enough[np.unique(h[enough], return_index=True)[1]]  # a line that repeats in the slice signs once
        unsigned = np.ones(len(at), bool)
        unsigned[one] = False
        filed = []
        for _, key, _ in signatures(lines, at[one], tau, probe=False):
            column = np.zeros(len(at), np.uint64)
            column[one] = key
            filed.append(pa.array(signed(column), mask=unsigned))
        yield pa.RecordBatch.from_arrays([*ids.take(where).columns, pa.array(lines.number[at].astype(np.int32)), pa.array(signed(h)), pa.array(signed(lines.hashes(at, _ODD2))), *filed], ["doc_id", "t", "no", "h", "h2", *names])

    def probing(ids, lines):
        at = lines.long(min_chars)
        h = lines.hashes(at)
        _, one = np.unique(h, return_index=True)
        at, h = at[one], h[one]
        for where, key, _ in signatures(lines, at, tau, probe=True):
            if len(where):
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(h[where]))], ["sig", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spots = written(mapped(f"doc_id {kind}, t long, no int, h long, h2 long, " + ", ".join(f"{n} long" for n in names), places), "lines")
    first = written(spots.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "t", "no")).alias("first")), "first")
    filed = spots.filter("s0 is not null").select(F.explode(F.array(*names)).alias("sig"), "h")
    groups = written(filed.groupBy("sig").agg(F.min("h").alias("x"), F.max("h").alias("y")), "segments")
    probes = mapped("sig long, h long", probing).join(groups.select("sig"), "sig", "left_semi").distinct()
    probes = written(probes, "probes")
    wanted = groups.filter("x < y").select("sig").union(probes.select("sig")).distinct()
    met = filed.join(wanted, "sig", "left_semi").distinct().select("sig", "h", F.lit(True).alias("filed")).unionByName(probes.select("sig", "h", F.lit(False).alias("filed")))
    met = written(met.groupBy("sig", "h").agg(F.max("filed").alias("filed")), "met")
    # the texts of the lines that met, each from its first place
    owners = first.groupBy("h").agg(F.min("first").alias("first")).join(met.select("h").distinct(), "h", "left_semi")
    spots_of = owners.groupBy("first.doc_id", "first.t").agg(F.collect_list(F.struct("first.no", "h")).alias("own"))
    texts = docs.join(spots_of, ["doc_id", "t"]).select("doc_id", "t", "text", F.col("own.no").alias("no"), F.col("own.h").alias("h"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows: list[tuple] = []
                for i, (text, numbers, hashes) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "no", "h")), strict=True)):
                    split = text.split("\n")
                    rows += [(i, n, h, split[n]) for n, h in zip(numbers, hashes, strict=True) if n < len(split)]
                if rows:
                    where, no, h, line = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(where)), part.column("t").take(pa.array(where)), pa.array(no, pa.int32()), pa.array(h, pa.int64()), pa.array(line, pa.string())], ["doc_id", "t", "no", "h", "line"])

    lines = written(texts.mapInArrow(read, f"doc_id {kind}, t long, no int, h long, line string").dropDuplicates(["h"]), "texts")
    blocks = _spread(met, "sig", "h", chunk).join(lines, "h")
    order = ["sig", "i", "j"]
    blocks = blocks.repartition(*order).sortWithinPartitions(*order, "doc_id", "t", "no")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(tau)
        for table in runs(batches, order):
            if len(table) < 2:
                continue
            points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in table.column("line").to_pylist()]
            whole = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            # rows come in order of their first places
            if whole and len(points) <= SMALL:
                pairs.add(points, table.column("filed").to_pylist(), table.column("h").to_pylist())
                if len(pairs.later) >= 4096 or pairs.size >= 8 * STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs.found())], ["h"])
                continue
            side, filed_ = np.asarray(table.column("side")), np.asarray(table.column("filed"))
            every = np.arange(len(points))
            left, right = (every, every) if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            later = repeated_later(points, every, filed_, left, right, tau)
            if len(later):
                yield pa.RecordBatch.from_arrays([table.column("h").combine_chunks().take(pa.array(later))], ["h"])
        yield pa.RecordBatch.from_arrays([pa.array(pairs.found())], ["h"])

    near = written(blocks.mapInArrow(verify, "h long").distinct(), "near").withColumn("near", F.lit(True))
    judged = spots.drop(*names).join(first, ["h", "h2"]).join(near, "h", "left")
    gone = judged.filter(F.col("near") | (F.struct("doc_id", "t", "no") != F.col("first")))
    return gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """carry columns, (doc_id, text, n_lines, n_removed, kept_sha256): text without the lines that
    repeat an earlier one, within tau edits in characters.

    Lines end at a line feed. Lines of fewer than min_chars characters stay; with short, those
    that equal an earlier line go too, and only empty lines always stay. Lines are
    judged on the input: a removed line still counts as earlier. Null texts stay null with no
    lines; rows with a null id keep all lines and repeat nothing. Rows of equal id and text are
    one document (equal places do not repeat each other); rows of one id with different texts
    are different documents, in the order of a hash of the text.
    """
    own = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), *[docs[f"`{c}`"].alias(f"c_{c}") for c in carry])
    own = own.withColumn("t", F.xxhash64("text"))
    gone = removed_lines(own.select("doc_id", "t", "text"), **options)
    joined = own.join(gone, ["doc_id", "t"], "left")
    kept = [f"c_{c}" for c in carry]
    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in ("doc_id", *kept))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts, n_lines, n_gone, digest = [], [], [], []
                for text, numbers in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    n = 0 if text is None else text.count("\n") + 1
                    if text is not None and numbers:
                        drop = set(numbers)
                        text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                    texts.append(text)
                    n_lines.append(n)
                    n_gone.append(len(numbers or ()))
                    digest.append(hashlib.sha256((text or "").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", *kept)] + [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest)],
                    ["doc_id", *kept, "text", "n_lines", "n_removed", "kept_sha256"],
                )

    out = joined.select("doc_id", *kept, "text", "gone").mapInArrow(remove, schema + ", text string, n_lines long, n_removed long, kept_sha256 string")
    return out.select("doc_id", *[F.col(f"`c_{c}`").alias(c) for c in carry], "text", "n_lines", "n_removed", "kept_sha256")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")


SQL = f"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) i from documents where text is not null
), cls as materialized (
  select line, min(doc_id * 1000000 + i) f, length(line) n from l where length(line) >= {MIN_CHARS} group by line
), near as (
  select distinct b.line from cls a join cls b on a.f < b.f and a.n between b.n - {TAU} and b.n + {TAU}
  where levenshtein(a.line, b.line) <= {TAU}
), judged as (
  select l.doc_id, l.i, l.line, (cls.line is not null and (near.line is not null or doc_id * 1000000 + i <> cls.f)) gone
  from l left join cls using (line) left join near using (line)
), each as (
  select doc_id, count(*) n_lines, sum(gone::int)::bigint n_removed, string_agg(case when not gone then line end, chr(10) order by i) t from judged group by doc_id
)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from documents d left join each on each.doc_id = d.doc_id
"""

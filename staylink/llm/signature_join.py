"""Exact Jaccard self-join of documents' word shingles with signature trees.

1. Every document becomes its set of shingle hashes; equal sets are one class, known by a
   hash of the set. Copies are never paired.
2. Prefix filter: under one fixed order of shingles, two sets similar enough share a
   shingle among each one's first n - ceil(t n) + 1. The order is by hash, with shingles
   that very many documents hold last, so the groups that share a prefix shingle stay small.
3. Star: every group's classes are compared with three of its members, among them the hub
   that shares most with others. This links most groups of near copies without forming
   their pairs, and compares all pairs of up to three classes.
4. Groups that the star leaves in several components are joined by signature trees: nodes
   hold OR-combined token bitmaps and size ranges; a dual traversal from the roots drops
   every pair of nodes whose largest possible overlap is too small, whose sizes differ too
   much, or that are one component already. Large groups are cut into chunks, and each
   pair of chunks is a task of its own. The pairs that survive stay in their task, which only
   tells the families of classes that they connect: a class at most once for each of its rows.
5. A family found in many groups is one family. Its sets are brought together, its surviving
   pairs are verified on them in place, and the links that join components come out, fewer than
   the family has classes. Components follow from the verified links.
6. Where the links themselves are wanted, the trees are traversed once more within every
   component and group, without the component test, and all links of a family come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylink.llm.shared import columns, components, runs, written
from staylink.llm.words import U64, Words, mix, signed, slices

#: Shingle length, and the similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: Shingles put last in the order at most (8 bytes each, a bounded broadcast). Any choice is
#: exact; a longer list only makes groups smaller.
FREQUENT = 100_000
#: Classes of one group that a task traverses together.
CHUNK = 4096
FAN = 8
#: Shingles of one family (8 bytes each) that a task verifies with as many others.
FAMILY = 1 << 20
#: Rows of two numbers (16 MB) that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, hashes, digests): each text's distinct k-word shingles, sorted by hash, and a
    64-bit hash of the set. Fewer than k words: the whole sequence as one; none: empty."""
    words = Words(texts, lower=True)
    h = words.hashes()
    start, grams = words.windows(h, k)
    doc = words.doc[start] if len(start) else start
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    doc = np.concatenate((doc, short))
    grams = np.concatenate((grams, words.sequences(h)[short]))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    if len(doc):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])))
        doc, grams = doc[new], grams[new]
    n = len(words.counts)
    offsets = np.searchsorted(doc, np.arange(n + 1))
    total = np.zeros(len(grams) + 1, U64)
    np.cumsum(mix(grams ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    digests = mix((total[offsets[1:]] - total[offsets[:-1]]) ^ np.diff(offsets).astype(U64))
    return offsets, grams, digests


def bits_for(n: int) -> int:
    """Bits of the bitmap of a set: a power of two, at least two for each shingle.

    They are shipped with every row of an open group. Sets that share nothing meet in some 0.3 of
    such bits, far below any bound of near copies; twice as many would hardly exclude more.
    """
    return 1 << max(7, (2 * n - 1).bit_length())


def bitmap(grams: np.ndarray) -> bytes:
    bits = bits_for(len(grams))
    out = np.zeros(bits, bool)
    out[(grams >> U64(7)) & U64(bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) halved by OR until they are width words wide."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


class Tree:
    """Levels of nodes over classes sorted by size: OR bitmaps, size ranges, component if it is one."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        # neighbours in the tree should be alike: by component, then size
        self.order = np.lexsort((n, comp))
        n, bits, comp = n[self.order], bits[self.order], comp[self.order]
        extra = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, extra, comp)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra, comp = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            one = np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at)
            first = np.where(one, comp[at], -1 - np.arange(len(at)))
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at), first))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the level below and, for each, the position of its parent in `node`."""
        size = len(self.levels[level - 1][1])
        child = node[:, None] * FAN + np.arange(FAN)
        where = np.repeat(np.arange(len(node)), FAN)
        child = child.ravel()
        keep = child < size
        return child[keep], where[keep]


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a link: sizes, components, and the largest possible overlap."""
    bits_a, low_a, high_a, extra_a, comp_a = a
    bits_b, low_b, high_b, extra_b, comp_b = b
    keep = (100 * high_b[j] >= percent * low_a[i]) & (100 * high_a[i] >= percent * low_b[j])
    keep &= (comp_a[i] != comp_b[j]) | (comp_a[i] < 0)
    at = np.flatnonzero(keep)
    step = max(1, (1 << 20) // bits_a.shape[1])
    for lo in range(0, len(at), step):
        p = at[lo : lo + step]
        common = np.bitwise_count(bits_a[i[p]] & bits_b[j[p]]).sum(axis=1, dtype=np.int64)
        most = common + np.minimum(extra_a[i[p]], extra_b[j[p]])
        # |x & y| / |x | y| >= t  means  (100 + t) |x & y| >= t (|x| + |y|)
        keep[p] = (100 + percent) * most >= percent * (low_a[i[p]] + low_b[j[p]])
    return keep


def dual(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in the inputs of a and b) of the pairs that no bound excludes, in bounded parts."""
    same = a is b
    depth = max(len(a.levels), len(b.levels)) - 1
    level_of = lambda t, d: min(d, len(t.levels) - 1)
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        d, i, j = stack.pop()
        keep = possible(a.levels[level_of(a, d)], b.levels[level_of(b, d)], i, j, percent)
        if same:
            keep &= i <= j if d else i < j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if d == 0:
            yield a.order[i], b.order[j]
            continue
        for lo in range(0, len(i), 4096):
            x, y = i[lo : lo + 4096], j[lo : lo + 4096]
            if d < len(a.levels):
                x, where = a.children(d, x)
                y = y[where]
            if d < len(b.levels):
                y, where = b.children(d, y)
                x = x[where]
            stack.append((d - 1, x, y))


def tree_pairs(cls: np.ndarray, n: np.ndarray, maps: list[bytes], comp: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes to verify. side: 0 or 1 for the two chunks of a group; with both there,
    only pairs across are formed."""
    width = np.array([len(m) for m in maps]) // 8
    _, comp = np.unique(comp, return_inverse=True)
    comp = comp.astype(np.int64)

    def tree(rows: np.ndarray, w: int) -> Tree:
        bits = np.zeros((len(rows), w), np.uint64)
        for own in np.unique(width[rows]).tolist():  # at most two widths
            at = np.flatnonzero(width[rows] == own)
            bits[at] = folded(np.frombuffer(b"".join(maps[r] for r in rows[at].tolist()), np.uint64).reshape(len(at), own), w)
        return Tree(n[rows], bits, comp[rows])

    def run(left: np.ndarray, right: np.ndarray | None, w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(left) or (right is not None and not len(right)):
            return
        a = tree(left, w)
        b = a if right is None else tree(right, w)
        for i, j in dual(a, b, percent):
            yield cls[left[i]], cls[left[j] if right is None else right[j]]

    halves = [np.flatnonzero(side == s) for s in (0, 1)]
    crossing = len(halves[0]) and len(halves[1])
    for w in np.unique(width).tolist():  # linked sizes differ by less than two: a width meets itself and the next
        here = [h[width[h] == w] for h in halves]
        above = [h[width[h] == 2 * w] for h in halves]
        if crossing:
            yield from run(here[0], here[1], w)
            yield from run(here[0], above[1], w)
            yield from run(above[0], here[1], w)
        else:
            own, next_ = (here[0], above[0]) if len(halves[0]) else (here[1], above[1])
            yield from run(own, None, w)
            yield from run(own, next_, w)


def families(rows: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of the rows the smallest one that the pairs of positions connect it with."""
    low = np.arange(rows)
    for i, j in pairs:
        while len(i):
            a, b = low[i], low[j]
            apart = a != b
            i, j = i[apart], j[apart]
            np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (low[low] != low).any():
                low = low[low]
    return low


def verified(sets: list[np.ndarray], comp: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], percent: int, every: bool) -> Iterator[tuple[int, int]]:
    """The pairs of positions whose sets are similar enough; unless every, only those that join
    two components not joined before."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, comp = np.zeros(len(names), bool), comp.copy()
    for i, j in pairs:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        bounds = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            x, other = int(i[lo]), j[lo:hi]
            if not every:
                other = other[comp[other] != comp[x]]
            if not len(other):
                continue
            own, n = ids[start[x] : start[x] + size[x]], size[other]
            first = np.cumsum(n) - n
            mark[own] = True
            both = np.add.reduceat(mark[ids[np.repeat(start[other] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
            mark[own] = False
            for y in other[100 * both >= percent * (size[x] + n - both)].tolist():
                if every or comp[y] != comp[x]:
                    comp[comp == comp[y]] = comp[x]
                    yield x, y


def chunk_pairs(rows: DataFrame) -> DataFrame:
    """rows in chunk c of m, with i, j, side: every pair of chunks (i <= j) is a block; a chunk goes to each pair it is in."""
    rows = rows.select("*", F.explode(F.expr("sequence(0, m - 1)")).alias("other"))
    return rows.select("*", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), (F.col("c") > F.col("other")).cast("int").alias("side")).drop("c", "m", "other")


def mapped(docs: DataFrame, k: int, schema: str, emit) -> DataFrame:
    """emit(part, offsets, hashes, digests) over slices of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield from emit(part, *shingle_sets(part.column("text"), k))

    return docs.mapInArrow(run, schema)


def sizes_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, n, cls) of every row (t: its text's hash): the size of its set, and its class (null for the empty set)."""

    def emit(part, offsets, grams, digests):
        n = np.diff(offsets)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(n), pa.array(signed(digests), mask=n == 0)], ["doc_id", "t", "n", "cls"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.withColumn("t", F.xxhash64("text")), k, f"doc_id {kind}, t long, n long, cls long", emit)


class Join:
    """The join over docs (doc_id, text) as written stages."""

    def __init__(self, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK, frequent: int = FREQUENT, family: int = FAMILY):
        self.docs, self.k, self.percent, self.chunk, self.family = docs, k, percent, chunk, family
        #: (doc_id, t, n, cls) of every row; cls is null for empty sets
        self.all_rows = written(sizes_of(docs, k), "sets")
        self.rows = self.all_rows.filter("cls is not null")
        self.frequent = self._frequent(frequent)

    def _map(self, schema: str, emit) -> DataFrame:
        return mapped(self.docs, self.k, schema, emit)

    def _frequent(self, limit: int) -> np.ndarray:
        """Shingles of the most documents, over all documents: counted in every part of about
        a thousand texts, summed where a part has several (one class counts once in a part)."""

        def emit(part, offsets, grams, digests):
            _, first = np.unique(digests, return_index=True)
            if not len(grams):
                return
            own = np.concatenate([grams[offsets[i] : offsets[i + 1]] for i in first.tolist()])
            keys, counts = np.unique(own, return_counts=True)
            often = counts >= max(3, len(first) // 400)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[often])), pa.array(counts[often])], ["g", "c"])

        top = self._map("g long, c long", emit).groupBy("g").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "g").limit(limit)
        return np.sort(np.array([r.g for r in top.select("g").collect()], np.int64)).view(np.uint64)

    def _prefixes(self) -> DataFrame:
        """(g, cls, n): prefix shingles of every class; copies in one part of the input once."""
        last = self.docs.sparkSession.sparkContext.broadcast(np.sort(self.frequent))
        percent = self.percent

        def emit(part, offsets, grams, digests):
            n = np.diff(offsets)
            _, first = np.unique(digests, return_index=True)
            first = first[n[first] > 0]
            late = np.isin(grams, last.value)
            g, c, size = [], [], []
            for i in first.tolist():
                own, late_own = grams[offsets[i] : offsets[i + 1]], late[offsets[i] : offsets[i + 1]]
                p = len(own) - -(-percent * len(own) // 100) + 1
                # own is sorted by hash: early ones in order, then the frequent ones
                picked = np.concatenate((own[~late_own], own[late_own]))[:p] if late_own.any() else own[:p]
                g.append(picked)
                c.append(np.full(p, digests[i]))
                size.append(np.full(p, n[i]))
            if g:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(g))), pa.array(signed(np.concatenate(c))), pa.array(np.concatenate(size))], ["g", "cls", "n"])

        return self._map("g long, cls long, n long", emit)

    def _bitmaps(self) -> DataFrame:
        """(cls, n, bits) of every class."""

        def emit(part, offsets, grams, digests):
            n = np.diff(offsets)
            _, first = np.unique(digests, return_index=True)
            first = first[n[first] > 0]
            maps = [bitmap(grams[offsets[i] : offsets[i + 1]]) for i in first.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(signed(digests[first])), pa.array(n[first]), pa.array(maps, pa.binary())], ["cls", "n", "bits"])

        return self._map("cls long, n long, bits binary", emit)

    def _sets_of(self, classes: DataFrame) -> DataFrame:
        """(cls, grams) of the classes, read from one document of each."""
        owner = written(self.rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(classes, "cls", "left_semi"), "owners")
        if owner.count() <= BROADCAST_ROWS:  # then the texts need no shuffle
            owner = F.broadcast(owner)
        texts = self.docs.join(owner, "doc_id").select("doc_id", "text", F.col("cls").alias("wanted"))
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    offsets, grams, digests = shingle_sets(part.column("text"), k)
                    own = signed(digests)
                    at = np.flatnonzero(own == np.asarray(part.column("wanted"), dtype=np.int64))  # repeated ids with other texts
                    sets = [grams[offsets[i] : offsets[i + 1]].tobytes() for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(sets, pa.binary())], ["cls", "grams"])

        return texts.mapInArrow(run, "cls long, grams binary").dropDuplicates(["cls"])

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough. Pairs meet at a, in parts of at most
        about 512, so a class with very many partners is spread out."""
        pairs = written(pairs, name)
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).alias("parts"))
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
        sets = written(self._sets_of(pairs.selectExpr("a cls").union(pairs.selectExpr("b cls")).distinct()), name + "-sets")
        members = dealt.join(sets.select(F.col("cls").alias("b"), "grams"), "b")
        leaders = dealt.select(F.col("a").alias("lead"), F.col("part").alias("of")).distinct().join(sets.select(F.col("cls").alias("lead"), F.col("grams").alias("own")), "lead")
        percent = self.percent

        def check(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if len(right) and len(left):
                x = np.frombuffer(right.column("own")[0].as_py(), np.uint64)
                for b, raw in zip(left.column("b").to_pylist(), left.column("grams").to_pylist(), strict=True):
                    y = np.frombuffer(raw, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append(b)
            a = left.column("a")[0].as_py() if len(left) else 0
            return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

        return written(members.groupBy("a", "part").cogroup(leaders.groupBy("lead", "of")).applyInArrow(check, "a long, b long"), name + "-links")

    def links(self) -> DataFrame:
        """(a, b): verified links between classes that connect every pair of linked classes."""
        percent = self.percent
        # dealt once by shingle, at every size: the groups and their rows come from the same shuffle
        # (which needs both to read the same columns)
        prefixes = self._prefixes().repartition("g")
        bitmaps = self.bitmaps = written(self._bitmaps().dropDuplicates(["cls"]), "bitmaps")
        one = F.struct("cls", "n")
        groups = prefixes.groupBy("g").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low.cls < high.cls")
        shared = self.shared = written(prefixes.join(groups, "g").distinct(), "shared")
        # a copy's own changes are shared with no one, so the class that meets most others is the
        # one nearest to all: the hub of its groups
        sizes = shared.groupBy("g").agg(F.count("*").alias("size")).filter("size > 3")
        sized = shared.select("g", "cls", "n").join(sizes, "g")
        weight = sized.groupBy("cls").agg(F.sum("size").alias("w"))
        hubs = sized.join(weight, "cls").groupBy("g").agg(F.max_by(one, F.struct("w", "cls")).alias("hub"))
        star = shared.select(F.explode(F.array("low", "high")).alias("a"), one.alias("b"))
        star = star.unionByName(shared.select("g", one.alias("b")).join(hubs, "g").select(F.col("hub").alias("a"), "b"))
        # sizes first: most pairs go before they are given their bitmaps
        star = star.filter(f"a.cls <> b.cls and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")
        star = star.select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b")).distinct()
        left, right = (bitmaps.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("bits" + c)) for c in "ab")
        star = star.join(left, "a").join(right, "b")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("bitsa", "bitsb", "na", "nb")), strict=True):
                    x, y = (np.frombuffer(v, np.uint64)[None] for v in (x, y))
                    w = min(x.shape[1], y.shape[1])
                    x, y = folded(x, w), folded(y, w)
                    extra = min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum()))
                    keep.append((100 + percent) * (int(np.bitwise_count(x & y).sum()) + extra) >= percent * (n + m))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        first = self._verified(star.mapInArrow(bound, "a long, b long"), "star")
        return first.unionByName(self._tree_links(shared, bitmaps, components(first)))

    def every_link(self, links: DataFrame, comps: DataFrame) -> DataFrame:
        """(a, b), a < b: every link between classes, from links() and its components."""
        # linked classes share a prefix shingle and are one component; classes without a link are in none
        own = self.shared.join(comps.withColumnRenamed("node", "cls"), "cls").select(F.xxhash64("g", "component").alias("g"), "cls", "n", F.col("component").alias("comp"))
        groups = own.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1")
        within = self._linked(own, groups, self.bitmaps, "within", apart=False)
        return links.select("a", "b").unionByName(within).distinct()

    def _tree_links(self, shared: DataFrame, bitmaps: DataFrame, comps: DataFrame) -> DataFrame:
        own = shared.select("g", "cls", "n").join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("g", "cls", "n", F.coalesce("component", "cls").alias("comp"))
        open_ = own.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"))
        # up to three classes, the star has compared every pair
        open_ = open_.filter("x <> y and size > 3")
        return self._linked(own, open_, bitmaps, "tree", apart=True)

    def _linked(self, own: DataFrame, open_: DataFrame, bitmaps: DataFrame, name: str, apart: bool) -> DataFrame:
        """(a, b), a < b: links within the open groups. apart: only links that connect what links of two components connect."""
        percent, chunk = self.percent, self.chunk
        chunks = F.ceil(F.col("size") / chunk).cast("int")
        # a class links with no one in the group if not even the next smaller or larger is near its size
        by_size = Window.partitionBy("g").orderBy("n", "cls")
        below, above = F.lag("n").over(by_size), F.lead("n").over(by_size)
        near = (100 * below >= percent * F.col("n")) | (100 * F.col("n") >= percent * above)
        rows = own.join(open_.select("g", chunks.alias("m")), "g")
        small = rows.filter("m = 1").withColumn("near", near).filter("near").drop("near")  # at most chunk rows in a window
        rows = small.unionByName(rows.filter("m > 1")).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int"))
        rows = chunk_pairs(rows).select("g", "cls", "comp", "i", "j", "side")
        order = ["g", "i", "j"]
        rows = written(rows, "open").join(bitmaps, "cls").repartition(*order).sortWithinPartitions(*order)

        def candidates(table: pa.Table, maps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
            """(cls, n, comp, pairs of positions that no bound of the trees excludes)."""
            n, cls, comp, side = (np.asarray(table.column(c), dtype=np.int64) for c in ("n", "cls", "comp", "side"))
            # not apart: each class for itself, in order of size
            near = comp if apart else np.argsort(np.lexsort((cls, n)))
            return cls, n, comp, tree_pairs(np.arange(len(cls)), n, maps, near, side, percent)

        def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, order):
                cls, n, comp, pairs = candidates(table, table.column("bits").to_pylist())
                low = families(len(cls), pairs)
                met = np.flatnonzero(np.bincount(low, minlength=len(cls))[low] > 1)
                if not len(met):
                    continue
                met = met[np.argsort(low[met], kind="stable")]
                first = np.flatnonzero(np.diff(low[met], prepend=-1))
                # a family is known by its classes, so it is the same in each group
                family = mix(np.add.reduceat(mix(cls[met].view(np.uint64)), first))
                family = np.repeat(family, np.diff(first, append=len(met)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(family)), *(pa.array(x[met]) for x in (cls, n, comp))], ["family", "cls", "n", "comp"])

        met = written(rows.mapInArrow(traverse, "family long, cls long, n long, comp long").distinct(), name)
        sets = written(self._sets_of(met.select("cls").distinct()), name + "-sets")
        parts = met.groupBy("family").agg(F.ceil(F.sum("n") / self.family).cast("int").alias("m"))
        dealt = met.join(parts, "family").withColumn("c", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int"))
        of = ["family", "i", "j"]
        blocks = chunk_pairs(dealt).join(sets, "cls").repartition(*of).sortWithinPartitions(*of)

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, of):
                sets = [np.frombuffer(raw, np.uint64) for raw in table.column("grams").to_pylist()]
                cls, _, comp, pairs = candidates(table, [bitmap(s) for s in sets])
                found = np.array([*verified(sets, comp, pairs, percent, not apart)], np.int64).reshape(-1, 2)
                if len(found):
                    a, b = cls[found[:, 0]], cls[found[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        return written(blocks.mapInArrow(verify, "a long, b long").filter("a < b").distinct(), name + "-links")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", n_links: bool = False, groups: bool = False, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; with n_links, also the number of other
    rows that it links with, copies included. (Join.every_link gives the pairs of classes.)

    Documents link when 100 * |x & y| >= percent * |x | y| on their sets of distinct k-word
    shingles. Null and empty texts, and texts without words, have no shingles and link with
    nothing; a text of fewer words is one shingle. Each row has the component of its own text:
    rows of one id with different texts are different documents, and component_id is the smallest
    id among the rows that it reaches. Rows with a null id link with nothing and have a null component.
    An empty table gives an empty table.

    With groups, also text_hash (xxhash64 of the text) and group_id, a number that the rows of one
    component share; it is null for rows without shingles or id, which are groups of their own.
    """
    own = columns(docs, doc_id=id_col, text=text_col)
    join = Join(own.filter("doc_id is not null"), k, percent, **options)
    links = join.links()
    nodes = components(links.selectExpr("a", "b"))
    low = join.rows.groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = low.join(nodes.withColumnRenamed("node", "cls"), "cls", "left").withColumn("c", F.coalesce("component", "cls"))
    smallest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    of_class = named.select("cls", "c").join(smallest, "c")
    rows, counted = join.all_rows.join(of_class, "cls", "left"), []
    if n_links:
        sizes = join.rows.groupBy("cls").agg(F.count("*").alias("size"))
        every = join.every_link(links, nodes)
        both = every.unionByName(every.selectExpr("b a", "a b"))
        others = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.sum("size").alias("others"))
        per_class = sizes.join(others.withColumnRenamed("a", "cls"), "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
        rows, counted = rows.join(per_class, "cls", "left"), [F.coalesce("links", F.lit(0)).alias("n_links")]
    own_group = [F.col("t").alias("text_hash"), F.col("c").alias("group_id")] if groups else []
    no_group = [F.col("t").alias("text_hash"), F.lit(None).cast("long").alias("group_id")] if groups else []
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *counted, *own_group)
    rest = sizes_of(own.filter("doc_id is null"), k).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias("n_links") for _ in counted], *no_group)
    return out.unionByName(rest)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), sh as materialized (
  select distinct doc_id, hash(array_to_string(w[i:i + 3], ' ')) s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from w where len(w) > 0)
), size as materialized (
  select doc_id, count(*) n from sh group by doc_id
), both_ as (
  select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all
), link as materialized (
  select x, y from both_ join size p on p.doc_id = x join size q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
), edge as materialized (
  select x, y from link union all select y, x from link
), reach as (
  select x, y from edge union select r.x, e.y from reach r join edge e on r.y = e.x
), low as (
  select x, min(y) m from reach group by x
)
select w.doc_id, cast(coalesce(size.n, 0) as bigint) n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) component_id
from w left join size on size.doc_id = w.doc_id left join low on low.x = w.doc_id
"""

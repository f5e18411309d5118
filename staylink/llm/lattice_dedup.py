"""Near-duplicate vectors by lattice hashing.

Each table projects the normalised vectors to eight dimensions with fixed Gaussian
directions and decodes them to the nearest point of the E8 lattice: a cell. A vector is
filed under its own cell and also probes the cells of the nearest neighbouring lattice
points. Vectors that meet in a cell are compared exactly; a cell gives only the links of a
spanning forest, never all pairs. Links lie within components, so each component is then
compared with itself in blocks to count every vector's links exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import columns, components, runs, written
from staylink.llm.words import U64, mix, signed

#: Tables, cells that a vector looks into (its own and its neighbours), and the scale of the
#: projection: with these a pair at cosine 0.98 meets with probability over 0.999999.
TABLES, PROBES, SCALE = 5, 9, 1.0
#: Rows of a cell or component that one task compares with as many others.
CHUNK = 1024


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1.0, 1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    near = np.round(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 for every row."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


@lru_cache(maxsize=64)
def directions(dim: int, table: int) -> np.ndarray:
    return np.random.default_rng([dim, table]).standard_normal((dim, 8))


def cell_keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit key of lattice points (doubled coordinates are whole) and a salt per row."""
    h = mix(salt)
    for c in range(8):
        h = mix(h ^ (2 * points[:, c]).astype(np.int64).view(np.uint64) * U64(0x9E3779B97F4A7C15))
    return h


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, salt: np.ndarray, tables: int, probes: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(own key, neighbour keys) of unit vectors for every table."""
    for t in range(tables):
        y = x @ directions(x.shape[1], t) / scale
        point = decode(y)
        near = np.argsort(-((y - point) @ roots().T), axis=1)[:, : probes - 1]
        own = salt ^ U64(t + 1)
        around = [cell_keys(point + roots()[near[:, k]], own) for k in range(probes - 1)]
        yield cell_keys(point, own), np.stack(around, axis=1) if around else np.zeros((len(x), 0), U64)


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (smaller, larger id) that connect what the symmetric matrix connects."""
    out, free = [], np.ones(len(ids), bool)
    for root in range(len(ids)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & free)
            free[new] = False
            out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in new.tolist()]
            queue += new.tolist()
    return out


def links(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows compare only when their labels are equal and not null. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, as do rows with a null id
    (null component, kept). Equal vectors are one class: they link, without being paired.
    Vectors of different lengths do not link. Each repeated row is a vector of its own, and so are
    two rows of one id with different vectors: each has its own links and component, and
    component_id is the smallest id among the rows that it reaches.
    """
    own = columns(vectors, vec_id=id_col, embedding=vector_col, label=label_col)
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    keyed = own.withColumn("ok", F.coalesce(valid, F.lit(False))).select("vec_id", "ok", F.when(F.col("ok"), F.xxhash64("label", "embedding")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(7), "embedding", "label")).alias("h2"), F.size(v).alias("dim"), F.xxhash64("label").alias("salt"), "embedding")
    classes = keyed.filter("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"), F.any_value("embedding").alias("embedding"), F.any_value("dim").alias("dim"), F.any_value("salt").alias("salt"))
    # a class is named by its content: two vectors of one id are two classes
    classes = written(classes.withColumn("cls", F.xxhash64("h1", "h2")), "vectors")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for lo in range(0, part.num_rows, 2048):
                    piece = part.slice(lo, 2048)
                    salt = np.asarray(piece.column("salt"), dtype=np.int64).view(np.uint64) ^ mix(np.full(piece.num_rows, dim, np.uint64))
                    cls = np.asarray(piece.column("cls"), dtype=np.int64)
                    for home, around in cells(unit(matrix(piece.column("embedding"))), salt, tables, probes, scale):
                        key = np.concatenate((home, around.ravel()))
                        who = np.concatenate((cls, np.repeat(cls, around.shape[1])))
                        role = np.concatenate((np.zeros(len(home), np.int32), np.ones(around.size, np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(who), pa.array(role)], ["key", "cls", "probe"])

    filed = written(classes.mapInArrow(hashed, "key long, cls long, probe int"), "cells")
    busy = filed.groupBy("key").agg(F.sum(1 - F.col("probe")).alias("homes"), F.count("*").alias("n")).filter("homes >= 1 and n >= 2")
    busy = busy.select("key", F.ceil(F.col("homes") / chunk).cast("int").alias("mh"), F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int").alias("mn"))
    # in a cell larger than chunk, every part of its home rows meets every part of all its rows
    met = filed.join(busy, "key")
    home = met.filter("probe = 0").select("key", "cls", F.pmod(F.xxhash64("cls"), F.col("mh")).cast("int").alias("i"), F.explode(F.expr("sequence(0, mn - 1)")).alias("j"), F.lit(0).alias("side"))
    guest = met.select("key", "cls", F.explode(F.expr("sequence(0, mh - 1)")).alias("i"), F.pmod(F.xxhash64("cls"), F.col("mn")).cast("int").alias("j"), F.lit(1).alias("side"))
    blocks = home.unionByName(guest).join(classes.select("cls", "embedding"), "cls")
    order = ["key", "i", "j"]
    blocks = blocks.select(*order, "side", "cls", "embedding").repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for table in runs(batches, order):
            side, cls = np.asarray(table.column("side")), np.asarray(table.column("cls"), dtype=np.int64)
            if not (side == 0).any():
                continue
            cls, first = np.unique(cls, return_index=True)
            if len(cls) < 2:
                continue
            x = unit(matrix(table.column("embedding").combine_chunks().take(pa.array(first))))
            linked = cosines(x, x, threshold)
            np.fill_diagonal(linked, False)
            if linked.any():
                found.update(forest(cls, linked))
            if len(found) >= 20_000:
                yield flush()
        yield flush()

    edges = written(blocks.mapInArrow(compare, "a long, b long").distinct(), "links")
    comps = written(components(edges).select(F.col("node").alias("cls"), "component"), "components")
    lowest = comps.join(classes.select("cls", "low"), "cls").groupBy("component").agg(F.min("low").alias("lowest"))
    # every component against itself, in blocks
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("m"))
    members = classes.select("cls", "size", "embedding").join(comps, "cls").join(sizes, "component").withColumn("c", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int"))
    tiles = members.select("component", "cls", "size", "embedding", "c", F.explode(F.expr("sequence(0, m - 1)")).alias("o"))
    tiles = tiles.select("component", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"), "cls", "size", "embedding")
    order2 = ["component", "i", "j"]
    tiles = tiles.repartition(*order2).sortWithinPartitions(*order2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, order2):
            cls, size, side = (np.asarray(table.column(c), dtype=np.int64) for c in ("cls", "size", "side"))
            x = unit(matrix(table.column("embedding").combine_chunks()))
            diagonal = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            n = np.zeros(len(cls), np.int64)
            left = np.arange(len(cls)) if diagonal else np.flatnonzero(side == 0)
            right = left if diagonal else np.flatnonzero(side == 1)
            linked = cosines(x[left], x[right], threshold)
            if diagonal:
                np.fill_diagonal(linked, False)
            n[left] += linked @ size[right]
            if not diagonal:
                n[right] += linked.T @ size[left]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n)], ["cls", "n"])

    linked = tiles.mapInArrow(count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    named = classes.select("h1", "h2", "cls", "low", "size").join(comps, "cls", "left").join(lowest, "component", "left").join(linked, "cls", "left")
    named = named.select("h1", "h2", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    out = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return x @ y.T >= threshold


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
), ok as materialized (
  select vec_id, label, e from v
  where vec_id is not null and label is not null and e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), link as materialized (
  select a.vec_id x, b.vec_id y from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
  select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x
), low as (
  select x, min(y) m from reach group by x
), n as (
  select x, count(*) c from link group by x
)
select vec_id, cast(coalesce(n.c, 0) as bigint) n_links, least(vec_id, coalesce(low.m, vec_id)) component_id,
  vec_id = least(vec_id, coalesce(low.m, vec_id)) kept
from embeddings left join n on n.x = vec_id left join low on low.x = vec_id
"""

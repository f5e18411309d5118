"""Ordered scans per person that do not put one person's history in one task.

Sequences (DOM-3), transfer stays (DOM-4), stay numbers (WIN-7), the next event after an anchor
(JN-7), ranks (AGG-4) and survival curves (SRV-1) are running counts, sums, products, maxima and
look-arounds over the rows of a key in order. The plain form,
``Window.partitionBy(person).orderBy(...)``, sends every row of a person to one task; a person
holding a third of all rows would then be one task over a third of the data.

Here the rows are range-partitioned once by the whole order key (person, start, end, episode id)
and written with the number of their range, bucketed by it (:func:`with_block`). Ranges are
quantiles of the rows, so each holds about as many rows however the persons, ids and dates are
distributed; a person, or one day of a person, that is larger than a range is cut. Then

    running value = running value over the earlier ranges of the person  (+ / * / max / last)
                    running value inside the row's own range.

1. Windows by (range, person) give the values inside a range. The files are bucketed by range, so
   no row is shuffled.
2. Ranges are contiguous in (person, order). So only a range's *first* person can have rows in
   earlier ranges, and only its *last* person rows in later ones: one small row for each range
   holds the totals of these two, by aggregates in the same tasks.
3. One run over these rows turns totals into carries: the first person's from before, the last
   person's from behind. Their number is that of the ranges, whatever the number of rows and
   persons, so the driver makes the run and a broadcast join brings the carries back.

Levels may depend on each other: a scan over the result of a scan keeps the layout, so a chain of
levels is one pass of windows in each task, after one small aggregate a level.

It is one algorithm at every size: no probe, no list of hot keys and no arithmetic on ids, which
may be of any orderable type. The range number is read from the written stage and never computed
again, so retried tasks see the same ranges.

The scan also numbers all rows of the table in (person, order) order (``global_position``, WIN-1):
rows in earlier ranges plus the position in the range.
"""

from __future__ import annotations

import itertools
import operator
import uuid
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylink.sources.stages import StageStore, scratch_store

BLOCK = "_blk"

#: Kinds of running value a scan can produce, from the rows before or (second line) behind.
KINDS = ("count", "sum", "sum_before", "product", "max", "max_before", "last_before", "prev", "first_pos", "last_pos",
         "sum_from", "min_after", "next")
BEHIND = ("sum_from", "min_after", "next")

Spec = tuple[str, Column | None]


def range_count(df: DataFrame, ranges: int | None = None) -> int:
    """The number of ranges of a table: as given, else the session's number of shuffle partitions
    (the setting that sizes every other shuffle of these rows); no more than a bucketed table may have."""
    return min(int(ranges or df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100_000)


def _labels(df: DataFrame, n: int) -> DataFrame:
    """(_p, _blk): increasing numbers for the ranges 0 to n - 1, each of which Spark's bucketing puts
    in a bucket of its own (so that a bucket is one range). About n ln n candidates are looked at."""
    spark = df.sparkSession
    labels, used, lo, step = [], set(), 0, max(64, 4 * n)
    while len(labels) < n:
        rows = spark.range(lo, lo + step).select(F.col("id").cast("int").alias("id"))
        for r in rows.select("id", F.expr(f"pmod(hash(id), {n})").alias("b")).collect():
            if r.b not in used and len(labels) < n:
                used.add(r.b)
                labels.append(r.id)
        lo += step
    return spark.createDataFrame([(p, label) for p, label in enumerate(labels)], f"_p int, {BLOCK} int")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ranges: int) -> DataFrame:
    """df dealt into ranges of (keys, order), with the range number of each row; to be written at
    once (:meth:`StageStore.write` with ``buckets=ranges, by=BLOCK``)."""
    dealt = df.repartitionByRange(ranges, *[_asc(k) for k in keys], *[_asc(c) for c in order])
    dealt = dealt.withColumn("_p", F.spark_partition_id())
    return dealt.join(F.broadcast(_labels(df, ranges)), "_p").drop("_p")  # one row a range


def with_block(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ranges: int | None = None, store: StageStore | None = None) -> DataFrame:
    """df written once in ranges of (keys, order), with the range number of each row. A table that
    has its ranges keeps them."""
    if BLOCK in df.columns:
        return df
    n = range_count(df, ranges)
    store = store or scratch_store(df.sparkSession)
    return store.write(ranged(df, keys, order, n), f"ranges-{uuid.uuid4().hex[:12]}", buckets=n, by=BLOCK, dealt=True)


def _asc(c: str | Column) -> Column:
    return F.asc_nulls_last(c) if isinstance(c, str) else c


def _key(keys: Sequence[str]) -> Column:
    """The keys as one value that orders as the ranges do (nulls last)."""
    return F.struct(F.lit(0), *[x for k in keys for x in (F.col(k).isNull(), F.col(k))])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    specs: Mapping[str, Spec],
    *,
    ranges: int | None = None,
    global_position: str | None = None,
    store: StageStore | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in ``order`` (which must end in a unique tiebreak).

    ``keys`` may be empty: the whole table is one sequence. ``specs`` maps an output name to
    ``(kind, expr)``:

    - ``count``: 1-based position of the row (``expr`` unused)
    - ``sum`` / ``sum_before``: running sum including / excluding the row (0 when empty)
    - ``product``: running product including the row
    - ``max`` / ``max_before``: running maximum including / excluding the row
    - ``prev``: ``expr`` of the previous row (null on the first)
    - ``last_before``: the last non-null ``expr`` before the row
    - ``first_pos`` / ``last_pos``: position of the first / latest row so far where the
      boolean ``expr`` holds (null if none)
    - ``sum_from``: sum over the row and all behind it
    - ``min_after``: minimum over the rows behind it
    - ``next``: the first non-null ``expr`` behind it

    The result keeps the range column ``_blk``, which a following scan in the same order uses
    again; call :func:`drop_block` at the end.
    """
    keys = list(keys)
    for name, (kind, _) in specs.items():
        if kind not in KINDS:
            raise ValueError(f"unknown scan kind {kind!r} for {name}")
    df = with_block(df, keys, order, ranges, store)
    order_cols = [_asc(c) for c in order]
    w_in = W.partitionBy(BLOCK, *keys).orderBy(*order_cols)
    upto = w_in.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = w_in.rowsBetween(W.unboundedPreceding, -1)
    # the rows behind, as those ahead in the opposite order: a frame that ends at the last row is
    # made anew for every row, which costs the square of a key's rows in a range
    w_back = W.partitionBy(BLOCK, *keys).orderBy(F.desc("_rn"))
    onward = w_back.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = w_back.rowsBetween(W.unboundedPreceding, -1)

    vals = {f"_v_{n}": e for n, (k, e) in specs.items() if e is not None}
    rn = "_rn"
    rows = (df.withColumns(vals) if vals else df).withColumn(rn, F.row_number().over(w_in))
    inside: dict[str, Column] = {}
    for n, (kind, _) in specs.items():
        v = F.col(f"_v_{n}")
        made = {
            "sum": lambda v=v: F.sum(v).over(upto),
            "sum_before": lambda v=v: F.sum(v).over(before),
            "product": lambda v=v: F.product(v).over(upto),
            "max": lambda v=v: F.max(v).over(upto),
            "max_before": lambda v=v: F.max(v).over(before),
            "last_before": lambda v=v: F.last(v, ignorenulls=True).over(before),
            "prev": lambda v=v: F.lag(v).over(w_in),
            "first_pos": lambda v=v: F.min(F.when(v, F.col(rn))).over(upto),
            "last_pos": lambda v=v: F.max(F.when(v, F.col(rn))).over(upto),
            "sum_from": lambda v=v: F.sum(v).over(onward),
            "min_after": lambda v=v: F.min(v).over(after),
            "next": lambda v=v: F.last(v, ignorenulls=True).over(after),
        }.get(kind)
        if made:
            inside[f"_i_{n}"] = made()
    if inside:
        rows = rows.withColumns(inside)

    carries = _carries(rows, keys, specs, global_position is not None)
    out = rows.join(F.broadcast(carries), F.col(BLOCK) == F.col("_b_blk"), "left").drop("_b_blk")
    at_first, at_last = _key(keys) == F.col("_k_first"), _key(keys) == F.col("_k_last")

    held = F.when(at_first, F.col("_c_cnt")).otherwise(F.lit(0))
    pos = held + F.col(rn)
    final: dict[str, Column] = {}
    for n, (kind, _) in specs.items():
        i = F.col(f"_i_{n}")
        c = F.when(at_last if kind in BEHIND else at_first, F.col(f"_c_{n}"))
        if kind == "count":
            final[n] = pos.cast("int")
        elif kind in ("sum", "sum_before", "sum_from"):
            final[n] = F.coalesce(c, F.lit(0)) + F.coalesce(i, F.lit(0))
        elif kind == "product":
            final[n] = F.coalesce(c, F.lit(1.0)) * F.coalesce(i, F.lit(1.0))
        elif kind in ("max", "max_before"):
            final[n] = F.greatest(c, i)
        elif kind == "min_after":
            final[n] = F.least(c, i)
        elif kind in ("last_before", "next"):
            final[n] = F.coalesce(i, c)
        elif kind == "prev":
            final[n] = F.when(F.col(rn) == 1, c).otherwise(i)
        elif kind == "first_pos":
            final[n] = F.coalesce(c, held + i).cast("int")
        elif kind == "last_pos":
            final[n] = F.coalesce(held + i, c).cast("int")
    if global_position is not None:
        # rows of earlier ranges, and the position in this one
        whole = W.partitionBy(BLOCK).orderBy(*[_asc(k) for k in keys], *order_cols)
        final[global_position] = (F.col("_b_off") + F.row_number().over(whole)).cast("long")
    out = out.withColumns(final)
    temp = [c for c in out.columns if c in set(carries.columns) | {rn, *vals} | {f"_i_{n}" for n in specs}]
    return out.drop(*temp)


def _order(value):
    """A sort key for values as Spark orders them: null first, structs field by field."""
    if value is None:
        return (0,)
    return (1, tuple(_order(v) for v in value.values())) if isinstance(value, dict) else (1, value)


def _frozen(value):
    """A struct as something that can be a dictionary's key."""
    return tuple((k, _frozen(v)) for k, v in value.items()) if isinstance(value, dict) else value


def _local(spark, rows: list[dict], fields: list[pa.Field]) -> DataFrame:
    """A small table of the driver's own rows, which plans as a local relation: no job to read it."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema(fields)))


def _skip_null(combine: Callable) -> Callable:
    return lambda old, new: new if old is None else old if new is None else combine(old, new)


#: How the totals of a key's ranges combine, the nearest range last (positions apart).
_COMBINE: dict[str, Callable] = {
    **dict.fromkeys(("sum", "sum_before", "sum_from"), _skip_null(operator.add)),
    "product": _skip_null(operator.mul),
    **dict.fromkeys(("max", "max_before", "last_pos"), _skip_null(lambda x, y: max(x, y, key=_order))),
    **dict.fromkeys(("min_after", "first_pos"), _skip_null(lambda x, y: min(x, y, key=_order))),
    **dict.fromkeys(("last_before", "next"), _skip_null(lambda x, y: y)),
    "prev": lambda old, new: new,  # the last row's value, null or not
}


def _carries(rows: DataFrame, keys: list[str], specs: Mapping[str, Spec], offsets: bool) -> DataFrame:
    """One row a range: its first and last key, and what earlier ranges carry to the first and later
    ones to the last. ``rows`` have the values inside the ranges.

    The ranges' totals are aggregated in their own tasks; the driver receives one row for each
    range, whatever the number of rows and keys, and runs once over them in each direction.
    """
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    for n, (kind, _) in specs.items():
        v, rn = F.col(f"_v_{n}"), F.col("_rn")
        total = {
            "sum": lambda v=v: F.sum(v),
            "sum_before": lambda v=v: F.sum(v),
            "sum_from": lambda v=v: F.sum(v),
            "product": lambda v=v: F.product(v),
            "max": lambda v=v: F.max(v),
            "max_before": lambda v=v: F.max(v),
            "min_after": lambda v=v: F.min(v),
            "last_before": lambda v=v, rn=rn: F.max_by(v, F.when(v.isNotNull(), rn)),
            "prev": lambda v=v, rn=rn: F.max_by(v, rn),
            "next": lambda v=v, rn=rn: F.min_by(v, F.when(v.isNotNull(), rn)),
            "first_pos": lambda v=v, rn=rn: F.min(F.when(v, rn)),
            "last_pos": lambda v=v, rn=rn: F.max(F.when(v, rn)),
        }.get(kind)
        if total:
            aggs.append(total().alias(f"_t_{n}"))
    per = rows.groupBy(BLOCK, *keys).agg(*aggs).withColumn("_k", _key(keys))
    totals = F.struct("_cnt", *[c for c in per.columns if c.startswith("_t_")])
    ends = per.groupBy(BLOCK).agg(
        F.sum("_cnt").alias("_bn"),
        F.min("_k").alias("_k_first"),
        F.max("_k").alias("_k_last"),
        F.min_by(totals, F.col("_k")).alias("_first"),
        F.max_by(totals, F.col("_k")).alias("_last"),
    )
    found = ends.toArrow()
    ranges = sorted(found.to_pylist(), key=lambda r: r[BLOCK])

    def carried(names: list[str], enter: str, leave: str, given: str, sequence: list) -> list[dict]:
        """What each range's key at the `enter` end is given by the ranges before it in the sequence."""
        out, key, state, rows_so_far = [], None, {}, 0
        for r in sequence:
            if r[enter] != key:
                state, rows_so_far = {}, 0
            out.append({"_c_cnt": rows_so_far} | {n: state.get(n) for n in names})
            if r[leave] != r[enter]:
                state, rows_so_far = {}, 0
            t = r[given]
            new = dict(state)
            for n in names:
                kind, value = specs[n][0], t[f"_t_{n}"]
                if kind in ("first_pos", "last_pos") and value is not None:
                    value += rows_so_far
                new[n] = _COMBINE[kind](state.get(n), value)
            key, state, rows_so_far = r[leave], new, rows_so_far + t["_cnt"]
        return out

    ahead = [n for n, (k, _) in specs.items() if k not in BEHIND and k != "count"]
    behind = [n for n, (k, _) in specs.items() if k in BEHIND]
    before = carried(ahead, "_k_first", "_k_last", "_last", ranges)
    after = carried(behind, "_k_last", "_k_first", "_first", ranges[::-1])[::-1]
    offset = [0, *itertools.accumulate(r["_bn"] for r in ranges)]
    out = [
        {"_b_blk": r[BLOCK], "_k_first": r["_k_first"], "_k_last": r["_k_last"], "_b_off": offset[i], "_c_cnt": b["_c_cnt"]}
        | {f"_c_{n}": v for n, v in (b | x).items() if n != "_c_cnt"}
        for i, (r, b, x) in enumerate(zip(ranges, before, after, strict=True))
    ]
    kinds, key = found.schema.field("_last").type, found.schema.field("_k_last").type
    fields = [pa.field("_b_blk", pa.int32()), pa.field("_k_first", key), pa.field("_k_last", key), pa.field("_b_off", pa.int64()), pa.field("_c_cnt", pa.int64())]
    fields += [pa.field(f"_c_{n}", kinds.field(f"_t_{n}").type) for n in ahead + behind]
    table = _local(rows.sparkSession, out, fields)
    return table if offsets else table.drop("_b_off")


def segment_max(
    df: DataFrame,
    keys: Sequence[str],
    segment: str,
    values: Mapping[str, str | Column],
) -> DataFrame:
    """Maximum of each of ``values`` over each segment (rows of a key with one ``segment`` number).

    ``df`` must come from :func:`ordered_scan` (it has the range column) and ``segment`` must not
    decrease in the scan order, as a running count of breaks does. A segment lies inside one range,
    or it is the first or the last segment of the ranges it spans; only those two of each range are
    combined, by the driver (two rows a range), and broadcast back.
    """
    keys, names = list(keys), list(values)
    w_seg = W.partitionBy(BLOCK, *keys, segment)
    rows = df.withColumns({f"_m_{n}": F.max(F.col(v) if isinstance(v, str) else v).over(w_seg) for n, v in values.items()})
    seg = F.struct(_key(keys).alias("k"), F.col(segment).alias("s"))
    plain = df.select(BLOCK, seg.alias("_s"), *[(F.col(v) if isinstance(v, str) else v).alias(f"_m_{n}") for n, v in values.items()])
    per = plain.groupBy(BLOCK, "_s").agg(*[F.max(f"_m_{n}").alias(f"_m_{n}") for n in names])
    maxima = F.struct(*[f"_m_{n}" for n in names])
    ends = per.groupBy(BLOCK).agg(F.min("_s").alias("a"), F.min_by(maxima, F.col("_s")).alias("am"), F.max("_s").alias("b"), F.max_by(maxima, F.col("_s")).alias("bm"))
    found = ends.toArrow()
    total: dict = {}
    for r in found.to_pylist():
        for at, best in ((r["a"], r["am"]), (r["b"], r["bm"])):
            old = total.setdefault(_frozen(at), {"_seg": at})
            for n in names:
                old[f"_t_{n}"] = _COMBINE["max"](old.get(f"_t_{n}"), best[f"_m_{n}"])
    kinds = found.schema.field("am").type
    table = _local(df.sparkSession, list(total.values()), [pa.field("_seg", found.schema.field("a").type), *[pa.field(f"_t_{n}", kinds.field(f"_m_{n}").type) for n in names]])
    rows = rows.withColumn("_seg", seg).join(F.broadcast(table), "_seg", "left")
    rows = rows.withColumns({n: F.coalesce(f"_t_{n}", f"_m_{n}") for n in names})
    return rows.drop("_seg", *[f"_{p}_{n}" for p in ("m", "t") for n in names])


def drop_block(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK)

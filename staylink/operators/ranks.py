"""Exact order statistics of measures with any number of values (AGG-4, AGG-14).

Spark's ``percentile`` keeps one map of all distinct values of a group in one task. Here the
distinct values with their counts are laid out in ranges (operators/scan.py), and ranks are located
in three steps, none of which sees a group whole:

1. one row for each (group, range) holds the number of rows in it; a window over a group's ranges
   (no more than there are) gives the ranks at which each begins;
2. the ranks that a quantile needs (two neighbours, type 7) name the ranges they lie in;
3. only those ranges are counted up value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylink.operators.scan import BLOCK, with_block
from staylink.sources.stages import StageStore

VALUE, COUNT = "_x", "_n"


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value as double, count): nulls left out; a partial aggregate."""
    x = F.col(col).cast("double")
    return df.filter(x.isNotNull()).groupBy(*by, x.alias(VALUE)).agg(F.count(F.lit(1)).alias(COUNT))


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, matched on the group columns (null is a group); right has
    one row a group."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[F.col(c).alias(f"_g_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return left.join(renamed, on, how).drop(*[f"_g_{c}" for c in by])


def quantiles(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = (), *, ranges: int | None = None, store: StageStore | None = None) -> DataFrame:
    """(by, n, q0, q1, ..): the type-7 quantiles of :func:`value_counts` per group, ``n`` rows counted.

    h = (n - 1) p; the quantile lies between the values of ranks floor(h) and floor(h) + 1
    (from 0), linearly. Groups without a value have no row."""
    by = list(by)
    laid = with_block(counts, by, [VALUE], ranges, store)
    per = laid.groupBy(BLOCK, *by).agg(F.sum(COUNT).alias("_rows"))
    ahead = W.partitionBy(*by).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*by)
    per = per.withColumns({"_begin": F.coalesce(F.sum("_rows").over(ahead), F.lit(0)), "n": F.sum("_rows").over(group)})

    def rank(p: float, k: int) -> Column:
        low = F.floor((F.col("n") - 1) * F.lit(float(p)))
        return F.least(low + k, F.col("n") - 1).cast("long")

    wanted = F.array(*[F.struct(F.lit(2 * i + k).alias("which"), rank(p, k).alias("rank")) for i, p in enumerate(probs) for k in (0, 1)])
    inside = F.filter(wanted, lambda w: (w["rank"] >= F.col("_begin")) & (w["rank"] < F.col("_begin") + F.col("_rows")))
    places = per.select(BLOCK, *by, "n", "_begin", inside.alias("_wanted")).filter(F.size("_wanted") > 0)

    found = join_groups(laid, places, [BLOCK, *by])
    upto = W.partitionBy(BLOCK, *by).orderBy(VALUE).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumn("_end", F.col("_begin") + F.sum(COUNT).over(upto))
    here = F.filter("_wanted", lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col(COUNT)))
    found = found.select(*by, "n", VALUE, F.explode(here).alias("_w"))
    found = found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_w.which") == k, F.col(VALUE))).alias(f"_v{k}") for k in range(2 * len(probs))])
    out = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(f"q{i}"))
    return found.select(*by, F.col("n").cast("long").alias("n"), *out)

"""Report tables (AGG-2..AGG-14, SRT-2, SRT-4, FLT-6, FLT-7).

Every table is an aggregate first; shares and other whole-table numbers are then
taken over the aggregated rows (one per level), never over the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylink.operators.ranks import COUNT, VALUE, join_groups, quantiles, value_counts
from staylink.operators.scan import with_block


def _with_total(levels: DataFrame, **totals) -> DataFrame:
    """The rows of an aggregated table with whole-table numbers beside them: one row, broadcast, so
    that a table of many levels is not gathered for its shares."""
    return levels.crossJoin(F.broadcast(levels.agg(*[c.alias(n) for n, c in totals.items()])))


def frequency(df: DataFrame, col: str, *, valid_percent: bool = False) -> DataFrame:
    """AGG-7 / AGG-9 (``tabyl``, ``table(useNA="ifany")``): ``col, n, percent``.

    A null value is a level of its own. ``percent`` is a share 0..1 of all rows;
    ``valid_percent`` (optional) the share among non-null values.
    """
    g = df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))
    present = F.col(col).isNotNull()
    g = _with_total(g, _all=F.sum("n"), _valid=F.sum(F.when(present, F.col("n"))))
    out = [col, "n", (F.col("n") / F.col("_all")).alias("percent")]
    if valid_percent:
        out.append(F.when(present, F.col("n") / F.col("_valid")).alias("valid_percent"))
    return g.select(*out)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """AGG-8 (two-way ``tabyl``): one row per ``row`` level, one count column per ``col`` value.

    The column values are given, so this is a single aggregation (no job to find them);
    a null ``col`` is counted in ``NA``; a value not listed in ``other``.
    """
    y = F.col(col)
    listed = y.isin(list(values))
    return df.groupBy(row).agg(
        *[F.count_if(y == F.lit(v)).cast("long").alias(str(v)) for v in values],
        F.count_if(y.isNotNull() & ~listed).cast("long").alias("other"),
        F.count_if(y.isNull()).cast("long").alias("NA"),
    )


def level_summary(df: DataFrame, col: str, label: str) -> DataFrame:
    """AGG-10 (``tbl_summary`` of a count variable): ``variable, level, n, percent`` (percent 0..100)."""
    g = df.groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    g = _with_total(g, _all=F.sum("n"))
    return g.select(F.lit(label).alias("variable"), "level", "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent"))


def median_summary(df: DataFrame, col: str, label: str) -> DataFrame:
    """AGG-10, the form for variables of many values: one row ``variable, n, median, q1, q3``.
    Which form a variable takes is the caller's choice, so the columns never depend on the data."""
    return describe(df, col).select(F.lit(label).alias("variable"), "n", "median", "q1", "q3")


def summary_by(df: DataFrame, by: str, col: str, label: str) -> DataFrame:
    """AGG-11 (``tbl_summary(by=)``): ``by, variable, level, n, percent`` with column percents
    (share within the stratum, 0..100). Rows with a null stratum are left out, as there."""
    g = (
        df.filter(F.col(by).isNotNull())
        .groupBy(by, F.col(col).alias("level"))
        .agg(F.count(F.lit(1)).cast("long").alias("n"))
    )
    return g.select(
        by,
        F.lit(label).alias("variable"),
        "level",
        "n",
        (F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(by))).alias("percent"),
    )


QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, col: str, *, by: Sequence[str] = (), approx: bool = False, few_values: bool = True, ranges: int | None = None) -> DataFrame:
    """AGG-2..AGG-5: ``n, n_missing, mean, sd, min, q1, median, q3, max``.

    Quantiles are R's type 7 (linear interpolation); nulls are left out and counted in
    ``n_missing``. ``few_values`` says that the measure has few distinct values (days of stay):
    Spark's exact ``percentile`` then counts them in one aggregate. Without it the values are
    ranked in ranges (operators/ranks.py), whatever their number. ``approx=True`` uses
    ``percentile_approx``.
    """
    x = F.col(col)
    aggs = [
        F.count(x).cast("long").alias("n"),
        F.count_if(x.isNull()).cast("long").alias("n_missing"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    ]
    names = ["n", "n_missing", "mean", "sd", "min", "q1", "median", "q3", "max"]
    if approx:
        aggs.append(F.percentile_approx(x, list(QUARTILES), 10000).alias("_q"))
    elif few_values:
        aggs.append(F.percentile(x, F.array(*[F.lit(p) for p in QUARTILES])).alias("_q"))
    else:
        found = quantiles(value_counts(df, col, by), QUARTILES, by, ranges=ranges)
        found = found.select(*by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
        if not by:  # one row, also where there is no value
            found = found.agg(*[F.max(c).alias(c) for c in ("q1", "median", "q3")])
        return join_groups(df.groupBy(*by).agg(*aggs), found, by, "left").select(*by, *names)
    out = df.groupBy(*by).agg(*aggs)
    out = out.withColumns({q: F.col("_q")[i].cast("double") for i, q in enumerate(("q1", "median", "q3"))})
    return out.select(*by, *names)


def histogram(df: DataFrame, col: str, width: float = 1.0) -> DataFrame:
    """AGG-13 (data of ``geom_histogram(binwidth=)``): bins centred on multiples of ``width``.

    ``bin`` is the centre; a bin holds (centre - width/2, centre + width/2]. No row is
    dropped: the plot's axis limits only zoom.
    """
    x = F.col(col).cast("double")
    centre = (F.ceil(x / F.lit(width) - F.lit(0.5)) * F.lit(width)).cast("double")
    return df.filter(x.isNotNull()).groupBy(centre.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def box_stats(df: DataFrame, col: str, *, by: Sequence[str] = (), few_values: bool = True, ranges: int | None = None) -> DataFrame:
    """AGG-14 (data of ``geom_boxplot``): hinges, whiskers and outliers per stratum.

    Hinges are type-7 quartiles; a whisker reaches the most extreme value within 1.5 IQR
    of its hinge; the rest are outliers. The rows are read once and reduced to (stratum,
    value, n). The quartiles come from that table (see :func:`describe` for ``few_values``), one
    row a stratum; beside them a second aggregate of the same table finds the whiskers. No task
    holds the values of a stratum.
    """
    counts = value_counts(df, col, by)
    if few_values:
        q = F.percentile(VALUE, F.array(*[F.lit(p) for p in QUARTILES]), F.col(COUNT))
        hinges = counts.groupBy(*by).agg(F.sum(COUNT).cast("long").alias("n"), q.alias("_q")).filter("n is not null")
        hinges = hinges.select(*by, "n", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    else:
        counts = with_block(counts, list(by), [VALUE], ranges)  # both steps read the written table
        hinges = quantiles(counts, QUARTILES, by)
        hinges = hinges.select(*by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(VALUE) >= lo) & (F.col(VALUE) <= hi)
    return (
        join_groups(counts, hinges, by)
        .groupBy(*by, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(VALUE))).alias("whisker_low"),
            F.max(F.when(inside, F.col(VALUE))).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col(COUNT))).cast("long").alias("n_outliers"),
        )
    )


def top_k(df: DataFrame, measure: str, k: int, *, tiebreak: Sequence[str]) -> DataFrame:
    """SRT-2 / SRT-4: the ``k`` rows with the largest ``measure`` (ties by ``tiebreak``).

    ``orderBy().limit()`` is planned as a top-k per task and a merge of k rows each;
    nothing else is sorted. A limit is the feature here (a report of the k longest).
    """
    order = [F.desc_nulls_last(measure), *[F.asc_nulls_last(c) for c in tiebreak]]
    return df.filter(F.col(measure).isNotNull()).orderBy(*order).limit(int(k))


def exclude_top_k(df: DataFrame, measure: str, k: int, *, key: Sequence[str]) -> DataFrame:
    """FLT-7: the rows without the ``k`` largest ``measure`` values (the typed-in list of the
    reference, as a rule). The k keys are a bounded table, broadcast to an anti join."""
    top = top_k(df, measure, k, tiebreak=key).select(*key)
    return df.join(F.broadcast(top), list(key), "left_anti")

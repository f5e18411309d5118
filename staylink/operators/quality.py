"""Data-quality and profile operators (DQ-1..DQ-3, DQ-8, SET-2) and the ingest report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylink.config import EpisodeCols, Study
from staylink.operators.scan import drop_block, ordered_scan


def profile(df: DataFrame) -> DataFrame:
    """DQ-1 / DQ-2 (``generate_dictionary``): ``position, column, type, n_rows, n_missing``.

    All columns in one aggregation (one pass over the data), then unpivoted into one row
    per column; the types come from the schema, not from the data.
    """
    aggs = [F.count(F.lit(1)).cast("long").alias("_n")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).cast("long").alias(f"_m{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("_n").alias("n_rows"),
            F.col(f"_m{i}").alias("n_missing"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def check_type(df: DataFrame, column: str, expected: T.DataType) -> None:
    """DQ-2 (``str(col)``): fail early if a column does not have the expected type."""
    actual = df.schema[column].dataType
    if actual != expected:
        raise TypeError(f"{column} is {actual.simpleString()}, expected {expected.simpleString()}")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """SET-2 detail: each whole-row value that occurs more than once, with its count ``n``."""
    cols = df.columns
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("long").alias("n")).filter(F.col("n") > 1)


def duplicate_report(df: DataFrame, name: str) -> DataFrame:
    """SET-2 / DQ-3 (``any(duplicated(df))``): one row ``table, n_rows, n_distinct, n_excess,
    has_duplicates``. One aggregation on all columns (copies collapse map-side), then a
    second over its groups."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(
        F.lit(name).alias("table"),
        F.sum("_n").cast("long").alias("n_rows"),
        F.count(F.lit(1)).cast("long").alias("n_distinct"),
        F.sum(F.col("_n") - 1).cast("long").alias("n_excess"),
    ).withColumn("has_duplicates", F.col("n_excess") > 0)


def spot_check(df: DataFrame, key: str, value, columns: list[str]) -> DataFrame:
    """DQ-8: the rows of one key, for a look by eye (tests check invariants instead)."""
    return df.filter(F.col(key) == F.lit(value)).select(*columns)


def violations(stays: DataFrame, cols: EpisodeCols = EpisodeCols()) -> DataFrame:
    """DQ-8 over the whole table instead of one person by eye: ``rule, n_checked, n_violations``.

    - ``person_seq_gap``: a person's episodes are numbered 1, 2, .. (the cohort keeps whole persons)
    - ``hip_seq_gap``: hip episodes are numbered 1, 2, .. within a person
    - ``stay_seq_gap``: stays are numbered 1, 2, .. within a person
    - ``trans_seq_gap``: a stay's episodes are numbered 0, 1, ..
    - ``stay_totals``: a stay's size, first admission and last discharge are those of its episodes, and
      its length their difference
    - ``negative_stay``: no stay ends before it begins
    - ``overlapping_stays``: no stay begins before the one before it has ended

    Partial aggregates by person and by stay; the last rule is a running maximum in ranges. No
    person's rows come together.
    """
    p, start, end = cols.person, F.col(cols.start), F.col(cols.end)
    per_person = stays.groupBy(p).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("person_seq").alias("d"),
        F.max("person_seq").alias("m"),
        F.count_if(F.col("hip_seq") > 0).alias("hn"),
        F.sum("hip_seq").alias("hs"),
        F.max("hip_seq").alias("hm"),
        F.countDistinct("stay_seq").alias("sn"),
        F.max("stay_seq").alias("sm"),
        F.min("stay_seq").alias("s1"),
    )
    # a cohort keeps all hip episodes of a person, so their numbers 1..n add up to n (n + 1) / 2
    by_person = {
        "person_seq_gap": (F.col("d") != F.col("n")) | (F.col("m") != F.col("n")),
        "hip_seq_gap": (F.col("hm") != F.col("hn")) | (F.col("hs") * 2 != F.col("hn") * (F.col("hn") + 1)),
        "stay_seq_gap": (F.col("sm") != F.col("sn")) | (F.col("s1") != 1),
    }
    per_stay = stays.groupBy(p, "stay_seq").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("trans_seq").alias("d"),
        F.min("trans_seq").alias("t0"),
        F.max("trans_seq").alias("t1"),
        F.min(F.struct("stay_size", "admdate_first", "sepdate_last", "totlos")).alias("lo"),
        F.max(F.struct("stay_size", "admdate_first", "sepdate_last", "totlos")).alias("hi"),
        F.min(start).alias("adm"),
        F.max(end).alias("sep"),
    )
    length = F.datediff("sep", "adm")
    by_stay = {
        "trans_seq_gap": (F.col("t0") != 0) | (F.col("t1") != F.col("n") - 1) | (F.col("d") != F.col("n")),
        "stay_totals": (F.col("lo") != F.col("hi"))
        | (F.col("lo.stay_size") != F.col("n"))
        | (F.col("lo.admdate_first") != F.col("adm"))
        | (F.col("lo.sepdate_last") != F.col("sep"))
        | (F.col("lo.totlos") != length),
        "negative_stay": length < 0,
    }

    def table(units: DataFrame, rules: dict) -> DataFrame:
        one = units.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(bad, F.lit(True))).alias(f"_{r}") for r, bad in rules.items()])
        rows = [F.struct(F.lit(r).alias("rule"), F.col("_n").cast("long").alias("n_checked"), F.col(f"_{r}").cast("long").alias("n_violations")) for r in rules]
        return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")

    ordered = ordered_scan(drop_block(stays), [p], cols.order(), {"_before": ("max_before", F.col("sepdate_last"))})
    firsts = drop_block(ordered).filter(F.col("trans_seq") == 0)
    overlap = {"overlapping_stays": F.col("_before").isNotNull() & (start < F.col("_before"))}
    return table(per_person, by_person).unionByName(table(per_stay, by_stay)).unionByName(table(firsts, overlap))


def ingest_report(typed: DataFrame, cols: EpisodeCols = EpisodeCols(), study: Study = Study(), rejects: DataFrame | None = None) -> DataFrame:
    """What DOM-1 drops, counted (survey rule: rejected rows are counted, not lost silently).

    One row: ``n_rows, n_duplicate`` (copies beyond the first), then among distinct rows
    ``n_missing_person, n_missing_start, n_missing_end, n_outside_period`` (dates present
    but not inside the period) and ``n_kept``. One aggregation on all columns, then one
    over its groups. With the ``rejects`` of the extract (SRC-1) also ``n_rejected``, its malformed
    lines.
    """
    g = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("_c"))
    start, end, person = F.col(cols.start), F.col(cols.end), F.col(cols.person)
    inside = (start >= F.lit(study.start)) & (end <= F.lit(study.end))
    out = g.agg(
        F.sum("_c").cast("long").alias("n_rows"),
        F.sum(F.col("_c") - 1).cast("long").alias("n_duplicate"),
        F.count_if(person.isNull()).cast("long").alias("n_missing_person"),
        F.count_if(start.isNull()).cast("long").alias("n_missing_start"),
        F.count_if(end.isNull()).cast("long").alias("n_missing_end"),
        F.count_if(start.isNotNull() & end.isNotNull() & ~inside).cast("long").alias("n_outside_period"),
        F.count_if(inside & person.isNotNull()).cast("long").alias("n_kept"),
    )
    if rejects is None:
        return out
    return out.crossJoin(F.broadcast(rejects.agg(F.count(F.lit(1)).cast("long").alias("n_rejected"))))  # one row each

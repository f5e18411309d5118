"""Death records: checks, conflict resolution and linkage (FLT-9, DQ-4..DQ-6, JN-1, FLT-4, FLT-5).

The reference resolves three persons with two death records by looking at their
episodes and typing the outcome in. Here that judgement is a rule, applied only
to persons with more than one distinct record:

1. a record is dropped if one of the person's episodes starts after it;
2. of the records left, the latest is kept;
3. if none is left, or the person is on the exclusion list, the person is dropped
   from both the deaths and the episodes.

A person with one record keeps it, even with later episodes (reported by
:func:`death_vs_episodes`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.config import DeathCols, EpisodeCols
from staylink.functions.dates import parse_dmy
from staylink.operators.episodes import _id


def type_deaths(raw: DataFrame, dcols: DeathCols = DeathCols(), date_parser=parse_dmy, id_type: str | None = None) -> DataFrame:
    """Text death records (SRC-1) to typed ones; exact duplicates dropped (SET-1). Ids keep
    their type unless ``id_type`` names one (see :func:`staylink.operators.episodes.type_episodes`)."""
    return raw.withColumns(
        {
            dcols.person: _id(dcols.person, id_type),
            dcols.date: date_parser(dcols.date),
            dcols.age: F.col(dcols.age).try_cast("double").cast("int"),
        }
    ).distinct()


def multi_records(deaths: DataFrame, dcols: DeathCols = DeathCols()) -> DataFrame:
    """FLT-9 / DQ-4: all records of persons with more than one distinct record."""
    d = deaths.filter(F.col(dcols.person).isNotNull()).distinct()
    many = d.groupBy(dcols.person).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return d.join(many.select(dcols.person), dcols.person, "left_semi")


def death_vs_episodes(
    deaths: DataFrame,
    episodes: DataFrame,
    cols: EpisodeCols = EpisodeCols(),
    dcols: DeathCols = DeathCols(),
) -> DataFrame:
    """DQ-5: per distinct death record, the person's episodes and those starting after it.

    Episodes are first reduced to (person, start day) counts, so a person with a very
    long history brings one row per admission day to the join, not one per episode.
    """
    d = deaths.filter(F.col(dcols.person).isNotNull()).distinct()  # no person, no link
    days = (
        episodes.groupBy(F.col(cols.person).alias(dcols.person), F.col(cols.start).alias("_start"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    j = d.join(days, dcols.person, "left")
    after = F.col("_start") > F.col(dcols.date)
    return j.groupBy(dcols.person, dcols.date, dcols.age).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_episodes"),
        F.coalesce(F.sum(F.when(after, F.col("_n"))), F.lit(0)).cast("long").alias("n_after"),
        F.max("_start").alias("last_start"),
    )


def resolve_deaths(
    deaths: DataFrame,
    episodes: DataFrame,
    cols: EpisodeCols = EpisodeCols(),
    dcols: DeathCols = DeathCols(),
    exclude: Sequence = (),
) -> DataFrame:
    """DQ-6: one row per person with a death record: person, death date and age of the record
    kept, and ``drop_reason`` (null if kept; else the person leaves both tables).

    One table for both outcomes, so the records meet the episodes once.
    """
    checked = death_vs_episodes(deaths, episodes, cols, dcols)
    rec = F.struct(F.col(dcols.date).alias("d"), F.col(dcols.age).alias("a"))
    per = checked.groupBy(dcols.person).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.max_by(rec, F.col(dcols.date)).alias("_only"),
        F.max_by(rec, F.when(F.col("n_after") == 0, rec)).alias("_latest_valid"),
    )
    kept = F.when(F.col("n_records") == 1, F.col("_only")).otherwise(F.col("_latest_valid"))
    excluded = F.col(dcols.person).isin(list(exclude)) if exclude else F.lit(False)
    per = per.withColumn("_kept", F.when(~excluded, kept))
    reason = F.when(excluded, F.lit("excluded")).when(F.col("_kept").isNull(), F.lit("no record before the last episode"))
    return per.select(dcols.person, F.col("_kept.d").alias(dcols.date), F.col("_kept.a").alias(dcols.age), reason.alias("drop_reason"))


def kept_records(resolution: DataFrame) -> DataFrame:
    """The death records that remain, one per person."""
    return resolution.filter(F.col("drop_reason").isNull()).drop("drop_reason")


def dropped_persons(resolution: DataFrame, dcols: DeathCols = DeathCols()) -> DataFrame:
    """FLT-5: the persons removed from both tables, with the reason."""
    return resolution.filter(F.col("drop_reason").isNotNull()).select(dcols.person, F.col("drop_reason").alias("reason"))


def link_deaths(episodes: DataFrame, resolution: DataFrame, cols: EpisodeCols = EpisodeCols(), dcols: DeathCols = DeathCols()) -> DataFrame:
    """JN-1 / FLT-5: attach the one death record per person, then leave out dropped persons.

    The resolution is unique per person, so the one left join never multiplies episodes.
    Its side is left to AQE: broadcast from its measured size, otherwise a sort-merge join
    whose skewed partitions are split.
    """
    r = resolution.select(
        F.col(dcols.person).alias(cols.person), F.col(dcols.date).alias("death_date"), F.col(dcols.age).alias("age_death"), "drop_reason"
    )
    return episodes.join(r, cols.person, "left").filter(F.col("drop_reason").isNull()).drop("drop_reason")

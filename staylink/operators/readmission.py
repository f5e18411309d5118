"""Next admission, censoring and the outcome table (DOM-8, DOM-9, DOM-11, DQ-7, JN-3, JN-4, JN-6, JN-7).

The next admission is an as-of join forward and strict: for each person's index
discharge, the earliest admission that starts on a later day. The admissions are
joined on the person to the single index row, filtered by ``start > discharge`` and reduced by ``min`` per
person (a partial aggregate). The index table has one row per person, so the join
emits at most one row per admission; no pairs within a person are formed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.config import EpisodeCols
from staylink.functions.dates import days_between, least_date
from staylink.functions.flags import if_else


def index_episodes(
    stays: DataFrame, cols: EpisodeCols = EpisodeCols(), *, seq_col: str = "hip_seq"
) -> DataFrame:
    """The first hip episode of each person with its stay's discharge date (PRJ-4)."""
    return stays.filter(F.col(seq_col) == 1).withColumn("discharge_date", F.col("sepdate_last"))


def next_admission(
    index: DataFrame, admissions: DataFrame, cols: EpisodeCols = EpisodeCols()
) -> DataFrame:
    """DOM-8: ``index`` rows with ``next_admission_date``: the earliest start of any
    admission (hip or not) strictly after the discharge day; null if none.

    Only admissions of the index persons take part (the inner join is the semi join
    of the reference's ``id %in% first_hip$id``); a same-day readmission does not count.
    """
    days = admissions.select(cols.person, cols.start)  # min needs no distinct days
    anchor = index.select(cols.person, "discharge_date")
    nxt = (
        days.join(anchor, cols.person)
        .filter(F.col(cols.start) > F.col("discharge_date"))
        .groupBy(cols.person)
        .agg(F.min(cols.start).alias("next_admission_date"))
    )
    return index.join(nxt, cols.person, "left")


def censor_times(df: DataFrame, study_end: dt.date, *, death_col: str = "death_date") -> DataFrame:
    """DOM-9: ``event`` (1 = readmitted), ``censor_date`` = earlier of death and study end,
    ``followup_end`` = next admission if readmitted else censor date (the reference's
    ``end_date``, renamed so it does not replace the episode end), ``time_to_next`` in days."""
    event = F.col("next_admission_date").isNotNull()
    censor = least_date(death_col, F.lit(study_end))
    return df.withColumns(
        {
            "event": event.cast("int"),
            "censor_date": censor,
            "followup_end": if_else(event, F.col("next_admission_date"), censor),
        }
    ).withColumn("time_to_next", days_between("followup_end", "discharge_date"))


def negative_times(df: DataFrame, *, time_col: str = "time_to_next") -> DataFrame:
    """DQ-7: how many times are negative (a death date before the discharge); expected 0."""
    t = F.col(time_col)
    return df.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_if(t < 0).cast("long").alias("n_negative"),
        F.count_if(t.isNull()).cast("long").alias("n_missing"),
    )


def outcome_table(
    df: DataFrame, group: str, study_end: dt.date, *, death_col: str = "death_date"
) -> DataFrame:
    """DOM-11: per group: total, readmitted, censored by death (on or before the study end),
    censored by the end of the study (no death, or a later one), percent readmitted.
    The three parts add up to the total."""
    ev = F.col("event") == 1
    death = F.col(death_col)
    by_death = ~ev & death.isNotNull() & (death <= F.lit(study_end))
    by_end = ~ev & (death.isNull() | (death > F.lit(study_end)))
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).cast("long").alias("total_patients"),
        F.count_if(ev).cast("long").alias("readmitted"),
        F.count_if(by_death).cast("long").alias("censored_death"),
        F.count_if(by_end).cast("long").alias("censored_end"),
    )
    return g.withColumn("readmitted_prop", F.col("readmitted") / F.col("total_patients") * 100.0)

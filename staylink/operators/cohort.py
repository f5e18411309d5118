"""Cohort selection and its first answers (DOM-5, DOM-6, JN-5, AGG-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.config import EpisodeCols
from staylink.operators.report import frequency


def select_cohort(
    df: DataFrame, cols: EpisodeCols = EpisodeCols(), *, hip_col: str = "hip_flag", age_col: str = "age_flag"
) -> DataFrame:
    """DOM-5 / JN-5: every episode of the persons who have one episode that is both a hip
    episode and at or above the age threshold (on the same row).

    A semi join with the distinct qualifying persons: no window over a whole person, and
    AQE can split a person with very many episodes across tasks (skew join).
    Sequences must be made before this step; it keeps a person's earlier episodes,
    including a hip episode before the age threshold.
    """
    qualifying = df.filter((F.col(hip_col) == 1) & (F.col(age_col) == 1)).select(cols.person).distinct()
    return df.join(qualifying, cols.person, "left_semi")


def cohort_size(df: DataFrame, cols: EpisodeCols = EpisodeCols()) -> DataFrame:
    """AGG-1: number of persons and of episodes."""
    return df.agg(
        F.countDistinct(cols.person).cast("long").alias("n_persons"),
        F.count(F.lit(1)).cast("long").alias("n_episodes"),
    )


def first_by_year(df: DataFrame, cols: EpisodeCols = EpisodeCols(), *, seq_col: str = "hip_seq") -> DataFrame:
    """DOM-6: first hip admissions by calendar year of admission: ``year, n, percent``."""
    first = df.filter(F.col(seq_col) == 1).select(F.year(cols.start).cast("int").alias("year"))
    return frequency(first, "year")

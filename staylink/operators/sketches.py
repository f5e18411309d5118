"""AGG-1 at scale: mergeable distinct counts of persons.

An exact count over a span of years needs the persons of all its years again. A HyperLogLog sketch
of each year and stratum is made once, takes a few kilobytes whatever the number of persons, and
sketches of any years unite to the sketch of the span.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the number of registers: 4096, a few kilobytes a sketch.
LG_K = 12


def relative_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """The relative error of a united sketch that ``deviations`` standard deviations allow."""
    return deviations * 1.04 / math.sqrt(1 << lg_k)


def person_sketches(df: DataFrame, person: str, date: str, strata: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """(year, strata, sketch): one row for each year and stratum; partial sketches are combined map-side.
    Null persons and dates take no part."""
    seen = df.filter(F.col(person).isNotNull() & F.col(date).isNotNull())
    return seen.groupBy(F.year(date).alias("year"), *strata).agg(F.hll_sketch_agg(person, lg_k).alias("sketch"))


def _spans(df: DataFrame, year: str, spans: Sequence[tuple[int, int]]) -> DataFrame:
    """Each row once for every span (both ends inclusive) that holds its year."""
    table = F.array(*[F.struct(F.lit(lo).alias("from_year"), F.lit(hi).alias("to_year")) for lo, hi in spans])
    mine = F.filter(table, lambda s: (F.col(year) >= s["from_year"]) & (F.col(year) <= s["to_year"]))
    return df.withColumn("_span", F.explode(mine))


def persons_in_spans(sketches: DataFrame, spans: Sequence[tuple[int, int]], strata: Sequence[str] = ()) -> DataFrame:
    """(from_year, to_year, strata, n_estimate): persons seen in any year of the span, from the sketches alone."""
    rows = _spans(sketches, "year", spans)
    united = rows.groupBy("_span.from_year", "_span.to_year", *strata).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimate"))
    return united.select("from_year", "to_year", *strata, F.col("n_estimate").cast("long").alias("n_estimate"))


def exact_in_spans(df: DataFrame, person: str, date: str, spans: Sequence[tuple[int, int]], strata: Sequence[str] = ()) -> DataFrame:
    """(from_year, to_year, strata, n_persons): the same counted exactly, from the persons of every year."""
    years = df.filter(F.col(person).isNotNull()).select(person, *strata, F.year(date).alias("_year")).distinct()
    rows = _spans(years, "_year", spans)
    return rows.groupBy("_span.from_year", "_span.to_year", *strata).agg(F.countDistinct(person).cast("long").alias("n_persons"))

"""

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole fixture views
of that folder. Computed columns carry the same names as in ``oracle.py``; doubles
are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylink.config import EpisodeCols, scratch_dir
from staylink.functions.dates import parse_dmy, parse_ymd
from staylink.operators import quality, report, sketches
from staylink.operators.asof import next_admissions, next_after
from staylink.operators.cohort import cohort_size, first_by_year
from staylink.operators.comorbidity import GROUP_LABELS, charlson_map, charlson_prefix_lengths, comorbidity_score
from staylink.operators.deaths import death_vs_episodes, kept_records, multi_records, resolve_deaths
from staylink.operators.deaths import dropped_persons as removed_persons
from staylink.operators.episodes import add_flags, clean_episodes, file_sequence, sequence_episodes, type_episodes
from staylink.operators.readmission import negative_times, outcome_table
from staylink.operators.survival import (
    excluded_subjects,
    km_at_times,
    km_median,
    km_table,
    logrank_parts,
    logrank_test,
    report_times,
)
from staylink.operators.stays import transfer_stays
from staylink.plans.pipeline import Analysis
from staylink.sources import fixtures
from staylink.sources.csv import read_with_rejects

Query = Callable[[SparkSession, str], DataFrame]


def _round(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (both sides of the oracle check do the same)."""
    return df.select(
        *[
            F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, length and modification time of every file that the fixture views read, and the
    application that wrote stages from them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = [spark.sparkContext.applicationId]
    for name in ("orders", "lineitem", "customer", "part"):
        at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = at.getFileSystem(conf).listStatus(at)
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return tuple(out)


#: The analysis of the input that was asked for last, and that input's version: queries on the
#: same files share its stages, and changed files or another folder make a new one.
_LAST: dict[str, tuple[tuple, Analysis]] = {}


def _a(spark: SparkSession, sf_dir: str) -> Analysis:
    version = _version(spark, sf_dir)
    if "last" not in _LAST or _LAST["last"][0] != version:
        _LAST["last"] = (version, Analysis(spark, sf_dir))
    return _LAST["last"][1]


# ---- part one: ingest, flags, sequences, cohort ----------------------------------------
def ingest_clean(spark, sf_dir):
    """DOM-1 / SRC-1 / SCL-1: text episodes (mixed day-month-year layouts) typed, distinct, period."""
    raw = fixtures.fx_episode_text(spark, sf_dir)
    return clean_episodes(type_episodes(raw, id_type="bigint"))


def ingest_report(spark, sf_dir):
    """DOM-1 / SRC-1: what the clean step drops from the text episodes, counted."""
    return quality.ingest_report(type_episodes(fixtures.fx_episode_text(spark, sf_dir), id_type="bigint"))


def duplicate_report(spark, sf_dir):
    """SET-2 / DQ-3 on the three fixture tables."""
    parts = [
        quality.duplicate_report(fixtures.fx_episode(spark, sf_dir), "fx_episode"),
        quality.duplicate_report(fixtures.fx_death(spark, sf_dir), "fx_death"),
        quality.duplicate_report(fixtures.fx_diagnosis(spark, sf_dir), "fx_diagnosis"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def profile(spark, sf_dir):
    """DQ-1 / DQ-2 on the episode view."""
    return quality.profile(fixtures.fx_episode(spark, sf_dir))


def flag_table(spark, sf_dir):
    """DOM-2 / AGG-9: ``table(flag_65, useNA = "ifany")`` on the period's episodes."""
    return _round(report.frequency(_a(spark, sf_dir).episodes, "age_flag"))


# ---- the same on a view with missing values and repeated rows -------------------------------
def _dirty_clean(spark, sf_dir) -> DataFrame:
    return add_flags(clean_episodes(fixtures.fx_episode_dirty(spark, sf_dir)))


def ingest_csv_dirty(spark, sf_dir):
    """SRC-1 / DOM-1 / SET-1: the dirty view written as CSV text with malformed lines in it, read
    back, typed, cleaned. Ids keep their type (text); a malformed line is no row."""
    rows, _ = _broken_csv(spark, sf_dir)
    return clean_episodes(type_episodes(rows))


def ingest_rejects(spark, sf_dir):
    """SRC-1: the malformed lines of the same files, counted by reason."""
    _, rejects = _broken_csv(spark, sf_dir)
    return rejects.groupBy("reason", "n_fields").agg(F.count(F.lit(1)).cast("long").alias("n_lines"), F.countDistinct("line").cast("long").alias("n_distinct"))


def _broken_csv(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    path = scratch_dir(spark, f"csv-{uuid.uuid4().hex}")
    fixtures.write_broken_csv(spark, sf_dir, path)
    return read_with_rejects(spark, path, EpisodeCols().all())


def ingest_report_dirty(spark, sf_dir):
    """DOM-1: every count of the ingest report above zero."""
    return quality.ingest_report(fixtures.fx_episode_dirty(spark, sf_dir))


def profile_dirty(spark, sf_dir):
    """DQ-1 / DQ-2 with missing values."""
    return quality.profile(fixtures.fx_episode_dirty(spark, sf_dir))


def duplicate_report_dirty(spark, sf_dir):
    """SET-2 / DQ-3 with repeated rows."""
    return quality.duplicate_report(fixtures.fx_episode_dirty(spark, sf_dir), "fx_episode_dirty")


def flag_table_dirty(spark, sf_dir):
    """DOM-2 / AGG-9 with the row for missing ages, and the valid percent."""
    return _round(report.frequency(_dirty_clean(spark, sf_dir), "age_flag", valid_percent=True))


def mode_crosstab_dirty(spark, sf_dir):
    """AGG-8 / FLT-11 with missing modes and codes."""
    return report.crosstab(_dirty_clean(spark, sf_dir), "hip_flag", "mode", MODES)


def date_layouts(spark, sf_dir):
    """SCL-1 / SCL-2: eight day-month-year layouts and ISO text parsed over all orders."""
    t = fixtures.fx_date_text(spark, sf_dir)
    return t.select("o_orderkey", parse_dmy("dmy").alias("dmy"), parse_ymd("ymd").alias("ymd"))


def episode_sequences_hot(spark, sf_dir):
    """DOM-3 with a person of a third of all episodes and a person whose episodes share one day."""
    return sequence_episodes(fixtures.fx_episode_hot(_a(spark, sf_dir).episodes)).select(*SEQ_COLS)


def transfer_stays_hot(spark, sf_dir):
    """DOM-4 on the same two persons."""
    return transfer_stays(fixtures.fx_episode_hot(_a(spark, sf_dir).episodes)).select(*STAY_COLS)


SEQ_COLS = [
    "person_id", "episode_id", "start_date", "end_date", "age_flag", "hip_flag",
    "file_seq", "person_seq", "hip_cumcount", "post_index", "index_seq", "hip_seq",
]


def episode_sequences(spark, sf_dir):
    """DOM-3 / WIN-1..WIN-6."""
    return _a(spark, sf_dir).sequenced.select(*SEQ_COLS)


def file_sequence_q(spark, sf_dir):
    """WIN-1 alone."""
    return file_sequence(_a(spark, sf_dir).episodes).select("person_id", "episode_id", "file_seq")


def cohort(spark, sf_dir):
    """DOM-5 / JN-5: all episodes of qualifying persons."""
    return _a(spark, sf_dir).cohort.select(
        "person_id", "episode_id", "age", "age_flag", "hip_flag", "person_seq", "hip_seq"
    )


def cohort_size_q(spark, sf_dir):
    """AGG-1."""
    return cohort_size(_a(spark, sf_dir).cohort)


def first_by_year_q(spark, sf_dir):
    """DOM-6 / AGG-7 / SCL-4."""
    return _round(first_by_year(_a(spark, sf_dir).cohort))


# ---- deaths and linkage ----------------------------------------------------------------
def multi_death(spark, sf_dir):
    """FLT-9 / DQ-4."""
    return multi_records(_a(spark, sf_dir).deaths)


def death_vs_episodes_q(spark, sf_dir):
    """DQ-5: each death record against the cohort's episodes."""
    a = _a(spark, sf_dir)
    return death_vs_episodes(a.deaths, a.cohort)


def resolved_deaths(spark, sf_dir):
    """DQ-6 / FLT-4: one record per person."""
    return kept_records(_a(spark, sf_dir).resolution)


def dropped_persons(spark, sf_dir):
    """DQ-6 / FLT-5: persons removed from both tables."""
    return removed_persons(_a(spark, sf_dir).resolution)


def resolved_deaths_excluded(spark, sf_dir):
    """DQ-6 / FLT-5 with an exclusion list: every person with the outcome."""
    a = _a(spark, sf_dir)
    return resolve_deaths(a.deaths, a.cohort, exclude=list(EXCLUDED))


def linked(spark, sf_dir):
    """JN-1 / PRJ-3."""
    return _a(spark, sf_dir).linked.select(
        "person_id", "episode_id", "start_date", "end_date", "hip_seq", "death_date", "age_death"
    )


def linked_size(spark, sf_dir):
    """AGG-1 on the linked table: individuals and episodes after the death resolution."""
    return cohort_size(_a(spark, sf_dir).linked)


# ---- transfer stays ---------------------------------------------------------------------
STAY_COLS = [
    "person_id", "episode_id", "start_date", "end_date", "mode", "stay_seq", "trans_seq",
    "stay_size", "admdate_first", "sepdate_last", "totlos",
]


def transfer_stays_q(spark, sf_dir):
    """DOM-4."""
    return _a(spark, sf_dir).stays.select(*STAY_COLS)


def stay_episode_freq(spark, sf_dir):
    """DOM-13: ``tabyl(transseq)`` of the first hip episodes."""
    first = _a(spark, sf_dir).stays.filter(F.col("hip_seq") == 1)
    return _round(report.frequency(first, "trans_seq"))


def stay_size_freq(spark, sf_dir):
    """DOM-13, second column: the size of the stay holding the first hip episode."""
    first = _a(spark, sf_dir).stays.filter(F.col("hip_seq") == 1)
    return _round(report.frequency(first, "stay_size"))


def longest_chain(spark, sf_dir):
    """DOM-13: who has the highest ``trans_seq`` on a first hip episode (the typed-in 14)."""
    first = _a(spark, sf_dir).stays.filter(F.col("hip_seq") == 1)
    top = first.agg(F.max("trans_seq").alias("trans_seq"))
    # one row: a bounded broadcast
    return first.join(F.broadcast(top), "trans_seq").select("person_id", "trans_seq", "stay_size")


def stay_violations(spark, sf_dir):
    """DQ-8: the invariants of the stays table, over the whole table."""
    return quality.violations(_a(spark, sf_dir)._stays)


def flagged_stays(spark, sf_dir):
    """WIN-7 / JN-2 / SCL-9 / DOM-7."""
    return _a(spark, sf_dir).hip_stays.select(
        "person_id", "episode_id", "stay_seq", "trans_seq", "hip_flag", "hip_seq", "hf_stays_all"
    )


def stays_per_person(spark, sf_dir):
    """DOM-7 / AGG-2 / AGG-10: hip admissions per person, without and with transfers."""
    hs = _a(spark, sf_dir).hip_stays.filter(F.col("hip_flag") == 1)
    per = hs.groupBy("person_id").agg(F.max("hip_seq").alias("hip_seq"), F.max("hf_stays_all").alias("hf_stays_all"))
    a = report.level_summary(per, "hip_seq", "hip admissions ignoring transfers")
    b = report.level_summary(per, "hf_stays_all", "hip admissions accounting for transfers")
    return _round(a.unionByName(b))


MODES = ["F", "O", "P"]


def mode_crosstab(spark, sf_dir):
    """AGG-8: ``tabyl(hip_seq, mode)`` over all stays rows."""
    return report.crosstab(_a(spark, sf_dir).stays, "hip_seq", "mode", MODES)


def mode_summary(spark, sf_dir):
    """AGG-11: ``tbl_summary(by = mode, include = hip_seq / hf_stays_all)``."""
    hs = _a(spark, sf_dir).hip_stays
    a = report.summary_by(hs, "mode", "hip_seq", "hip admissions ignoring transfers")
    b = report.summary_by(hs, "mode", "hf_stays_all", "hip admissions accounting for transfers")
    return _round(a.unionByName(b))


# ---- length of stay ---------------------------------------------------------------------
def _first_los(spark, sf_dir) -> DataFrame:
    return _a(spark, sf_dir).stays.filter(F.col("hip_seq") == 1).select("person_id", "hip_seq", "totlos")


def los_stats(spark, sf_dir):
    """AGG-3 / AGG-4: mean, sd, quartiles of the total stay for the first hip episode."""
    return _round(report.describe(_first_los(spark, sf_dir), "totlos"))


def los_stats_trimmed(spark, sf_dir):
    """FLT-7 + AGG-3 / AGG-4: the same without the five longest stays."""
    trimmed = report.exclude_top_k(_first_los(spark, sf_dir), "totlos", 5, key=["person_id"])
    return _round(report.describe(trimmed, "totlos"))


def los_histogram(spark, sf_dir):
    """AGG-13."""
    return _round(report.histogram(_first_los(spark, sf_dir), "totlos", 1.0))


def los_box(spark, sf_dir):
    """AGG-14."""
    return _round(report.box_stats(_first_los(spark, sf_dir), "totlos"))


def los_box_by_mode(spark, sf_dir):
    """AGG-14 per mode of separation."""
    first = _a(spark, sf_dir).stays.filter(F.col("hip_seq") == 1)
    return _round(report.box_stats(first, "totlos", by=["mode"]))


def summary_median(spark, sf_dir):
    """AGG-10, the median (Q1, Q3) form."""
    return _round(report.median_summary(_first_los(spark, sf_dir), "totlos", "length of stay"))


def longest_stays(spark, sf_dir):
    """SRT-2 / SRT-4: the five longest (ties by person id)."""
    return report.top_k(_first_los(spark, sf_dir), "totlos", 5, tiebreak=["person_id"])


# ---- a measure of very many distinct values ------------------------------------------------
def _prices(spark, sf_dir) -> DataFrame:
    """The price of each order line: nearly as many distinct values as lines."""
    return fixtures.load_tables(spark, sf_dir, ["lineitem"])["lineitem"].select("l_returnflag", "l_extendedprice")


def price_quantiles(spark, sf_dir):
    """AGG-3 / AGG-4 by exact ranks: quartiles of a measure whose values no task could hold."""
    return _round(report.describe(_prices(spark, sf_dir), "l_extendedprice", by=["l_returnflag"], few_values=False))


def price_box(spark, sf_dir):
    """AGG-14 on the same measure."""
    return _round(report.box_stats(_prices(spark, sf_dir), "l_extendedprice", by=["l_returnflag"], few_values=False))


# ---- distinct persons of any span of years -------------------------------------------------
SPANS = [(y, z) for y in range(1996, 2001) for z in range(y, 2001)]


def persons_by_span(spark, sf_dir):
    """AGG-1: persons of every span of years and age group, exact beside the estimate of united
    yearly sketches; ``within`` says whether the estimate keeps the stated error."""
    episodes = _a(spark, sf_dir).episodes
    exact = sketches.exact_in_spans(episodes, "person_id", "start_date", SPANS, ["age_flag"])
    made = sketches.person_sketches(episodes, "person_id", "start_date", ["age_flag"])
    estimate = sketches.persons_in_spans(made, SPANS, ["age_flag"])
    both = exact.join(estimate, ["from_year", "to_year", "age_flag"])
    error = F.abs(F.col("n_estimate") - F.col("n_persons")) <= F.greatest(F.lit(1.0), F.col("n_persons") * sketches.relative_error())
    return both.select("from_year", "to_year", "age_flag", "n_persons", error.alias("within"))


# ---- every next event ------------------------------------------------------------------------
def next_admission_each_stay(spark, sf_dir):
    """JN-7 / DOM-8: the next admission after every discharge of every person."""
    a = _a(spark, sf_dir)
    return next_admissions(a.stays, "person_id", "start_date", ranges=a.ranges)


def event_gaps(spark, sf_dir) -> DataFrame:
    """JN-7: each event's time to the user's next event in microseconds; the last of a user is
    censored at the end of the table."""
    e = fixtures.load_tables(spark, sf_dir, ["events"])["events"].select("event_id", "event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("at"))
    end = e.agg(F.max("at").alias("end"))
    gaps = next_after(e, e, ["user_id"], "at", "at", names=["next_at"]).crossJoin(F.broadcast(end))  # one row
    event = F.col("next_at").isNotNull().cast("int")
    return gaps.select("event_id", "event_type", event.alias("event"), (F.coalesce("next_at", "end") - F.col("at")).alias("gap"))


def km_event_gaps(spark, sf_dir):
    """SRV-1 on times of microseconds: as many distinct times as events, in ranges."""
    return _round(km_table(event_gaps(spark, sf_dir), "event_type", "gap", "event", continuous=True))


def survival_excluded(spark, sf_dir):
    """SRV-1 / SRV-3: the subjects that take no part, by group and reason."""
    return excluded_subjects(_a(spark, sf_dir).scored, "cci_label")


# ---- readmission ------------------------------------------------------------------------
def next_admission_q(spark, sf_dir):
    """DOM-8 / JN-3 / JN-4 / JN-6 / JN-7 / SRT-3."""
    return _a(spark, sf_dir).readmission.select("person_id", "episode_id", "discharge_date", "next_admission_date")


def censoring(spark, sf_dir):
    """DOM-9 / SCL-5 / SCL-6 / SCL-7."""
    return _a(spark, sf_dir).readmission.select(
        "person_id", "event", "death_date", "censor_date", "followup_end", "time_to_next"
    )


def negative_times_q(spark, sf_dir):
    """DQ-7."""
    return negative_times(_a(spark, sf_dir).readmission)


def comorbidity_group(spark, sf_dir):
    """DOM-10 / SCL-10 / SCL-11."""
    return _a(spark, sf_dir).scored.select(
        "person_id", "episode_id", "cci_score", "ccicat", "cci_group", "cci_label", "cci_rank"
    )


def charlson_score(spark, sf_dir):
    """DOM-10 with the full Charlson map and its three hierarchy pairs, over all episodes."""
    index = fixtures.fx_episode(spark, sf_dir).select("episode_id")
    codes = fixtures.fx_icd_diagnosis(spark, sf_dir)
    scored = comorbidity_score(index, codes, charlson_map(spark), prefix_lengths=charlson_prefix_lengths())
    return scored.select("episode_id", "cci_score")


def outcome_table_q(spark, sf_dir):
    """DOM-11 / AGG-5 / AGG-6 / AGG-12."""
    a = _a(spark, sf_dir)
    return _round(outcome_table(a.scored, "cci_group", a.study.end))


def km_curve(spark, sf_dir):
    """SRV-1."""
    return _round(km_table(_a(spark, sf_dir).scored, "cci_label"))


def km_at_times_q(spark, sf_dir):
    """SRV-2 / SCL-13: the curve at 0, 200, ..., 1000 days."""
    km = km_table(_a(spark, sf_dir).scored, "cci_label")
    return _round(km_at_times(km, "cci_label", report_times(0, 1000, 200)))


def km_median_q(spark, sf_dir):
    """SRV-1: median time to readmission per group."""
    return km_median(km_table(_a(spark, sf_dir).scored, "cci_label"), "cci_label")


def logrank(spark, sf_dir):
    """SRV-3: observed, expected and the variance matrix per group (chi2 from these)."""
    return _round(logrank_parts(_a(spark, sf_dir).scored, "cci_label", GROUP_LABELS))


def logrank_test_q(spark, sf_dir):
    """SRV-3: chi-square, degrees of freedom and p-value. The k x k variance matrix (k = 3
    groups) is the only thing that reaches the driver, for the solve."""
    t = logrank_test(logrank_parts(_a(spark, sf_dir).scored, "cci_label", GROUP_LABELS))
    schema = "chi2 double, df int, p double"
    return _round(spark.createDataFrame([(float(t["chi2"]), int(t["df"]), float(t["p"]))], schema))


#: Persons of the exclusion list of one query.
EXCLUDED = tuple(range(20, 2000, 60))

QUERIES: dict[str, Query] = {
    "ingest_csv_dirty": ingest_csv_dirty,
    "ingest_rejects": ingest_rejects,
    "ingest_report_dirty": ingest_report_dirty,
    "stay_violations": stay_violations,
    "price_quantiles": price_quantiles,
    "price_box": price_box,
    "persons_by_span": persons_by_span,
    "next_admission_each_stay": next_admission_each_stay,
    "event_gaps": event_gaps,
    "km_event_gaps": km_event_gaps,
    "survival_excluded": survival_excluded,
    "profile_dirty": profile_dirty,
    "duplicate_report_dirty": duplicate_report_dirty,
    "flag_table_dirty": flag_table_dirty,
    "mode_crosstab_dirty": mode_crosstab_dirty,
    "date_layouts": date_layouts,
    "episode_sequences_hot": episode_sequences_hot,
    "transfer_stays_hot": transfer_stays_hot,
    "los_box_by_mode": los_box_by_mode,
    "summary_median": summary_median,
    "resolved_deaths_excluded": resolved_deaths_excluded,
    "charlson_score": charlson_score,
    "ingest_clean": ingest_clean,
    "ingest_report": ingest_report,
    "duplicate_report": duplicate_report,
    "profile": profile,
    "flag_table": flag_table,
    "episode_sequences": episode_sequences,
    "file_sequence": file_sequence_q,
    "cohort": cohort,
    "cohort_size": cohort_size_q,
    "first_by_year": first_by_year_q,
    "multi_death": multi_death,
    "death_vs_episodes": death_vs_episodes_q,
    "resolved_deaths": resolved_deaths,
    "dropped_persons": dropped_persons,
    "linked": linked,
    "linked_size": linked_size,
    "transfer_stays": transfer_stays_q,
    "stay_episode_freq": stay_episode_freq,
    "stay_size_freq": stay_size_freq,
    "longest_chain": longest_chain,
    "flagged_stays": flagged_stays,
    "stays_per_person": stays_per_person,
    "mode_crosstab": mode_crosstab,
    "mode_summary": mode_summary,
    "los_stats": los_stats,
    "los_stats_trimmed": los_stats_trimmed,
    "los_histogram": los_histogram,
    "los_box": los_box,
    "longest_stays": longest_stays,
    "next_admission": next_admission_q,
    "censoring": censoring,
    "negative_times": negative_times_q,
    "comorbidity_group": comorbidity_group,
    "outcome_table": outcome_table_q,
    "km_curve": km_curve,
    "km_at_times": km_at_times_q,
    "km_median": km_median_q,
    "logrank": logrank,
    "logrank_test": logrank_test_q,
}

"""The analysis's answers, from any :class:`~staylink.plans.pipeline.Analysis`.

    python -m staylink.plans.answers --episodes EP.csv --deaths D.csv --out DIR \\
        --cols person=NOF_PPN,start=episode_start_date,end=episode_end_date,age=age_recode,\\
code=diagnosis_codeP,mode=mode_of_separation_recode \\
        --dcols person=NOF_ppn,date=death_date,age=age_recode \\
        --period 2005-07-01:2014-06-30 --pattern '^S72\\.[012]' --transfer-modes 5

Each answer is a small DataFrame (a report table); the CLI writes each one as CSV
under ``DIR/<name>``.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.config import DeathCols, EpisodeCols, Study
from staylink.operators import report
from staylink.operators.cohort import cohort_size, first_by_year
from staylink.operators.comorbidity import GROUP_LABELS
from staylink.operators.deaths import dropped_persons, multi_records
from staylink.operators.readmission import negative_times, outcome_table
from staylink.operators.asof import next_admissions
from staylink.operators.quality import ingest_report, violations
from staylink.operators.survival import excluded_subjects, km_at_times, km_median, km_table, logrank_parts, logrank_test, report_times
from staylink.plans.pipeline import Analysis

Answer = Callable[[Analysis], DataFrame]


def _first(a: Analysis) -> DataFrame:
    return a.stays.filter(F.col("hip_seq") == 1)


def _logrank(a: Analysis) -> DataFrame:
    t = logrank_test(logrank_parts(a.scored, "cci_label", GROUP_LABELS))
    return a.spark.createDataFrame([(t["chi2"], t["df"], t["p"])], "chi2 double, df int, p double")


REJECTS = "table string, file string, line string, n_fields int, reason string"

ANSWERS: dict[str, Answer] = {
    # what the extracts hold and what the clean step drops
    "ingest_report": lambda a: ingest_report(a._episodes, a.cols, a.study, None if a.rejects is None else a.rejects.filter("table <> 'deaths'")),
    # Q1: cohort and first hip admissions by year
    "q1_cohort_size": lambda a: cohort_size(a.cohort, a.cols),
    "q1_first_by_year": lambda a: first_by_year(a.cohort, a.cols),
    # Q2: death records and the linked table
    "q2_multiple_death_records": lambda a: multi_records(a.deaths, a.dcols),
    "q2_dropped_persons": lambda a: dropped_persons(a.resolution, a.dcols),
    "q2_linked_size": lambda a: cohort_size(a.linked, a.cols),
    # Q3: position of the first hip episode in its stay, and the longest chain
    "q3_trans_seq_of_first_hip": lambda a: report.frequency(_first(a), "trans_seq"),
    "q3_longest_chain": lambda a: _first(a).join(
        F.broadcast(_first(a).agg(F.max("trans_seq").alias("trans_seq"))), "trans_seq"
    ).select(a.cols.person, "trans_seq", "stay_size"),
    # Q4: hip admissions per person without and with transfers, by mode of separation
    "q4_per_person": lambda a: report.level_summary(
        a.hip_stays.filter(F.col("hip_flag") == 1).groupBy(a.cols.person).agg(F.max("hip_seq").alias("hip_seq")),
        "hip_seq",
        "hip admissions ignoring transfers",
    ).unionByName(
        report.level_summary(
            a.hip_stays.filter(F.col("hip_flag") == 1)
            .groupBy(a.cols.person)
            .agg(F.max("hf_stays_all").alias("hf_stays_all")),
            "hf_stays_all",
            "hip admissions accounting for transfers",
        )
    ),
    "q4_by_mode": lambda a: report.summary_by(a.hip_stays, a.cols.mode, "hf_stays_all", "hip stays"),
    # Q5: length of stay of the first hip stay
    "q5_los_stats": lambda a: report.describe(_first(a), "totlos"),
    "q5_los_stats_without_top5": lambda a: report.describe(
        report.exclude_top_k(_first(a), "totlos", 5, key=[a.cols.person]), "totlos"
    ),
    "q5_los_histogram": lambda a: report.histogram(_first(a), "totlos"),
    "q5_los_box": lambda a: report.box_stats(_first(a), "totlos"),
    "q5_longest_stays": lambda a: report.top_k(_first(a), "totlos", 5, tiebreak=[a.cols.person]).select(
        a.cols.person, "hip_seq", "totlos"
    ),
    # Q6: time to readmission by comorbidity group
    "q6_negative_times": lambda a: negative_times(a.scored),
    "q6_outcomes": lambda a: outcome_table(a.scored, "cci_group", a.study.end),
    "q6_km_at_times": lambda a: km_at_times(km_table(a.scored, "cci_label"), "cci_label", report_times()),
    "q6_km_median": lambda a: km_median(km_table(a.scored, "cci_label"), "cci_label"),
    "q6_logrank": _logrank,
    "q6_excluded_subjects": lambda a: excluded_subjects(a.scored, "cci_label"),
    "q6_next_admissions": lambda a: next_admissions(a.stays, a.cols.person, a.cols.start, ranges=a.ranges, store=a.store),
    # checks
    "rejected_lines": lambda a: a.rejects if a.rejects is not None else a.spark.createDataFrame([], REJECTS),
    "violations": lambda a: violations(a.stays, a.cols),
}


def answers(a: Analysis) -> dict[str, DataFrame]:
    return {name: fn(a) for name, fn in ANSWERS.items()}


def _pairs(text: str | None) -> dict[str, str]:
    return dict(kv.split("=", 1) for kv in text.split(",")) if text else {}


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    p.add_argument("--episodes", required=True)
    p.add_argument("--deaths", required=True)
    p.add_argument("--diagnoses", help="parquet long table (episode id, code); the Charlson map is used")
    p.add_argument("--out", required=True)
    p.add_argument("--cols", help="EpisodeCols fields, e.g. person=NOF_PPN,start=episode_start_date")
    p.add_argument("--dcols", help="DeathCols fields, e.g. person=NOF_ppn,age=age_recode")
    p.add_argument("--episode-columns", help="the episode file's columns in order, comma-separated")
    p.add_argument("--death-columns", help="the death file's columns in order, comma-separated")
    p.add_argument("--run", help="name of the run: a later call of the same name continues from its stages")
    p.add_argument("--period", default="1996-01-01:2000-12-31")
    p.add_argument("--age", type=int, default=65)
    p.add_argument("--pattern", default=r"^[12]-")
    p.add_argument("--transfer-modes", default="P")
    args = p.parse_args(argv)
    # The master and resources come from spark-submit (or PySpark's local default).
    spark = SparkSession.builder.appName("staylink-answers").getOrCreate()
    lo, hi = (dt.date.fromisoformat(x) for x in args.period.split(":"))
    study = Study(start=lo, end=hi, age_threshold=args.age, hip_pattern=args.pattern,
                  transfer_modes=tuple(args.transfer_modes.split(",")))
    cols, dcols = EpisodeCols(**_pairs(args.cols)), DeathCols(**_pairs(args.dcols))
    dx = spark.read.parquet(args.diagnoses) if args.diagnoses else None
    ecols = args.episode_columns.split(",") if args.episode_columns else None
    died = args.death_columns.split(",") if args.death_columns else None
    a = Analysis.from_csv(
        spark, args.episodes, args.deaths, study, cols, dcols, episode_columns=ecols, death_columns=died, diagnoses=dx, run=args.run
    )
    for name, df in answers(a).items():
        df.write.mode("overwrite").option("header", True).csv(f"{args.out.rstrip('/')}/{name}")
        print(name)
    a.close()


if __name__ == "__main__":
    main()

"""Bench: the whole analysis at one scale factor, stage by stage.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Part one builds (and writes once, to the checkpoint folder) the sequenced
episodes, the linked episodes and the stays table; part two's reports run on the
written stays table, as a user of the library would run them. Row-level results
go to Spark's ``noop`` sink (computed in full, not collected); report tables are
collected. ``value`` is the sum over the analysis stages; the extra
``sequences_hot_person`` entry (one person holding a third of the episodes) is
reported but not summed. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from staylink.config import local_session  # noqa: E402
from staylink.operators import report  # noqa: E402
from staylink.operators.cohort import first_by_year  # noqa: E402
from staylink.operators.episodes import sequence_episodes  # noqa: E402
from staylink.operators.comorbidity import GROUP_LABELS  # noqa: E402
from staylink.operators.readmission import outcome_table  # noqa: E402
from staylink.operators.survival import km_at_times, km_table, logrank_parts, logrank_test, report_times  # noqa: E402
from staylink.plans.pipeline import Analysis  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    a = Analysis(spark, sf_dir)
    timings: dict[str, float] = {}

    # JVM start-up and first-job compilation, reported apart from the analysis
    t0 = time.perf_counter()
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.read.parquet(f"{sf_dir}/orders.parquet").limit(10).collect()
    warmup = round(time.perf_counter() - t0, 3)

    def run(name, fn):
        t0 = time.perf_counter()
        out = fn()
        if hasattr(out, "collect"):
            out.collect()
        timings[name] = round(time.perf_counter() - t0, 3)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    # part one: each stage is written once; the timing includes that write
    run("ingest", lambda: a.episodes)
    run("sequences", lambda: a.sequenced)
    run("first_by_year", lambda: first_by_year(a.cohort))
    run("death_resolution", lambda: a.resolution)
    run("linked", lambda: a.linked)
    run("transfer_stays", lambda: a.stays)
    # part two, on the written stays table
    run("hip_stays", lambda: noop(a.hip_stays))
    run("stay_episode_freq", lambda: report.frequency(a.stays.filter(F.col("hip_seq") == 1), "trans_seq"))
    run("mode_summary", lambda: report.summary_by(a.hip_stays, "mode", "hf_stays_all", "hip stays"))
    first = a.stays.filter(F.col("hip_seq") == 1)
    run("los_stats", lambda: report.describe(first, "totlos"))
    run("los_stats_trimmed", lambda: report.describe(report.exclude_top_k(first, "totlos", 5, key=["person_id"]), "totlos"))
    run("los_box", lambda: report.box_stats(first, "totlos"))
    run("readmission", lambda: noop(a.readmission))
    run("comorbidity_outcomes", lambda: outcome_table(a.scored, "cci_group", a.study.end))
    run("km_curve", lambda: km_at_times(km_table(a.scored, "cci_label"), "cci_label", report_times()))
    run("logrank", lambda: logrank_test(logrank_parts(a.scored, "cci_label", GROUP_LABELS)))
    # Skew check, not part of the analysis: the same episodes with a third of them moved
    # to one person, sequenced by the same ranges. Shows what a hot key costs.
    hot = a.episodes.withColumn(
        "person_id", F.when(F.col("episode_id") % 3 == 0, F.lit(0)).otherwise(F.col("person_id"))
    )
    run("sequences_hot_person", lambda: noop(sequence_episodes(hot)))
    n_rows = a.episodes.count()

    total = round(sum(v for k, v in timings.items() if k != "sequences_hot_person"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "analysis_total_time", "value": total, "unit": "sec", "queries": timings,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus, "warmup_sec": warmup,
                      "episodes": n_rows, "episodes_per_sec": round(n_rows / total, 1)}))
    spark.stop()


if __name__ == "__main__":
    main()

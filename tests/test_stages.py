"""SRC-4: stages are committed one by one, resumed by the next driver, and deleted when done."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from staylink.config import Study
from staylink.operators.scan import BLOCK, range_count, ranged
from staylink.plans.pipeline import Analysis
from staylink.sources import stages
from staylink.sources.stages import StageLost, StageStore, scratch_store

from .conftest import SF001


@pytest.fixture
def folder(tmp_path, monkeypatch):
    """The shared folder of the test's own runs."""
    monkeypatch.setattr(stages, "scratch_dir", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(stages, "_SCRATCH", {})
    return tmp_path


def tables(spark):
    return {t.name for t in spark.catalog.listTables()}


def test_a_stage_is_made_once(spark, folder):
    store, made = StageStore(spark, "once", "v1"), []

    def make(k):
        made.append(k)
        return spark.range(k)

    assert store.stage("a", lambda: make(5)).count() == 5
    assert store.stage("a", lambda: make(6)).count() == 5 and made == [5]
    assert list(store.committed()) == ["a"]
    store.close()
    assert os.listdir(folder / "runs") == []


def test_the_next_driver_reads_what_was_committed_and_deletes_the_rest(spark, folder):
    first = StageStore(spark, "resumed", "v1")
    first.write(spark.range(7), "a")
    first.write(spark.range(9).withColumn(BLOCK, F.lit(3)), "b", buckets=2, by=BLOCK)
    # what a killed writer leaves: a folder that no manifest names
    spark.range(4).write.parquet(f"file://{folder}/runs/resumed/c-unfinished")
    second = StageStore(spark, "resumed", "v1")
    assert second.find("a").count() == 7 and second.find("b").count() == 9 and second.find("c") is None
    names = [n for n in os.listdir(folder / "runs" / "resumed") if not n.startswith(("_", "."))]
    assert sorted(n.split("-")[0] for n in names) == ["a", "b"]
    with pytest.raises(StageLost):  # the first driver has lost the run
        first.write(spark.range(1), "c")
    assert second.find("a").count() == 7
    second.close()
    assert os.listdir(folder / "runs") == []


def test_another_input_makes_the_stages_anew(spark, folder):
    StageStore(spark, "changed", "v1").write(spark.range(7), "a")
    store = StageStore(spark, "changed", "v2")
    assert store.find("a") is None
    assert store.stage("a", lambda: spark.range(2)).count() == 2
    store.close()


def test_a_stage_written_again_leaves_no_folder_behind(spark, folder):
    store = StageStore(spark, "again")
    for k in (1, 2, 3):
        assert store.write(spark.range(k), "a").count() == k
    assert len([n for n in os.listdir(folder / "runs" / "again") if n.startswith("a-")]) == 1
    store.close()


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from staylink.plans.pipeline import Analysis
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate())
a = Analysis(spark, sys.argv[2], run="study")
a.linked.count()
os._exit(9)  # between linked and stays: no stop, no close
"""


def test_a_killed_analysis_resumes(spark, folder):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", KILLED, f"file://{folder}", SF001], env=env, capture_output=True, timeout=300)
    assert done.returncode == 9, done.stderr.decode()[-2000:]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        a, whole = Analysis(spark, SF001, run="study"), Analysis(spark, SF001)
        cols = ["episode_id", "stay_seq", "trans_seq", "sepdate_last", "hip_seq", "death_date"]
        assert sorted(a.stays.select(*cols).collect()) == sorted(whole.stays.select(*cols).collect())
        assert sorted(a.store.resumed) == ["linked"]  # nothing before it was read or made
        assert set(a.store.committed()) == {"episodes", "sequenced", "linked", "stays"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    paths = a.stage_paths
    a.close()
    whole.close()
    assert len(paths) == 4 and os.listdir(folder / "runs") == []


def test_an_unnamed_run_goes_with_its_driver(folder):
    script = KILLED.replace(', run="study")', ")").replace("os._exit(9)", "assert os.listdir(sys.argv[1].removeprefix('file://') + '/runs'); spark.stop()")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script, f"file://{folder}", SF001], env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
    assert os.listdir(folder / "runs") == []


def test_an_analysis_leaves_nothing_behind(spark, folder):
    known = tables(spark)
    a = Analysis(spark, SF001)
    a.hip_stays.count()
    a.scored.count()
    a.close()
    assert os.listdir(folder / "runs") == [] and tables(spark) == known


def test_each_range_is_a_bucket_and_no_scan_shuffles_rows(spark, folder):
    """The rows move once, into their ranges: everything after reads them where they lie."""
    a = Analysis(spark, SF001, Study(ranges=6))
    assert a.ranges == 6 and range_count(a.episodes, 6) == 6
    rows = a._episodes_in_order.groupBy(BLOCK).count().collect()
    assert len(rows) == 6 and len({r for (r,) in a._episodes_in_order.selectExpr(f"pmod(hash({BLOCK}), 6)").distinct().collect()}) == 6

    def shuffles(df):
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]

    stays = a._stays
    n = stays.count()
    assert n > 0
    for df in (a.hip_stays, a._sequenced.filter("hip_seq = 1")):
        for line in shuffles(df):
            # the ranges' carries: by range or by the key of a range's end, never by person
            assert "hashpartitioning(person_id" not in line and "rangepartitioning" not in line, line
    a.close()


def test_ranged_keeps_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(1).alias("v"))
    out = ranged(df, ["k"], ["v"], 7).groupBy(BLOCK).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy(BLOCK).collect()
    assert all(x.hi < y.lo for x, y in zip(out, out[1:], strict=False)) and (out[0].lo, out[-1].hi) == (0, 999)


def test_operators_called_alone_write_to_the_session_s_own_store(spark, folder):
    from staylink.operators.episodes import file_sequence

    a = Analysis(spark, SF001)
    file_sequence(a.episodes).count()
    store = scratch_store(spark)
    assert not store.named and store.committed()
    store.close()
    a.close()

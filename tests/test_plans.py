"""Plan checks: no Python UDF anywhere, scans and joins where the design puts them."""

import pytest

from staylink.plans import queries as Q
from staylink.plans.pipeline import Analysis

from .conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["episode_sequences", "transfer_stays", "flagged_stays", "km_curve", "km_event_gaps", "logrank", "price_box", "next_admission_each_stay", "comorbidity_group", "cohort", "ingest_rejects"])
def test_no_python_udf(spark, name):
    plan = _plan(Q.QUERIES[name](spark, SF001))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "PythonMapInArrow", "FlatMapGroupsInArrow", "PythonUDF"):
        assert node not in plan


def test_sequences_read_written_ranges(spark):
    """The scan reads the written ranges where they lie: no exchange of rows, and one row a range
    comes back by a broadcast."""
    from staylink.config import Study
    from staylink.operators.episodes import sequence_episodes

    a = Analysis(spark, SF001, materialize_stages=False)
    plan = _plan(sequence_episodes(a.episodes, study=Study(ranges=4), with_file_seq=False))
    assert "SelectedBucketsCount: 4 out of 4" in plan and "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan and "rangepartitioning" not in plan


def test_filters_reach_the_scan(spark):
    plan = _plan(Analysis(spark, SF001, materialize_stages=False).episodes)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan

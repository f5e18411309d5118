import math

import pytest

from staylink.operators import report


@pytest.fixture
def los(spark):
    return spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, 10), (5, None)], "person_id long, los int")


def test_describe_type7_quantiles(los):
    r = report.describe(los, "los").first()
    assert (r.n, r.n_missing) == (4, 1)
    assert (r.q1, r.median, r.q3) == (1.75, 3.0, 5.5)
    assert math.isclose(r.sd, 4.0311289, rel_tol=1e-7) and r.mean == 4.25


def test_frequency_with_null_level(los):
    f = {r.los: (r.n, r.percent, r.valid_percent) for r in report.frequency(los, "los", valid_percent=True).collect()}
    assert f[None] == (1, 0.2, None) and f[1] == (1, 0.2, 0.25)


def test_top_k_ties_and_exclude(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 7), (5, 1)], "person_id long, los int")
    top = [tuple(r) for r in report.top_k(df, "los", 2, tiebreak=["person_id"]).collect()]
    assert top == [(2, 9), (3, 9)]
    rest = sorted(r.person_id for r in report.exclude_top_k(df, "los", 3, key=["person_id"]).collect())
    assert rest == [1, 5]


def test_histogram_and_box(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 2, 3, 3, 3, 4, 40])], "person_id long, los int")
    h = {r.bin: r.n for r in report.histogram(df, "los").collect()}
    assert h == {1.0: 2, 2.0: 1, 3.0: 2 + 1, 4.0: 1, 40.0: 1}
    b = report.box_stats(df, "los").first()
    assert (b.q1, b.median, b.q3) == (1.75, 3.0, 3.25)
    assert (b.whisker_low, b.whisker_high, b.n_outliers) == (1.0, 4.0, 1)


def test_crosstab_and_summaries(spark):
    df = spark.createDataFrame([(1, "F"), (1, "P"), (2, "P"), (2, None), (1, "X")], "hip_seq int, mode string")
    ct = {r.hip_seq: (r.F, r.O, r.P, r.other, r.NA) for r in report.crosstab(df, "hip_seq", "mode", ["F", "O", "P"]).collect()}
    assert ct == {1: (1, 0, 1, 1, 0), 2: (0, 0, 1, 0, 1)}
    s = {(r.mode, r.level): r.percent for r in report.summary_by(df, "mode", "hip_seq", "x").collect()}
    assert s[("P", 1)] == 50.0 and ("NA", 2) not in s
    lv = {r.level: r.percent for r in report.level_summary(df, "hip_seq", "x").collect()}
    assert lv == {1: 60.0, 2: 40.0}


def test_median_summary(spark):
    many = spark.createDataFrame([(i,) for i in range(1, 21)], "x int")
    r = report.median_summary(many, "x", "v").first()
    assert (r.variable, r.n, r.median, r.q1, r.q3) == ("v", 20, 10.5, 5.75, 15.25)

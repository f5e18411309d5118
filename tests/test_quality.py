import pytest
from pyspark.sql import types as T

from staylink.operators.quality import check_type, duplicate_groups, duplicate_report, profile


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id long, s string")
    p = [tuple(r) for r in profile(df).collect()]
    assert p == [(1, "id", "bigint", 3, 0), (2, "s", "string", 3, 1)]
    r = duplicate_report(df, "t").first()
    assert (r.n_rows, r.n_distinct, r.n_excess, r.has_duplicates) == (3, 2, 1, True)
    assert [tuple(x) for x in duplicate_groups(df).collect()] == [(1, "a", 2)]


def test_check_type(spark):
    df = spark.createDataFrame([(1,)], "id long")
    check_type(df, "id", T.LongType())
    with pytest.raises(TypeError):
        check_type(df, "id", T.DateType())


def test_ingest_report(spark):
    import datetime as dt

    from staylink.operators.quality import ingest_report

    d = dt.date
    rows = [(1, 1, d(1997, 1, 1), d(1997, 1, 2)), (1, 1, d(1997, 1, 1), d(1997, 1, 2)),
            (None, 2, d(1997, 1, 1), d(1997, 1, 2)), (3, 3, None, d(1997, 1, 2)), (4, 4, d(1995, 1, 1), d(1995, 1, 2))]
    df = spark.createDataFrame(rows, "person_id long, episode_id long, start_date date, end_date date")
    r = ingest_report(df).first()
    assert tuple(r) == (5, 1, 1, 1, 0, 1, 1)

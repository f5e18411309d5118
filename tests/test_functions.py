import datetime as dt

from pyspark.sql import functions as F

from staylink.functions import dates, flags


def test_parse_dmy_layouts_and_bad_dates(spark):
    good = ["01/07/2005", "1/7/2005", "01JUL2005", "01 Jul 2005", "01-07-2005", "01-Jul-2005", "01/Jul/2005", "1 July 2005",
            "01/07/05", "1.7.05", "01072005", "010705", "1july05", " 1  JULY, 2005 "]
    bad = ["31/02/2006", "NA", "", None, "01/13/2005", "1 Juli 2005", "1 Foo 2005", "2005-07-01", "0107200", "1/7/205"]
    rows = [(x,) for x in good + bad]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(dates.parse_dmy("s")).collect()]
    d = dt.date(2005, 7, 1)
    assert got == [d] * len(good) + [None] * len(bad)
    old = spark.createDataFrame([("1/7/69",), ("1/7/68",)], "s string").select(dates.parse_dmy("s")).collect()
    assert [r[0].year for r in old] == [1969, 2068]


def test_parse_ymd(spark):
    df = spark.createDataFrame([("2014-06-30",), ("junk",), (None,)], "s string")
    assert [r[0] for r in df.select(dates.parse_ymd("s")).collect()] == [dt.date(2014, 6, 30), None, None]


def test_days_and_least(spark):
    df = spark.createDataFrame([(dt.date(2001, 1, 1), dt.date(2001, 1, 11), None)], "a date, b date, c date")
    r = df.select(dates.days_between("b", "a"), dates.least_date("b", "c"), dates.least_date("a", "b")).first()
    assert r[0] == 10 and r[1] == dt.date(2001, 1, 11) and r[2] == dt.date(2001, 1, 1)


def test_flags_null_rules(spark):
    df = spark.createDataFrame([(70, "S72.0"), (64, "S72.3"), (None, None), (65, "S72.21")], "age int, code string")
    out = df.select(
        flags.threshold_flag("age", 65).alias("a"), flags.pattern_flag("code", r"^S72\.[012]").alias("h")
    ).collect()
    assert [(r.a, r.h) for r in out] == [(1, 1), (0, 0), (None, 0), (1, 1)]


def test_recode_and_ordered_label(spark):
    df = spark.createDataFrame([("[0,1)",), ("[1,3)",), ("x",), (None,)], "c string")
    m = {"[0,1)": "0", "[1,3)": "1-2", "[3,Inf)": "3+"}
    lab, rank = flags.ordered_label(flags.recode("c", m), ["0", "1-2"], ["CCI 0", "CCI 1–2"])
    out = df.select(flags.recode("c", m).alias("g"), lab.alias("l"), rank.alias("r")).collect()
    assert [tuple(r) for r in out] == [("0", "CCI 0", 1), ("1-2", "CCI 1–2", 2), ("x", None, None), (None, None, None)]


def test_if_else_null_condition(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    assert [r[0] for r in df.select(flags.if_else(F.col("c"), 1, 0)).collect()] == [1, 0, None]

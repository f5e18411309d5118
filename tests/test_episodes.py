import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylink.config import Study
from staylink.operators.cohort import select_cohort
from staylink.operators.episodes import add_flags, clean_episodes, file_sequence, sequence_episodes, type_episodes
from staylink.sources.csv import read_text_csv, write_text_csv

COLS = ["person_id", "episode_id", "start_date", "end_date", "age", "diag_code", "mode"]
STUDY = Study(start=dt.date(2005, 7, 1), end=dt.date(2014, 6, 30), hip_pattern=r"^S72\.[012]")


def test_tiny_raw_through_csv(spark):
    """SRC-1 + DOM-1: layouts, impossible date, duplicate row, NA, blank, nulls, period edges."""
    rows = [
        ("1", "1", "01/07/2005", "03/07/2005", "70", "S72.0", "5"),
        ("1", "1", "01/07/2005", "03/07/2005", "70", "S72.0", "5"),  # exact copy
        ("1", "2", "1/8/2005", "01AUG2005", "NA", "S72.1", "9"),  # NA age
        ("2", "3", "01 Jul 2005", "02 Jul 2005", "", None, "5"),  # blank age, null code
        ("2", "4", "31/02/2006", "01/03/2006", "66", "I21", "5"),  # impossible start -> null -> dropped
        ("3", "5", "30/06/2005", "02/07/2005", "80", "S72.0", "5"),  # starts before the period
        ("3", "6", "29/06/2014", "01/07/2014", "80", "S72.0", "5"),  # ends after the period
        ("3", "7", "29/06/2014", "30/06/2014", "80", "S72.2", "5"),  # ends on the last day
    ]
    path = tempfile.mkdtemp(prefix="staylink-csv-") + "/ep"
    write_text_csv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLS)), path)
    raw = read_text_csv(spark, path, COLS)
    out = clean_episodes(type_episodes(raw, id_type="bigint"), study=STUDY)
    got = {r.episode_id: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 7]
    assert got[1].start_date == dt.date(2005, 7, 1) and got[1].end_date == dt.date(2005, 7, 3)
    assert got[2].age is None and got[2].end_date == dt.date(2005, 8, 1)
    assert got[3].age is None and got[3].diag_code is None
    flagged = {r.episode_id: (r.age_flag, r.hip_flag) for r in add_flags(out, study=STUDY).collect()}
    assert flagged == {1: (1, 1), 2: (None, 1), 3: (None, 0), 7: (1, 1)}


def _tiny_seq(spark):
    d = dt.date
    rows = [
        # person 1: equal start and end, hip 0 then 1 (a RANGE frame would merge them)
        (1, 10, d(2006, 1, 1), d(2006, 1, 5), 0),
        (1, 11, d(2006, 1, 1), d(2006, 1, 5), 1),
        (1, 12, d(2007, 1, 1), d(2007, 1, 2), 0),
        (1, 13, d(2008, 1, 1), d(2008, 1, 2), 1),
        # person 2: no hip episode
        (2, 20, d(2006, 1, 1), d(2006, 1, 2), 0),
        (2, 21, d(2006, 2, 1), d(2006, 2, 2), 0),
        # person 3: hip first
        (3, 30, d(2006, 1, 1), d(2006, 1, 2), 1),
        (3, 31, d(2009, 2, 1), d(2009, 2, 2), 0),
        # person 4: hip last
        (4, 40, d(2006, 1, 1), d(2006, 1, 2), 0),
        (4, 41, d(2012, 2, 1), d(2012, 2, 2), 1),
    ]
    return spark.createDataFrame(rows, "person_id long, episode_id long, start_date date, end_date date, hip_flag int")


@pytest.mark.parametrize("ranges", [1, 3, 8, None])
def test_tiny_seq(spark, ranges):
    s = sequence_episodes(_tiny_seq(spark), study=Study(ranges=ranges))
    got = {r.episode_id: (r.file_seq, r.person_seq, r.hip_cumcount, r.post_index, r.index_seq, r.hip_seq)
           for r in s.collect()}
    assert got == {
        10: (1, 1, 0, 0, 0, 0), 11: (2, 2, 1, 1, 1, 1), 12: (3, 3, 1, 1, 2, 0), 13: (4, 4, 2, 1, 3, 2),
        20: (5, 1, 0, 0, 0, 0), 21: (6, 2, 0, 0, 0, 0),
        30: (7, 1, 1, 1, 1, 1), 31: (8, 2, 1, 1, 2, 0),
        40: (9, 1, 0, 0, 0, 0), 41: (10, 2, 1, 1, 1, 1),
    }


def _random_episodes(spark, seed, n_persons=40, max_eps=30):
    rnd = random.Random(seed)
    rows, eid = [], 0
    for p in range(n_persons):
        n = rnd.choice([1, 2, 5, max_eps]) if p else 300  # person 0 is a hot key
        for _ in range(n):
            s = dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 2000))
            rows.append((p * 7 + 3, eid, s, s + dt.timedelta(days=rnd.choice([0, 0, 1, 3, 40])), int(rnd.random() < 0.3)))
            eid += 1
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "person_id long, episode_id long, start_date date, end_date date, hip_flag int")


def _ids(df, kind):
    """The same episodes under other person ids: the ends of int64, one far outlier, text."""
    k = F.col("person_id")
    if kind == "wide":
        k = F.when(k % 2 == 0, F.lit(-(2**63)) + k).otherwise(F.lit(2**63 - 1) - k)
    elif kind == "outlier":
        k = F.when(k == 3, F.lit(10**15)).otherwise(k)
    elif kind == "text":
        k = F.concat(F.lit("P"), k.cast("string"))
    return df.withColumn("person_id", k)


@pytest.mark.parametrize("seed,ranges,kind", [(1, 16, "plain"), (2, 5, "wide"), (3, 7, "outlier"), (4, 9, "text"), (5, 1, "plain")])
def test_sequences_equal_plain_windows(spark, seed, ranges, kind):
    """However the ranges cut persons, the numbers are the whole-person window numbers
    (section 5.3 invariants), for ids of any size, gap or type."""
    df = _ids(_random_episodes(spark, seed), kind)
    s = sequence_episodes(df, study=Study(ranges=ranges))
    o = ["start_date", "end_date", "episode_id"]
    w = W.partitionBy("person_id").orderBy(*o)
    ref = df.select(
        "episode_id",
        F.row_number().over(W.orderBy("person_id", *o)).alias("r_file"),
        F.row_number().over(w).alias("r_person"),
        F.sum("hip_flag").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("r_cum"),
    )
    j = s.join(ref, "episode_id")
    assert j.filter(
        (F.col("file_seq") != F.col("r_file")) | (F.col("person_seq") != F.col("r_person"))
        | (F.col("hip_cumcount") != F.col("r_cum"))
    ).count() == 0
    n = df.count()
    assert s.agg(F.min("file_seq"), F.max("file_seq"), F.countDistinct("file_seq")).first() == (1, n, n)
    per = s.groupBy("person_id").agg(
        F.max("person_seq").alias("m"), F.count("*").alias("c"), F.max("hip_seq").alias("mh"),
        F.sum("hip_flag").alias("sh"), F.count_if(F.col("hip_seq") == 1).alias("h1"),
        F.count_if((F.col("index_seq") > 0) != (F.col("post_index") == 1)).alias("bad_index"),
    )
    assert per.filter(
        (F.col("m") != F.col("c")) | (F.col("mh") != F.col("sh")) | (F.col("h1") > 1) | (F.col("bad_index") > 0)
    ).count() == 0


def test_file_sequence_alone(spark):
    df = _random_episodes(spark, 5)
    fs = file_sequence(df, study=Study(ranges=6))
    n = df.count()
    assert fs.agg(F.min("file_seq"), F.max("file_seq"), F.countDistinct("file_seq")).first() == (1, n, n)


def test_tiny_cohort(spark):
    """DOM-5 trap: hip at 64 then again at 66 is in; hip at 64 with a non-hip at 66 is out."""
    d = dt.date
    rows = [
        (1, 1, d(2006, 1, 1), d(2006, 1, 2), 64, "S72.0"),
        (1, 2, d(2008, 1, 1), d(2008, 1, 2), 66, "S72.1"),
        (2, 3, d(2006, 1, 1), d(2006, 1, 2), 64, "S72.0"),
        (2, 4, d(2008, 1, 1), d(2008, 1, 2), 66, "I21"),
        (3, 5, d(2006, 1, 1), d(2006, 1, 2), None, "S72.0"),
    ]
    df = spark.createDataFrame(
        rows, "person_id long, episode_id long, start_date date, end_date date, age int, diag_code string"
    )
    seq = sequence_episodes(add_flags(df, study=STUDY), study=STUDY)
    c = select_cohort(seq).collect()
    assert sorted(r.episode_id for r in c) == [1, 2]
    # hip_seq 1 is the episode at 64, kept as in the reference
    assert {r.episode_id: r.hip_seq for r in c} == {1: 1, 2: 2}


@pytest.mark.parametrize("one_day", [False, True])
def test_hot_person_is_spread_over_ranges(spark, one_day):
    """A person with a third of all rows, on many days or on one: no range holds much more
    than its share, and the numbers equal plain windows."""
    from staylink.operators.scan import BLOCK, with_block

    df = _random_episodes(spark, 7, n_persons=60)
    hot = df.withColumn("person_id", F.when(F.col("episode_id") % 3 == 0, F.lit(3)).otherwise(F.col("person_id")))
    if one_day:
        day = F.lit(dt.date(2004, 5, 6))
        hot = hot.withColumns({c: F.when(F.col("person_id") == 3, day).otherwise(F.col(c)) for c in ("start_date", "end_date")})
    n, n_hot = hot.count(), hot.filter(F.col("person_id") == 3).count()
    assert n_hot * 3 >= n
    sizes = with_block(hot, ["person_id"], ["start_date", "end_date", "episode_id"], 10).groupBy("person_id", BLOCK).count()
    assert sizes.agg(F.max("count")).first()[0] <= n / 5
    o = ["start_date", "end_date", "episode_id"]
    w = W.partitionBy("person_id").orderBy(*o)
    want = hot.select("episode_id", F.row_number().over(W.orderBy("person_id", *o)).alias("file_seq"), F.row_number().over(w).alias("person_seq"), F.sum("hip_flag").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("hip_cumcount"))
    got = sequence_episodes(hot, study=Study(ranges=10)).select("episode_id", "file_seq", "person_seq", "hip_cumcount")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

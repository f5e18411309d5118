"""Order statistics, next events, sketches and invariants against plain computations."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylink.operators import report, sketches
from staylink.operators.asof import next_after
from staylink.operators.quality import violations
from staylink.operators.ranks import quantiles, value_counts
from staylink.operators.survival import excluded_subjects, km_table, logrank_parts


@pytest.mark.parametrize("ranges", [1, 7])
def test_quantiles_are_type_7(spark, ranges):
    rng = random.Random(ranges)
    groups = {"many": [rng.gauss(0, 1) for _ in range(400)], "few": [rng.randrange(3) for _ in range(50)], "one": [4.5], None: [1.0, 2.0], "none": []}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in quantiles(value_counts(df, "x", ["g"]), probs, ["g"], ranges=ranges).collect()}
    assert set(got) == {"many", "few", "one", None}
    for g, r in got.items():
        assert r.n == len(groups[g])
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(groups[g], probs))


def test_few_and_many_values_give_the_same_tables(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30), 400])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x int")
    for by in ([], ["g"]):
        for table in (report.describe, report.box_stats):
            few, many = table(df, "x", by=by), table(df, "x", by=by, few_values=False, ranges=5)
            assert few.columns == many.columns
            assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
    empty = df.filter("x is null")
    assert report.describe(empty, "x", few_values=False).first().asDict()["median"] is None
    assert report.box_stats(empty, "x", few_values=False).collect() == []


def test_box_collects_no_group(spark):
    df = spark.range(100).selectExpr("id % 3 g", "id x")
    for few in (True, False):
        assert "collect_list" not in report.box_stats(df, "x", by=["g"], few_values=few)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [True, False])
def test_next_after(spark, strict):
    rng = random.Random(11)
    anchors = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(20)]), i) for i in range(120)]
    events = [(rng.choice([1, 1, 2, 4, None]), rng.choice([None, *range(20)]), i) for i in range(80)]
    a, e = spark.createDataFrame(anchors, "p int, t int, a_id int"), spark.createDataFrame(events, "p int, at int, e_id int")
    out = next_after(a, e, ["p"], "t", "at", carry=["e_id"], names=["next_t", "next_id"], strict=strict, ranges=9)
    assert out.columns == ["p", "t", "a_id", "next_t", "next_id"] and out.count() == len(anchors)
    for r in out.collect():
        after = [(x[1], x[2]) for x in events if None not in (r.p, r.t, x[1]) and x[0] == r.p and (x[1] > r.t or (x[1] == r.t and not strict))]
        assert (r.next_t, r.next_id) == min(after, default=(None, None))


def test_next_after_without_events(spark):
    a = spark.createDataFrame([(1, 5)], "p int, t int")
    assert next_after(a, a.filter("p = 2"), ["p"], "t", "t").collect()[0].next_time is None
    assert next_after(a.filter("p = 2"), a, ["p"], "t", "t").collect() == []
    with pytest.raises(ValueError):
        next_after(a, a, ["p"], "t", "t", carry=["p"])


def test_sketches_keep_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 20_011).alias("p"), F.expr("make_date(cast(2000 + id % 4 as int), 1, 1)").alias("d"), (F.col("id") % 2 == 0).alias("s"))
    spans = [(2000, 2000), (2000, 2003), (2002, 2003), (2010, 2011)]
    made = sketches.person_sketches(df, "p", "d", ["s"])
    assert made.count() == 4
    got = {(r.from_year, r.to_year, r.s): r.n_estimate for r in sketches.persons_in_spans(made, spans, ["s"]).collect()}
    want = {(r.from_year, r.to_year, r.s): r.n_persons for r in sketches.exact_in_spans(df, "p", "d", spans, ["s"]).collect()}
    assert set(got) == set(want) and (2010, 2011, True) not in got
    assert all(abs(got[k] - n) <= n * sketches.relative_error() for k, n in want.items())


def _stays(spark, **change):
    d = dt.date
    rows = [
        dict(person_id=1, episode_id=1, start_date=d(2000, 1, 1), end_date=d(2000, 1, 5), person_seq=1, hip_seq=1, stay_seq=1, trans_seq=0, stay_size=2, admdate_first=d(2000, 1, 1), sepdate_last=d(2000, 1, 9), totlos=8),
        dict(person_id=1, episode_id=2, start_date=d(2000, 1, 4), end_date=d(2000, 1, 9), person_seq=2, hip_seq=0, stay_seq=1, trans_seq=1, stay_size=2, admdate_first=d(2000, 1, 1), sepdate_last=d(2000, 1, 9), totlos=8),
        dict(person_id=1, episode_id=3, start_date=d(2000, 2, 1), end_date=d(2000, 2, 2), person_seq=3, hip_seq=2, stay_seq=2, trans_seq=0, stay_size=1, admdate_first=d(2000, 2, 1), sepdate_last=d(2000, 2, 2), totlos=1),
        dict(person_id=2, episode_id=4, start_date=d(2000, 2, 1), end_date=d(2000, 2, 2), person_seq=1, hip_seq=1, stay_seq=1, trans_seq=0, stay_size=1, admdate_first=d(2000, 2, 1), sepdate_last=d(2000, 2, 2), totlos=1),
    ]
    for key, value in change.items():
        rows[int(key[-1]) - 1][key[:-1].rstrip("_")] = value
    return spark.createDataFrame([tuple(r.values()) for r in rows], "person_id long, episode_id long, start_date date, end_date date, person_seq int, hip_seq int, stay_seq int, trans_seq int, stay_size int, admdate_first date, sepdate_last date, totlos int")


@pytest.mark.parametrize(("change", "rules"), [
    ({}, set()),
    ({"person_seq_3": 4}, {"person_seq_gap"}),
    ({"hip_seq_3": 3}, {"hip_seq_gap"}),
    ({"stay_seq_3": 3}, {"stay_seq_gap"}),
    ({"trans_seq_2": 2}, {"trans_seq_gap"}),
    ({"stay_size_4": 2}, {"stay_totals"}),
    ({"totlos_3": 7}, {"stay_totals"}),
    ({"end_date_4": dt.date(2000, 1, 1), "sepdate_last_4": dt.date(2000, 1, 1), "totlos_4": -31}, {"negative_stay"}),
    ({"start_date_3": dt.date(2000, 1, 8), "admdate_first_3": dt.date(2000, 1, 8), "totlos_3": 25}, {"overlapping_stays"}),
])
def test_planted_violations_are_found(spark, change, rules):
    got = {r.rule: (r.n_checked, r.n_violations) for r in violations(_stays(spark, **change)).collect()}
    assert {r for r, (_, bad) in got.items() if bad} == rules and len(got) == 7
    assert got["person_seq_gap"][0] == 2 and got["trans_seq_gap"][0] == 3


def _subjects(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b"]), rng.random() * 100, rng.randrange(2)) for _ in range(150)]
    rows += [("a", None, 1), ("a", -1.0, 1), ("b", 3.0, None), ("z", 5.0, 1), (None, 5.0, 1), (None, None, None)]
    return spark.createDataFrame(rows, "g string, t double, e int")


def test_continuous_times_give_the_same_curve(spark):
    df = _subjects(spark)
    days, ranged = km_table(df, "g", "t", "e"), km_table(df, "g", "t", "e", continuous=True, ranges=7)
    assert days.columns == ranged.columns
    a, b = ({(r.g, r.t): r for r in x.collect()} for x in (days, ranged))
    assert set(a) == set(b) and {g for g, _ in a} == {"a", "b", "z"}
    for k, r in a.items():
        for c in days.columns[2:]:
            assert (r[c] is None) == (b[k][c] is None) and (r[c] is None or abs(r[c] - b[k][c]) < 1e-12), (k, c)
    assert {r.g: r.n_excluded for r in a.values()} == {"a": 2, "b": 1, "z": 0}


def test_excluded_subjects_are_counted(spark):
    df = _subjects(spark)
    got = {r.g: tuple(r)[2:] for r in excluded_subjects(df, "g", "t", "e").collect()}
    assert got == {"a": (1, 1, 0, 2), "b": (0, 0, 1, 1), "z": (0, 0, 0, 0), None: (1, 0, 0, 2)}
    parts = {r.g: r for r in logrank_parts(df, "g", ["a", "b"], "t", "e", ranges=5).collect()}
    assert (parts["a"].n_excluded, parts["b"].n_excluded) == (2, 1) and {r.n_unlisted for r in parts.values()} == {3}
    plain = {r.g: r for r in logrank_parts(df.filter("g in ('a', 'b') and t >= 0 and e is not null"), "g", ["a", "b"], "t", "e").collect()}
    assert all(abs(parts[g].expected - plain[g].expected) < 1e-9 and parts[g].observed == plain[g].observed for g in "ab")
    assert {r.n_unlisted for r in plain.values()} == {0}


def test_no_single_partition_exchange_of_times(spark):
    plan = logrank_parts(_subjects(spark), "g", ["a", "b"], "t", "e", ranges=5)._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line]
    assert rows and all("_blk" in line for line in rows)

"""Hypothesis: stays and sequences equal a plain per-person loop on any small history."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from staylink.config import Study
from staylink.operators.episodes import sequence_episodes
from staylink.operators.stays import transfer_stays

from .test_stays import SCHEMA, _py_stays

BASE = dt.date(2001, 1, 1)

episode = st.tuples(
    st.integers(0, 3),  # person
    st.integers(0, 60),  # start offset in days
    st.sampled_from([0, 0, 1, 2, 5, 40]),  # length
    st.sampled_from(["P", "9", None]),  # mode
    st.integers(0, 1),  # hip
)


def _rows(eps):
    return [(p, i, BASE + dt.timedelta(days=s), BASE + dt.timedelta(days=s + n), m, h)
            for i, (p, s, n, m, h) in enumerate(eps)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(episode, min_size=1, max_size=25), st.sampled_from([1, 3, 8]))
def test_stays_property(spark, eps, ranges):
    rows = _rows(eps)
    got = transfer_stays(spark.createDataFrame(rows, SCHEMA), study=Study(ranges=ranges))
    exp = _py_stays(rows, {"P"})
    assert {r.episode_id: (r.stay_seq, r.trans_seq, r.stay_size, r.sepdate_last) for r in got.collect()} == {
        k: (v[0], v[1], v[2], v[4]) for k, v in exp.items()
    }


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(episode, min_size=1, max_size=25), st.sampled_from([1, 4]))
def test_sequences_property(spark, eps, ranges):
    rows = _rows(eps)
    df = spark.createDataFrame(rows, SCHEMA).drop("mode").withColumnRenamed("hip_flag", "hip_flag")
    got = {r.episode_id: (r.file_seq, r.person_seq, r.hip_seq, r.index_seq)
           for r in sequence_episodes(df, study=Study(ranges=ranges)).collect()}
    order = sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1]))
    exp, pos, per, hip, first = {}, 0, {}, {}, {}
    for r in order:
        pos += 1
        per[r[0]] = per.get(r[0], 0) + 1
        if r[5] == 1:
            hip[r[0]] = hip.get(r[0], 0) + 1
            first.setdefault(r[0], per[r[0]])
        idx = per[r[0]] - first[r[0]] + 1 if r[0] in first else 0
        exp[r[1]] = (pos, per[r[0]], hip[r[0]] if r[5] == 1 else 0, idx)
    assert got == exp


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 400), min_size=2, max_size=60))
def test_describe_and_box_match_numpy(spark, values):
    import numpy as np

    from staylink.operators.report import box_stats, describe

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "person_id long, los int")
    d = describe(df, "los").first()
    q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])  # numpy's default is R's type 7
    assert (d.q1, d.median, d.q3) == (q1, med, q3)
    assert abs(d.sd - float(np.std(values, ddof=1))) < 1e-9 and abs(d.mean - float(np.mean(values))) < 1e-9
    b = box_stats(df, "los").first()
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if lo <= v <= hi]
    assert (b.whisker_low, b.whisker_high, b.n_outliers) == (min(inside), max(inside), len(values) - len(inside))

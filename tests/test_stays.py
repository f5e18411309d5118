import datetime as dt
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from staylink.config import Study
from staylink.operators.stays import hip_stays, transfer_stays

SCHEMA = "person_id long, episode_id long, start_date date, end_date date, mode string, hip_flag int"


def _py_stays(rows, modes):
    """Plain per-person loop with the rule of operators/stays.py."""
    out = {}
    key = lambda r: (r[0], r[2], r[3], r[1])
    for _, grp in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        grp = list(grp)
        latest, prev_mode, stay, pos, members = None, None, 0, 0, []
        for r in grp:
            brk = latest is None or r[2] > latest or (r[2] == latest and prev_mode not in modes)
            if brk:
                stay, pos = stay + 1, 0
            else:
                pos += 1
            members.append((r, stay, pos))
            latest = r[3] if latest is None else max(latest, r[3])
            prev_mode = r[4]
        for s, mem in groupby(members, key=lambda m: m[1]):
            mem = list(mem)
            first = mem[0][0][2]
            last = max(m[0][3] for m in mem)
            hip_stay = mem[0][0][5] == 1
            for r, s_, pos in mem:
                out[r[1]] = (s_, pos, len(mem), first, last, (last - first).days, hip_stay)
    return out


def _tiny_stay():
    d = dt.date
    return [
        # person 1: a long episode with one nested inside, then a gap
        (1, 1, d(2006, 1, 1), d(2006, 1, 30), "9", 1),
        (1, 2, d(2006, 1, 5), d(2006, 1, 10), "9", 0),
        (1, 3, d(2006, 3, 1), d(2006, 3, 2), "9", 0),
        # person 2: two nested in a long one, then a gap, then an overlap
        (2, 4, d(2006, 1, 1), d(2006, 2, 1), "9", 0),
        (2, 5, d(2006, 1, 3), d(2006, 1, 4), "9", 1),
        (2, 6, d(2006, 1, 6), d(2006, 1, 7), "9", 0),
        (2, 7, d(2006, 5, 1), d(2006, 5, 10), "9", 1),
        (2, 8, d(2006, 5, 9), d(2006, 5, 20), "9", 0),
        # person 3: same-day start after a transfer (joins) and after a non-transfer (new stay)
        (3, 9, d(2006, 1, 1), d(2006, 1, 5), "P", 1),
        (3, 10, d(2006, 1, 5), d(2006, 1, 8), "9", 0),
        (3, 11, d(2006, 1, 8), d(2006, 1, 9), None, 0),
        # person 4: null mode before a same-day start: not a transfer
        (4, 12, d(2006, 1, 1), d(2006, 1, 5), None, 1),
        (4, 13, d(2006, 1, 5), d(2006, 1, 6), "P", 0),
    ]


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_tiny_stay(spark, ranges):
    rows = _tiny_stay()
    df = spark.createDataFrame(rows, SCHEMA)
    study = Study(ranges=ranges)
    s = hip_stays(transfer_stays(df, study=study), study=study)
    got = {r.episode_id: (r.stay_seq, r.trans_seq) for r in s.collect()}
    assert got == {
        1: (1, 0), 2: (1, 1), 3: (2, 0),
        4: (1, 0), 5: (1, 1), 6: (1, 2), 7: (2, 0), 8: (2, 1),
        9: (1, 0), 10: (1, 1), 11: (2, 0),
        12: (1, 0), 13: (2, 0),
    }
    full = {r.episode_id: r for r in s.collect()}
    assert full[2].sepdate_last == dt.date(2006, 1, 30) and full[2].totlos == 29
    assert full[8].admdate_first == dt.date(2006, 5, 1) and full[8].sepdate_last == dt.date(2006, 5, 20)
    assert {k: v.hf_stays_all for k, v in full.items()} == {
        1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 8: 1, 9: 1, 10: 1, 11: 0, 12: 1, 13: 0
    }


@pytest.mark.parametrize(
    "seed,ranges", [(11, 40), (12, 9), (13, 3), (14, 1)]
)
def test_stays_equal_python_loop(spark, seed, ranges):
    """Random episodes with long, nested, same-day and transfer cases, long stays across blocks."""
    rnd = random.Random(seed)
    rows, eid = [], 0
    for p in range(25):
        day = dt.date(2000, 1, 1)
        for _ in range(rnd.choice([1, 3, 10, 60])):
            day = day + dt.timedelta(days=rnd.choice([0, 0, 1, 2, 5, 30, 200]))
            length = rnd.choice([0, 0, 1, 2, 10, 100, 700])
            rows.append((p, eid, day, day + dt.timedelta(days=length), rnd.choice(["P", "9", None]), int(rnd.random() < .4)))
            eid += 1
    rnd.shuffle(rows)
    expected = _py_stays(rows, {"P"})
    df = spark.createDataFrame(rows, SCHEMA)
    study = Study(ranges=ranges)
    s = hip_stays(transfer_stays(df, study=study), study=study).collect()
    got = {r.episode_id: (r.stay_seq, r.trans_seq, r.stay_size, r.admdate_first, r.sepdate_last, r.totlos,
                          r.hf_stays_all > 0) for r in s}
    assert got == expected
    # stays of a person do not overlap; trans_seq runs 0..k-1
    by = {}
    for r in s:
        by.setdefault((r.person_id, r.stay_seq), []).append(r.trans_seq)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stays_do_not_depend_on_input_order(spark):
    rows = _tiny_stay()
    a = transfer_stays(spark.createDataFrame(rows, SCHEMA)).select("episode_id", "stay_seq", "trans_seq")
    b = transfer_stays(spark.createDataFrame(list(reversed(rows)), SCHEMA).repartition(5))
    b = b.select("episode_id", "stay_seq", "trans_seq")
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.filter(F.col("trans_seq") < 0).count() == 0

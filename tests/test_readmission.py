import datetime as dt

from staylink.operators.readmission import censor_times, negative_times, next_admission, outcome_table

END = dt.date(2014, 6, 30)
IDX = "person_id long, episode_id long, discharge_date date, death_date date, grp string"
ADM = "person_id long, start_date date"


def test_tiny_readmit(spark):
    d = dt.date
    index = spark.createDataFrame(
        [
            (1, 1, d(2010, 1, 10), None, "a"),  # same-day readmission only: no event
            (2, 2, d(2010, 1, 10), None, "a"),  # non-hip readmission next day: event
            (3, 3, d(2010, 1, 10), d(2014, 6, 30), "b"),  # death on the last study day
            (4, 4, d(2010, 1, 10), d(2015, 1, 1), "b"),  # death after the study
            (5, 5, d(2010, 1, 10), None, "b"),  # two next admissions on one day
        ],
        IDX,
    )
    adm = spark.createDataFrame(
        [(1, d(2010, 1, 1)), (1, d(2010, 1, 10)), (2, d(2010, 1, 11)), (2, d(2011, 1, 1)),
         (5, d(2010, 3, 1)), (5, d(2010, 3, 1)), (5, d(2012, 1, 1)), (9, d(2010, 2, 1))],
        ADM,
    )
    out = censor_times(next_admission(index, adm), END)
    got = {r.person_id: (r.next_admission_date, r.event, r.censor_date, r.followup_end, r.time_to_next)
           for r in out.collect()}
    assert got[1] == (None, 0, END, END, (END - d(2010, 1, 10)).days)
    assert got[2] == (d(2010, 1, 11), 1, END, d(2010, 1, 11), 1)
    assert got[3][1:4] == (0, END, END)
    assert got[4][1:4] == (0, END, END)
    assert got[5][:2] == (d(2010, 3, 1), 1)
    assert out.count() == 5
    t = {r.grp: r for r in outcome_table(out, "grp", END).collect()}
    assert (t["a"].total_patients, t["a"].readmitted, t["a"].censored_death, t["a"].censored_end) == (2, 1, 0, 1)
    assert (t["b"].total_patients, t["b"].readmitted, t["b"].censored_death, t["b"].censored_end) == (3, 1, 1, 1)
    for r in t.values():
        assert r.readmitted + r.censored_death + r.censored_end == r.total_patients
    assert tuple(negative_times(out).first()) == (5, 0, 0)

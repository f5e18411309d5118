"""The whole analysis from text extracts with the course's own column names."""

import datetime as dt
import os

from pyspark.sql import functions as F

from staylink.config import DeathCols, EpisodeCols, Study
from staylink.operators.survival import km_table
from staylink.plans.pipeline import Analysis
from staylink.sources.csv import write_text_csv

COLS = EpisodeCols(
    person="NOF_PPN", episode="episode_id", start="episode_start_date", end="episode_end_date",
    age="age_recode", code="diagnosis_codeP", mode="mode_of_separation_recode",
)
DCOLS = DeathCols(person="NOF_ppn", date="death_date", age="age_recode")
STUDY = Study(start=dt.date(2005, 7, 1), end=dt.date(2014, 6, 30), hip_pattern=r"^S72\.[012]", transfer_modes=("5",))
EP_COLS = ["NOF_PPN", "episode_start_date", "episode_end_date", "age_recode", "diagnosis_codeP",
           "mode_of_separation_recode"]


def test_from_csv_end_to_end(spark, tmp_path):
    ep = [
        ("1710", "01/08/2006", "05/08/2006", "70", "I21.0", "9"),
        ("1710", "03/09/2007", "10/09/2007", "71", "S72.00", "5"),  # hip, transferred
        ("1710", "10/09/2007", "20/09/2007", "71", "Z50.9", "9"),  # same day after a transfer: same stay
        ("1710", "01/03/2008", "02/03/2008", "72", "J18.9", "9"),  # readmission
        ("3399", "02/02/2009", "12/02/2009", "80", "S72.10", "9"),
        ("3399", "02/02/2009", "12/02/2009", "80", "S72.10", "9"),  # exact copy
        ("4000", "02/02/2009", "12/02/2009", "60", "S72.10", "9"),  # hip below 65: not in the cohort
    ]
    deaths = [("3399", "01/01/2012", "83"), ("3399", "01/01/2011", "82")]
    ep_path, d_path = str(tmp_path / "ep"), str(tmp_path / "d")
    write_text_csv(spark.createDataFrame(ep, ", ".join(f"{c} string" for c in EP_COLS)), ep_path)
    write_text_csv(spark.createDataFrame(deaths, "NOF_ppn string, death_date string, age_recode string"), d_path)
    a = Analysis.from_csv(spark, ep_path, d_path, STUDY, COLS, DCOLS, episode_columns=EP_COLS)
    stays = {r.episode_start_date: r for r in a.stays.collect()}
    assert len(stays) == 5  # copy dropped, person 4000 out of the cohort
    s1 = stays[dt.date(2007, 10, 9) - dt.timedelta(days=36)]  # 2007-09-03
    s2 = stays[dt.date(2007, 9, 10)]
    assert (s1.stay_seq, s1.trans_seq, s2.stay_seq, s2.trans_seq) == (2, 0, 2, 1)
    assert s2.sepdate_last == dt.date(2007, 9, 20) and s1.totlos == 17
    sc = {r.NOF_PPN: r for r in a.scored.collect()}
    assert sc["1710"].next_admission_date == dt.date(2008, 3, 1) and sc["1710"].event == 1
    assert sc["1710"].time_to_next == (dt.date(2008, 3, 1) - dt.date(2007, 9, 20)).days
    # person 3399 has two death records and no later episode: the later one is kept
    assert sc["3399"].death_date == dt.date(2012, 1, 1) and sc["3399"].event == 0
    assert sc["3399"].censor_date == dt.date(2012, 1, 1)
    assert km_table(a.scored, "cci_label").filter(F.col("n_event") > 0).count() == 1


def test_answers_on_the_fixture(spark):
    from staylink.plans.answers import answers

    from .conftest import SF001

    out = answers(Analysis(spark, SF001))
    counts = {k: v.count() for k, v in out.items()}
    assert counts.pop("rejected_lines") == 0  # the fixture views are no text
    assert all(c > 0 for c in counts.values()), counts
    lr = out["q6_logrank"].first()
    assert lr.df == 2 and 0 <= lr.p <= 1


def test_answers_cli(spark, tmp_path):
    from staylink.plans.answers import main

    ep = [("1", "01/08/1997", "05/08/1997", "70", "1-URGENT", "F"), ("1", "01/09/1998", "02/09/1998", "71", "5-LOW", "F")]
    d = [("1", "01/01/2000", "72")]
    cols = ["person_id", "start_date", "end_date", "age", "diag_code", "mode"]
    write_text_csv(spark.createDataFrame(ep, ", ".join(f"{c} string" for c in cols)), str(tmp_path / "ep"))
    write_text_csv(spark.createDataFrame(d, "person_id string, death_date string, age_death string"), str(tmp_path / "d"))
    main(["--episodes", str(tmp_path / "ep"), "--deaths", str(tmp_path / "d"), "--out", str(tmp_path / "out"),
          "--episode-columns", ",".join(cols)])
    assert os.path.isdir(tmp_path / "out" / "q6_outcomes") and os.path.isdir(tmp_path / "out" / "q1_first_by_year")


def test_diagnoses_use_the_charlson_map(spark, tmp_path):
    ep = [
        ("1", "01/08/2006", "05/08/2006", "70", "S72.00", "9"),
        ("2", "01/08/2006", "05/08/2006", "80", "S72.10", "9"),
    ]
    d = [("9", "01/01/2010", "70")]
    ep_path, d_path = str(tmp_path / "ep"), str(tmp_path / "d")
    write_text_csv(spark.createDataFrame(ep, ", ".join(f"{c} string" for c in EP_COLS)), ep_path)
    write_text_csv(spark.createDataFrame(d, "NOF_ppn string, death_date string, age_recode string"), d_path)
    probe = Analysis.from_csv(spark, ep_path, d_path, STUDY, COLS, DCOLS, episode_columns=EP_COLS)
    ids = {r.NOF_PPN: r.episode_id for r in probe.stays.collect()}
    dx = spark.createDataFrame(
        [(ids["1"], "I21.9"), (ids["1"], "E11.2"), (ids["1"], "E11.9"), (ids["2"], "C78.0"), (ids["2"], "C18.7")],
        "episode_id string, code string",
    )
    a = Analysis.from_csv(spark, ep_path, d_path, STUDY, COLS, DCOLS, episode_columns=EP_COLS, diagnoses=dx)
    got = {r.NOF_PPN: (r.cci_score, r.cci_label) for r in a.scored.collect()}
    assert got == {"1": (3, "CCI 3+"), "2": (6, "CCI 3+")}


def test_spellings_of_one_episode_are_one(spark, tmp_path):
    """Typed first, then distinct: two spellings of the same dates are one episode; a null before
    or after a value makes two. Ids stay text."""
    ep = [
        ("P77", "02/02/2009", "12/02/2009", "80", "S72.10", "9"), ("P77", "2/2/2009", "12-Feb-2009", "80", "S72.10", "9"),
        ("P78", "02/02/2009", "12/02/2009", "80", "S72.10", None), ("P78", "02/02/2009", "12/02/2009", "80", None, "S72.10"),
    ]
    write_text_csv(spark.createDataFrame(ep, ", ".join(f"{c} string" for c in EP_COLS)), str(tmp_path / "ep"))
    write_text_csv(spark.createDataFrame([("P9", "01/01/2010", "70")], "NOF_ppn string, death_date string, age_recode string"), str(tmp_path / "d"))
    a = Analysis.from_csv(spark, str(tmp_path / "ep"), str(tmp_path / "d"), STUDY, COLS, DCOLS, episode_columns=EP_COLS)
    assert sorted((r.NOF_PPN, r.person_seq) for r in a.sequenced.collect()) == [("P77", 1), ("P78", 1), ("P78", 2)]
    # without a long table, the episodes' own codes are scored
    assert {r.NOF_PPN: r.cci_score for r in a.scored.collect()}["P77"] == 0
    paths = list(a.stage_paths)
    a.close()
    assert paths and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_changed_input_gives_the_new_answer(spark, tmp_path):
    import shutil

    from staylink.plans.queries import QUERIES

    from .conftest import SF001

    for t in ("orders", "lineitem", "customer", "part"):
        shutil.copy(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = QUERIES["cohort_size"](spark, str(tmp_path)).collect()
    half = spark.read.parquet(f"{SF001}/orders.parquet").filter("o_orderkey % 2 = 0").toPandas()
    os.chmod(tmp_path / "orders.parquet", 0o644)
    half.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    again = QUERIES["cohort_size"](spark, str(tmp_path)).collect()
    assert again[0].n_episodes < first[0].n_episodes


def test_written_stages_equal_the_lazy_plan(spark):
    from .conftest import SF001

    lazy = Analysis(spark, SF001, materialize_stages=False)
    written = Analysis(spark, SF001)
    cols = ["episode_id", "stay_seq", "trans_seq", "sepdate_last", "totlos", "hip_seq", "file_seq", "death_date"]
    assert sorted(lazy.stays.select(*cols).collect()) == sorted(written.stays.select(*cols).collect())
    s = ["person_id", "event", "time_to_next", "cci_group"]
    assert sorted(lazy.scored.select(*s).collect()) == sorted(written.scored.select(*s).collect())


def test_malformed_lines_are_rejected_and_counted(spark, tmp_path):
    """Neither padded nor cut: a line with too few or too many fields is a reject with its file and text."""
    from staylink.sources.csv import read_with_rejects

    (tmp_path / "a.csv").write_text('x,y,z\n1,2,3\n4,5\n"6,6",7,8\n9,10,11,12\n,,\nNA,NA,NA\n13\n')
    rows, rejects = read_with_rejects(spark, str(tmp_path), ["x", "y", "z"])
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([("1", "2", "3"), ("6,6", "7", "8"), (None, None, None), (None, None, None)], key=repr)
    got = sorted((r.line, r.n_fields, r.reason) for r in rejects.collect())
    assert got == [("13", 1, "too few fields"), ("4,5", 2, "too few fields"), ("9,10,11,12", 4, "too many fields")]
    assert {r.file.rsplit("/", 1)[1] for r in rejects.collect()} == {"a.csv"}
    # whatever a query asks for, the same lines count
    assert rows.count() == 4 and rejects.count() == 3 and rows.select("x").filter("x is not null").count() == 2


def test_rejects_of_an_analysis(spark, tmp_path):
    from staylink.plans.answers import ANSWERS

    (tmp_path / "ep").mkdir()
    (tmp_path / "d").mkdir()
    (tmp_path / "ep" / "e.csv").write_text(",".join(EP_COLS) + "\nP1,02/02/2009,12/02/2009,80,S72.10,9\nP1,05/02/2009,12/02/2009,80\n")
    (tmp_path / "d" / "d.csv").write_text("NOF_ppn,death_date,age_recode\nP1,01/01/2010,70,9,9\n")
    a = Analysis.from_csv(spark, str(tmp_path / "ep"), str(tmp_path / "d"), STUDY, COLS, DCOLS, episode_columns=EP_COLS)
    assert sorted((r.table, r.n_fields) for r in a.rejects.collect()) == [("deaths", 5), ("episodes", 4)]
    assert a.sequenced.count() == 1 and a.deaths.count() == 0
    report = ANSWERS["ingest_report"](a).first()
    assert (report.n_rows, report.n_kept, report.n_rejected) == (1, 1, 1)
    a.close()


def test_part_two_from_the_linked_table(spark, tmp_path):
    """SRC-2: the linked table written as text is an entry point: part two gives the same stays and times."""
    from staylink.config import DeathCols, EpisodeCols, Study

    from .conftest import SF001

    whole = Analysis(spark, SF001)
    names = [*EpisodeCols().all(), DeathCols().date, DeathCols().age]
    write_text_csv(whole.linked.select(*names).na.fill("NA"), str(tmp_path / "linked"))
    a = Analysis.from_linked_csv(spark, str(tmp_path / "linked"), names, Study())
    cols = ["stay_seq", "trans_seq", "sepdate_last", "totlos", "hip_seq", "death_date"]
    got = sorted((int(r.episode_id), *r[1:]) for r in a.stays.select("episode_id", *cols).collect())
    assert got == sorted(map(tuple, whole.stays.select("episode_id", *cols).collect()))
    times = ["event", "time_to_next"]
    assert sorted((int(r.person_id), *r[1:]) for r in a.readmission.select("person_id", *times).collect()) == sorted(
        map(tuple, whole.readmission.select("person_id", *times).collect())
    )
    assert a.rejects.count() == 0
    a.close()
    whole.close()

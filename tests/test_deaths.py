import datetime as dt

from staylink.operators.deaths import death_vs_episodes, dropped_persons, kept_records, link_deaths, multi_records, resolve_deaths

EP = "person_id long, episode_id long, start_date date, end_date date"
DT = "person_id long, death_date date, age_death int"


def _tiny(spark):
    d = dt.date
    episodes = [
        (1, 1, d(2006, 1, 1), d(2006, 1, 2)), (1, 2, d(2008, 6, 1), d(2008, 6, 2)),  # between the two dates
        (2, 3, d(2006, 1, 1), d(2006, 1, 2)), (2, 4, d(2012, 1, 1), d(2012, 1, 2)),  # after both dates
        (3, 5, d(2006, 1, 1), d(2006, 1, 2)), (3, 6, d(2011, 1, 1), d(2011, 1, 2)),  # after its only date
        (4, 7, d(2006, 1, 1), d(2006, 1, 2)),
    ]
    deaths = [
        (1, d(2008, 1, 1), 79), (1, d(2009, 1, 1), 80), (1, d(2009, 1, 1), 80),  # exact copy too
        (2, d(2010, 1, 1), 70), (2, d(2011, 1, 1), 71),
        (3, d(2010, 1, 1), 90),
        (5, d(2010, 1, 1), 60), (5, d(2010, 2, 1), 61),  # no episodes: latest kept
    ]
    return spark.createDataFrame(episodes, EP), spark.createDataFrame(deaths, DT)


def test_multi_records(spark):
    _, deaths = _tiny(spark)
    assert sorted((r.person_id, r.death_date) for r in multi_records(deaths).collect()) == [
        (1, dt.date(2008, 1, 1)), (1, dt.date(2009, 1, 1)), (2, dt.date(2010, 1, 1)), (2, dt.date(2011, 1, 1)),
        (5, dt.date(2010, 1, 1)), (5, dt.date(2010, 2, 1)),
    ]


def test_death_vs_episodes(spark):
    ep, deaths = _tiny(spark)
    got = {(r.person_id, r.death_date): (r.n_episodes, r.n_after) for r in death_vs_episodes(deaths, ep).collect()}
    assert got[(1, dt.date(2008, 1, 1))] == (2, 1)
    assert got[(3, dt.date(2010, 1, 1))] == (2, 1)
    assert got[(5, dt.date(2010, 1, 1))] == (0, 0)


def test_resolve_and_link(spark):
    ep, deaths = _tiny(spark)
    both = resolve_deaths(deaths, ep)
    resolved, dropped = kept_records(both), dropped_persons(both)
    assert sorted(tuple(r) for r in resolved.collect()) == [
        (1, dt.date(2009, 1, 1), 80), (3, dt.date(2010, 1, 1), 90), (5, dt.date(2010, 2, 1), 61)
    ]
    assert [r.person_id for r in dropped.collect()] == [2]
    linked = link_deaths(ep, both)
    assert linked.count() == 5  # person 2 removed, no episode multiplied
    assert {r.episode_id: r.death_date for r in linked.collect()}[7] is None


def test_exclusion_list(spark):
    ep, deaths = _tiny(spark)
    both = resolve_deaths(deaths, ep, exclude=[1])
    resolved, dropped = kept_records(both), dropped_persons(both)
    assert sorted(r.person_id for r in dropped.collect()) == [1, 2]
    assert sorted(r.person_id for r in resolved.collect()) == [3, 5]


def test_death_csv_ingest(spark, tmp_path):
    from staylink.operators.deaths import type_deaths
    from staylink.sources.csv import read_text_csv, write_text_csv

    rows = [("7", "01/02/2010", "80"), ("7", "01/02/2010", "80"), ("8", "1FEB2011", "NA"), ("9", "31/02/2011", "70")]
    path = str(tmp_path / "deaths")
    write_text_csv(spark.createDataFrame(rows, "person_id string, death_date string, age_death string"), path)
    d = type_deaths(read_text_csv(spark, path, ["person_id", "death_date", "age_death"]))
    got = sorted(tuple(r) for r in d.collect())
    assert got == [("7", dt.date(2010, 2, 1), 80), ("8", dt.date(2011, 2, 1), None), ("9", None, 70)]


def test_records_without_a_person_link_with_no_one(spark):
    ep, deaths = _tiny(spark)
    none = spark.createDataFrame([(None, dt.date(2001, 1, 1), 70), (None, dt.date(2002, 1, 1), 71)], deaths.schema)
    assert sorted(map(str, resolve_deaths(deaths.unionByName(none), ep).collect())) == sorted(map(str, resolve_deaths(deaths, ep).collect()))
    assert multi_records(none).count() == 0

from staylink.operators.comorbidity import charlson_map, charlson_rows, comorbidity_score, score_groups


def test_map_expansion():
    rows = charlson_rows()
    by = {}
    for p, c, w in rows:
        by.setdefault(c, set()).add(p)
    assert {"I425", "I426", "I427", "I428", "I429"} <= by["heart_failure"]
    assert len([p for p in by["cerebrovascular"] if p.startswith("I6")]) == 10
    assert "E116" in by["diabetes_uncomplicated"] and "E117" in by["diabetes_complicated"]
    assert by["metastatic_solid_tumour"] == {"C77", "C78", "C79", "C80"}
    assert len(by["malignancy"]) == 27 + 5 + 5 + 1 + 14 + 17 + 5 + 1 + 8
    assert len({c for _, c, _ in rows}) == 17


def test_score_with_hierarchy_and_dots(spark):
    index = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "person_id long, episode_id long")
    dx = spark.createDataFrame(
        [
            (10, "I21.4"), (10, "I21.9"),  # MI counted once: 1
            (10, "E11.6"), (10, "E11.2"),  # complicated diabetes suppresses uncomplicated: 2
            (20, "C18.7"), (20, "C78.0"),  # metastatic suppresses malignancy: 6
            (30, "S72.0"),  # nothing
            (99, "C78.0"),  # not an index episode
        ],
        "episode_id long, code string",
    )
    out = score_groups(comorbidity_score(index, dx, charlson_map(spark)))
    got = {r.episode_id: (r.cci_score, r.ccicat, r.cci_group, r.cci_label, r.cci_rank) for r in out.collect()}
    assert got == {
        10: (3, "[3,Inf)", "3+", "CCI 3+", 3),
        20: (6, "[3,Inf)", "3+", "CCI 3+", 3),
        30: (0, "[0,1)", "0", "CCI 0", 1),
        40: (0, "[0,1)", "0", "CCI 0", 1),
    }


def test_groups_of_scores(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "cci_score int")
    assert [(r.cci_group, r.cci_label) for r in score_groups(df).orderBy("cci_score").collect()] == [
        ("0", "CCI 0"), ("1-2", "CCI 1–2"), ("1-2", "CCI 1–2"), ("3+", "CCI 3+"), ("3+", "CCI 3+")
    ]

import math

import pytest

from staylink.operators.survival import chi2_sf, km_at_times, km_median, km_table, logrank_parts, logrank_test

# Published remission data (Freireich et al. 1963); a trailing "+" marks a censored time.
SIX_MP = "6 6 6 6+ 7 9+ 10 10+ 11+ 13 16 17+ 19+ 20+ 22 23 25+ 32+ 32+ 34+ 35+"
PLACEBO = "1 1 2 2 3 4 4 5 5 8 8 8 8 11 11 12 12 15 17 22 23"


def _rows(text, grp):
    return [(grp, int(t.rstrip("+")), 0 if t.endswith("+") else 1) for t in text.split()]


@pytest.fixture
def km6(spark):
    return spark.createDataFrame(_rows(SIX_MP, "6MP") + _rows(PLACEBO, "placebo"), "grp string, time int, event int")


def test_km_6mp(km6):
    km = {(r.grp, r.time): r for r in km_table(km6, "grp", "time", "event").collect()}
    s6 = km[("6MP", 6)]
    assert round(s6.surv, 4) == 0.8571 and round(s6.lower, 4) == 0.7198 and s6.upper == 1.0
    assert round(km[("6MP", 10)].surv, 4) == 0.7529
    assert round(km[("6MP", 23)].surv, 4) == 0.4482
    assert round(km[("placebo", 8)].surv, 4) == 0.3810
    assert km[("placebo", 23)].surv == 0.0 and km[("placebo", 23)].lower is None
    med = {r.grp: r.median_time for r in km_median(km_table(km6, "grp", "time", "event"), "grp", "time").collect()}
    assert med == {"6MP": 23, "placebo": 8}
    # S never rises; events add up
    for g in ("6MP", "placebo"):
        ss = [km[k].surv for k in sorted(k for k in km if k[0] == g)]
        assert all(a >= b for a, b in zip(ss, ss[1:]))
    assert sum(r.n_event for r in km.values()) == 9 + 21


def test_km_at_times(km6):
    at = {(r.grp, r.time): r for r in km_at_times(km_table(km6, "grp", "time", "event"), "grp", [0, 6, 7, 30], "time").collect()}
    assert at[("6MP", 0)].surv == 1.0 and at[("6MP", 0)].n_risk == 21
    assert round(at[("6MP", 6)].surv, 4) == 0.8571 and round(at[("6MP", 7)].surv, 4) == 0.8067
    assert at[("placebo", 30)].surv == 0.0 and at[("placebo", 30)].n_risk == 0


def test_logrank_6mp(km6):
    parts = logrank_parts(km6, "grp", ["6MP", "placebo"], "time", "event")
    p = {r.grp: r for r in parts.collect()}
    assert p["6MP"].observed == 9 and p["placebo"].observed == 21
    assert round(p["6MP"].expected, 4) == 19.2505 and round(p["placebo"].expected, 4) == 10.7495
    assert round(p["6MP"].v_0, 5) == 6.25696
    assert math.isclose(sum(r.observed for r in p.values()), sum(r.expected for r in p.values()))
    t = logrank_test(parts)
    assert round(t["chi2"], 4) == 16.7929 and t["df"] == 1
    assert math.isclose(t["p"], math.erfc(math.sqrt(t["chi2"] / 2)), rel_tol=1e-9)


def test_km_three_groups(spark):
    rows = [("a", t, e) for t, e in [(1, 1), (2, 0), (3, 1), (4, 1)]]  # last subject has an event: S = 0
    rows += [("b", t, 0) for t in (2, 5, 9)]  # no event at all
    rows += [("c", t, e) for t, e in [(1, 0), (2, 1), (2, 1), (6, 0), (8, 1)]]
    df = spark.createDataFrame(rows, "grp string, time int, event int")
    km = {(r.grp, r.time): r.surv for r in km_table(df, "grp", "time", "event").collect()}
    assert km[("a", 4)] == 0.0 and km[("b", 9)] == 1.0
    t = logrank_test(logrank_parts(df, "grp", ["a", "b", "c"], "time", "event"))
    assert t["df"] == 2 and math.isclose(t["p"], math.exp(-t["chi2"] / 2), rel_tol=1e-9)
    # the test does not depend on which group is left out
    t2 = logrank_test(logrank_parts(df, "grp", ["c", "a", "b"], "time", "event"))
    assert math.isclose(t["chi2"], t2["chi2"], rel_tol=1e-9)


def test_chi2_sf_values():
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_sf(5.991464547107979, 2), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_sf(7.814727903251179, 3), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_sf(0.5, 4), 0.9735009788392561, rel_tol=1e-9)

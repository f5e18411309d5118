"""The ordered scan against plain per-key loops, over many layouts of ranges."""

import random

import pytest
from pyspark.sql import functions as F

from staylink.operators.scan import BLOCK, KINDS, drop_block, ordered_scan, segment_max

SCHEMA = "k string, t int, id int, v int"


def rows_of(rng, n, hot):
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None, "d"])
        out.append((key, rng.randrange(n // 3) if rng.random() < 0.95 else None, i, rng.choice([None, *range(-3, 4)])))
    return out


def null_last(x):
    return (x is None, x or 0)


def plainly(rows):
    """Every kind of running value by a loop over each key's rows."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (null_last(r[1]), r[2]))
        vs = [r[3] for r in mine]
        for i, r in enumerate(mine):
            seen, before, after = [v for v in vs[: i + 1] if v is not None], [v for v in vs[:i] if v is not None], [v for v in vs[i + 1 :] if v is not None]
            product = 1.0
            for v in seen:
                product *= 1 + v / 10
            positive = [j + 1 for j in range(i + 1) if (vs[j] or 0) > 0]
            out[r[2]] = {
                "count": i + 1, "sum": sum(seen), "sum_before": sum(before), "product": round(product, 9),
                "max": max(seen, default=None), "max_before": max(before, default=None), "last_before": before[-1] if before else None,
                "prev": vs[i - 1] if i else None, "first_pos": positive[0] if positive else None, "last_pos": positive[-1] if positive else None,
                "sum_from": sum(v for v in vs[i:] if v is not None), "min_after": min(after, default=None), "next": after[0] if after else None,
            }
    return out


@pytest.mark.parametrize(("n", "hot", "ranges"), [(60, 0.4, 1), (60, 0.4, 13), (40, 1.0, 9), (90, 0.0, 5), (3, 0.5, 8)])
def test_every_kind(spark, n, hot, ranges):
    rows = rows_of(random.Random(n + ranges), n, hot)
    v = F.col("v")
    specs = {k: (k, {"product": F.lit(1) + v / 10, "first_pos": v > 0, "last_pos": v > 0}.get(k, v)) for k in KINDS}
    specs["count"] = ("count", None)
    out = drop_block(ordered_scan(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "id"], specs, ranges=ranges, global_position="at"))
    want = plainly(rows)
    got = {r.id: r.asDict() for r in out.collect()}
    for i, w in want.items():
        assert {k: round(got[i][k], 9) if k == "product" else got[i][k] for k in w} == w, i
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", null_last(r[1]), r[2]))
    assert [got[r[2]]["at"] for r in ordered] == list(range(1, n + 1))


def test_levels_in_one_layout(spark):
    """A second scan over the first one's result, and maxima of segments that span ranges."""
    rows = rows_of(random.Random(5), 80, 0.5)
    df = ordered_scan(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "id"], {"at": ("count", None)}, ranges=11)
    df = ordered_scan(df.withColumn("brk", (F.col("at") % 7 == 1).cast("int")), ["k"], ["t", "id"], {"seg": ("sum", F.col("brk"))})
    out = drop_block(segment_max(df, ["k"], "seg", {"best": "v", "last": F.col("at")})).collect()
    for r in out:
        mine = [x for x in out if (x.k, x.seg) == (r.k, r.seg)]
        assert r.seg == (r["at"] - 1) // 7 + 1
        assert r["last"] == max(x["at"] for x in mine) and r.best == max((x.v for x in mine if x.v is not None), default=None)


def test_no_key_is_one_sequence(spark):
    rows = [(None, t, t, 1) for t in range(50)]
    out = ordered_scan(spark.createDataFrame(rows, SCHEMA), [], ["t"], {"behind": ("sum_from", F.col("v")), "upto": ("sum", F.col("v"))}, ranges=6)
    assert sorted((r.t, r.upto, r.behind) for r in out.collect()) == [(t, t + 1, 50 - t) for t in range(50)]
    assert out.select(BLOCK).distinct().count() == 6


def test_an_empty_table(spark):
    out = ordered_scan(spark.createDataFrame([], SCHEMA), ["k"], ["t", "id"], {"n": ("next", F.col("v")), "s": ("sum", F.col("v"))}, ranges=3, global_position="at")
    assert out.collect() == []
    with pytest.raises(ValueError):
        ordered_scan(spark.createDataFrame([], SCHEMA), ["k"], ["t"], {"x": ("median", F.col("v"))})


def test_rows_behind_cost_what_rows_ahead_cost(spark):
    """No frame ends at the last row: such a frame is made anew for every row of a key in a range."""
    v = F.col("v")
    df = spark.createDataFrame([("a", i, i, i) for i in range(20)], SCHEMA)
    out = ordered_scan(df, ["k"], ["t", "id"], {k: (k, v) for k in ("sum_from", "min_after", "next")}, ranges=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rowframe, unboundedpreceding" in plan.replace("specifiedwindowframe(", "") and "unboundedfollowing" not in plan
    assert sorted((r.id, r.sum_from, r.min_after, r.next) for r in out.collect()) == [(i, sum(range(i, 20)), *[i + 1 if i < 19 else None] * 2) for i in range(20)]

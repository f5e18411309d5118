import math

import numpy as np

from staylink.llm.lattice_dedup import cells, decode, links, roots, unit

from .conftest import frame, groups


def test_decoder_finds_the_nearest_point():
    r = np.random.default_rng(1)
    assert len(roots()) == 240
    y = r.standard_normal((300, 8)) * 2
    x = decode(y)
    doubled = np.round(2 * x).astype(int)
    assert (doubled.sum(axis=1) % 4 == 0).all() and (np.ptp(doubled % 2, axis=1) == 0).all()
    own = ((y - x) ** 2).sum(axis=1)
    for v in roots():
        assert (own <= ((y - x - v) ** 2).sum(axis=1) + 1e-9).all()


def test_recall_at_the_threshold():
    r = np.random.default_rng(0)
    x, z = unit(r.standard_normal((2000, 64))), r.standard_normal((2000, 64))
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z
    hit = np.zeros(len(x), bool)
    for (hx, ax), (hy, ay) in zip(cells(x, np.zeros(2000, np.uint64), 5, 9, 1.0), cells(y, np.zeros(2000, np.uint64), 5, 9, 1.0), strict=True):
        hit |= (hx == hy) | (ax == hy[:, None]).any(axis=1) | (ay == hx[:, None]).any(axis=1)
    assert hit.mean() > 0.999


def test_equals_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((4, 16))
    rows = [(i, (base[i % 4] + 0.06 * r.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(120)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(30)] + [(300, base[0].tolist(), None), (301, None, 0), (302, [0.0] * 16, 0), (303, [math.nan] * 16, 0), (304, [None] * 16, 0), (305, [], 0), (306, [1.0, 2.0], 0), (307, [math.inf] * 16, 0), (200, base[0].tolist(), 0), (None, base[0].tolist(), 0)]
    table = frame(spark, rows, "vec_id long, embedding array<float>, label int", clash=("cls", "key", "size", "h1"))

    def ok(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        x, y = (np.array(v, np.float32).astype(float) for v in (a[1], b[1]))
        return a[2] == b[2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98

    good = [k for k, row in enumerate(rows) if row[0] is not None and ok(row[1], row[2])]
    pairs = [(a, b) for a in good for b in good if a != b and linked(rows[a], rows[b])]
    low = groups([(rows[a][0], rows[b][0]) for a, b in pairs], {row[0] for row in rows if row[0] is not None})
    count = {k: 0 for k in range(len(rows))}
    for a, _ in pairs:
        count[a] += 1
    want = sorted(((row[0], count[k], low.get(row[0]), row[0] is None or low[row[0]] == row[0]) for k, row in enumerate(rows)), key=repr)
    for chunk in (1024, 7):
        got = links(table, chunk=chunk).collect()
        assert sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in got), key=repr) == want


def test_empty_table(spark):
    assert links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0

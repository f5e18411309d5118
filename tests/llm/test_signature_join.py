import re

import numpy as np

from staylink.llm import signature_join
from staylink.llm.signature_join import Tree, dual, near_duplicates

from .conftest import frame, groups, prose


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
    return " ".join(w)


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = groups([(rows[a][0], rows[b][0]) for a, b in pairs], {i for i, _ in rows if i is not None})
    return sorted(((i, len(s), low.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def test_equals_brute_force(spark, rng):
    base = [prose(rng, n) for n in (30, 80, 200, 7)]
    rows = [(i, changed(rng, rng.choice(base), rng.randrange(5))) for i in range(90)] + [(200 + i, base[1]) for i in range(10)]
    rows += [(300, "one two three"), (301, "One  TWO three"), (302, "one"), (303, None), (304, ""), (305, " \n"), (None, base[1]), (306, base[2] + " " + base[2]), (200, base[1])]
    # a chain: each links with the next alone
    chain = base[2].split()
    rows += [(400 + i, " ".join(chain[3 * i : 3 * i + 100])) for i in range(20)]
    docs = frame(spark, rows, "doc_id long, text string", clash=("cls", "g", "n", "component"))
    for chunk, frequent in ((4096, 100_000), (5, 0)):
        got = near_duplicates(docs, chunk=chunk, frequent=frequent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4, 85)
    got = near_duplicates(docs, k=5, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 5, 80)


def test_counts_every_link(spark, rng):
    """A family of similar texts has a link for every pair, not only those that connect it."""
    base = [prose(rng, n) for n in (120, 300, 6)]
    rows = [(i, changed(rng, base[i % 2], rng.randrange(4))) for i in range(60)] + [(100 + i, base[0]) for i in range(4)]
    rows += [(200, base[2]), (201, base[2].upper()), (202, None), (203, ""), (None, base[0]), (200, base[1])]
    sets = [shingles(t, 4) if i is not None else set() for i, t in rows]
    want = [(i, sum(b != a and bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for b in range(len(rows)))) for a, (i, _) in enumerate(rows)]
    assert max(n for _, n in want) > 20
    docs = frame(spark, rows, "doc_id long, text string", clash=("cls", "size", "links", "others"))
    for chunk, frequent in ((4096, 100_000), (5, 0)):
        got = near_duplicates(docs, chunk=chunk, frequent=frequent, n_links=True).collect()
        assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == sorted(want, key=repr)
    empty = near_duplicates(spark.createDataFrame([], "doc_id long, text string"), n_links=True)
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and empty.count() == 0


def test_candidates_of_a_large_family_stay_in_their_task(spark, rng, monkeypatch):
    """Copies almost near enough to link, in one large group: their candidate pairs are no rows, only their classes are."""
    base, used, rows = prose(rng, 240).split(), set(), []
    while len(rows) < 160:  # three changed words each, of two texts at most one at the same place: 213 to 217 of 237 shingles in common
        at = sorted(rng.sample(range(8, 232, 4), 3))
        pairs = {(at[0], at[1]), (at[0], at[2]), (at[1], at[2])}
        if not pairs & used:
            used |= pairs
            rows.append((len(rows), " ".join(f"new{len(rows)}" if i in at else w for i, w in enumerate(base))))
    rows += [(500 + i, t) for i, t in rows[:5]] + [(600 + i, t + " end") for i, t in rows[3:9]]
    sizes, plain = {}, signature_join.written

    def spied(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(signature_join, "written", spied)
    want = brute(rows, 4, 85)
    assert len({c for _, _, c in want}) == 160
    docs = frame(spark, rows, "doc_id long, text string")
    for options in ({}, {"chunk": 16, "family": 2000}):
        sizes.clear()
        got = near_duplicates(docs, **options).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
        tree = {name: n for name, n in sizes.items() if name.startswith("tree")}
        assert len(tree) == 3 and sizes["open"] and max(tree.values()) <= sizes["open"], sizes


def test_families_and_their_links():
    """Families are what the pairs connect; verified pairs join each two components once, or all are told."""
    r = np.random.default_rng(3)
    i, j = r.integers(0, 200, (2, 120))
    low = groups(list(zip(i.tolist(), j.tolist(), strict=True)), range(200))
    assert signature_join.families(200, iter([(i[:50], j[:50]), (i[50:], j[50:])])).tolist() == [low[x] for x in range(200)]
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 10, 40, 45, 300)]
    every = np.triu_indices(len(sets), 1)
    linked = lambda every_, comp: [*signature_join.verified(sets, comp, iter([every]), 85, every_)]
    assert set(linked(True, np.arange(6))) == {(0, 1), (1, 2), (3, 4)}
    assert set(linked(False, np.array([7, 8, 7, 9, 10, 11]))) == {(0, 1), (3, 4)}


def test_traversal_loses_no_pair():
    r = np.random.default_rng(5)
    centre = r.random((6, 512)) < 0.1
    bits = np.concatenate([c ^ (r.random((30, 512)) < 0.01) for c in centre])
    n = bits.sum(axis=1).astype(np.int64)
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    tree = Tree(n, packed, np.arange(len(n)))
    found = {tuple(sorted(p)) for i, j in dual(tree, tree, 85) for p in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(n)):
        for b in range(a):
            both = (bits[a] & bits[b]).sum()
            if 100 * both >= 85 * (n[a] + n[b] - both):
                assert (b, a) in found
    assert len(found) < len(n) * (len(n) - 1) / 2 / 3


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_are_made_and_dealt_once(spark, rng, monkeypatch):
    """Groups and their rows come from one shuffle of the prefixes, whatever the joins turn into."""
    plans, plain = {}, signature_join.written

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(signature_join, "written", spied)
    base = [prose(rng, 40) for _ in range(3)]
    docs = frame(spark, [(i, changed(rng, base[i % 3], i % 4)) for i in range(12)], "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the reuse shows in the plan before it runs
    try:
        join = signature_join.Join(docs.select("doc_id", "text"))
        join.links()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plans["shared"].count("MapInArrow") == 1 and "ReusedExchange" in plans["shared"]


def test_bitmaps_are_small_and_exclude_unlike_sets():
    """Open groups ship a bitmap with every row: at most half a byte a shingle, and still a bound that tells."""
    r = np.random.default_rng(11)
    for n in (64, 100, 300, 1000, 2048, 5000):
        sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2)]
        alike = np.unique(np.concatenate((sets[0][n // 20 :], sets[1][: n // 20])))
        maps = [signature_join.bitmap(s) for s in (*sets, alike)]
        assert max(len(m) for m in maps) <= n // 2
        size = np.array([len(s) for s in (*sets, alike)])
        found = {tuple(sorted(p)) for i, j in signature_join.tree_pairs(np.arange(3), size, maps, np.arange(3), np.zeros(3, int), 85) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert found == {(0, 2)}

import random

import numpy as np

from staylink.llm import line_dedup, words
from staylink.llm.line_dedup import Lines, dedup_lines, signatures, within

from .conftest import frame, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(rng, text, n, letters="abcé"):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice(letters))
        elif kind == 1 and len(out) > 8:
            del out[i]
        else:
            out[i] = rng.choice(letters)
    return "".join(out)


def test_banded_distance_and_segments():
    rng = random.Random(3)
    points = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    for _ in range(1500):
        tau = rng.randrange(1, 4)
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(9, 24)))
        b = edited(rng, a, rng.randrange(tau + 3))
        close = distance(a, b) <= tau
        assert within([points(a)], [points(b)], tau)[0] == close
        if close:  # the pair meets under some key
            lines, keys = Lines([a, b]), {False: (set(), set()), True: (set(), set())}
            for rows, key, probe in signatures(lines, np.arange(2), tau):
                for r, k in zip(rows.tolist(), key.tolist(), strict=True):
                    keys[probe][r].add(k)
            (fa, fb), (pa, pb) = keys[False], keys[True]
            assert fa & (fb | pb) or fb & pa


def brute(rows, tau, least):
    lines = sorted((i, n, x) for i, t in {(i, t) for i, t in rows if i is not None and t is not None} for n, x in enumerate(t.split("\n")) if len(x) >= least)
    gone = {(i, n) for k, (i, n, x) in enumerate(lines) if any((p, q) != (i, n) and distance(x, y) <= tau for p, q, y in lines[:k])}
    out = []
    for i, t in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        out.append((i, kept))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, rng):
    base = [prose(rng, 5) for _ in range(6)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(4)) if rng.random() < 0.6 else prose(rng, 6) for _ in range(rng.randrange(1, 5)))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (None, base[0]), (43, "short\nshort"), (44, base[0] + "\n" + base[0]), (45, "z" * 5000 + "\n" + "z" * 4999)]
    docs = frame(spark, rows, "doc_id long, text string", clash=("h", "sig", "first", "gone"))
    for chunk in (512, 3):
        got = dedup_lines(docs, tau=2, min_chars=12, chunk=chunk).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute(rows, 2, 12)


def test_equal_short_lines(spark):
    """Lines below the floor of the edit join go if an equal line stands earlier; near ones and empty ones stay."""
    rows = [(1, "All rights reserved.\nown text"), (2, "All rights reserved.\n\n\n*"), (3, "All rights reserved!\n*\nother text\n"), (4, "x" * 30 + "\nAll rights reserved."), (5, "x" * 29 + "y\n*")]
    docs = frame(spark, rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs, short=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n\n*", 1), 3: ("All rights reserved!\nother text\n", 1), 4: ("x" * 30, 1), 5: ("", 2)}
    assert sum(r.n_removed for r in dedup_lines(docs).collect()) == 1


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_running_sums_are_made_once_a_slice(rng, monkeypatch):
    """Each power table costs a pass over the slice; the keys of all segments share them."""
    made = []
    plain = words._powers
    monkeypatch.setattr(words, "_powers", lambda base, n: made.append(n) or plain(base, n))
    lines = Lines([prose(rng, 40) for _ in range(5)])
    assert sum(len(rows) for rows, _, _ in signatures(lines, np.arange(5), 2)) > 15
    assert len(made) == 2


def test_pairs_of_many_groups_are_compared_together(rng, monkeypatch):
    calls, pairs, want = [], line_dedup.Pairs(2), set()
    monkeypatch.setattr(line_dedup, "within", lambda a, b, tau: calls.append(len(a)) or within(a, b, tau))
    for g in range(300):
        base = prose(rng, 6 if g else 300)
        texts = [base, edited(rng, base, rng.randrange(5)), *([prose(rng, 6)] if g % 3 == 0 else [])]
        filed = [rng.random() < 0.7 for _ in texts]
        pairs.add([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts], filed, [10 * g + i for i in range(len(texts))])
        want |= {10 * g + j for j in range(len(texts)) for i in range(j) if (filed[i] or filed[j]) and distance(texts[i], texts[j]) <= 2}
    assert set(pairs.found().tolist()) == want and want
    assert len(calls) < 30 and sum(calls) > 100
    assert not len(pairs.found())


def test_a_large_group_costs_few_rounds(rng, monkeypatch):
    """Lines that no earlier one repeats are compared many at a time, not one after another."""
    calls = []
    monkeypatch.setattr(line_dedup, "within", lambda a, b, tau: calls.append(len(a)) or within(a, b, tau))
    base = [prose(rng, 7)[:30] for _ in range(70)]
    texts = [edited(rng, rng.choice(base), rng.randrange(5)) if rng.random() < 0.5 else rng.choice(base) + str(i) for i in range(150)]
    lines = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    rank, filed = np.array(rng.sample(range(150), 150)), np.array([rng.random() < 0.6 for _ in texts])
    near = [(i, j) for i in range(150) for j in range(150) if rank[i] < rank[j] and (filed[i] or filed[j]) and distance(texts[i], texts[j]) <= 2]
    every, odd = np.arange(150), np.arange(150) % 2 == 1
    assert line_dedup.repeated_later(lines, rank, filed, every, every, 2).tolist() == sorted({j for _, j in near})
    assert len(calls) < 20
    left, right = np.flatnonzero(~odd), np.flatnonzero(odd)
    assert line_dedup.repeated_later(lines, rank, filed, left, right, 2).tolist() == sorted({j for i, j in near if odd[i] != odd[j]})

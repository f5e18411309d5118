import hashlib
import re

from staylink.llm import decontam

from .conftest import frame, prose


def tokens(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items, k):
    windows = {}
    for i, text in items:
        w = tokens(text)
        for s in range(max(1, len(w) - k + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = []
    for i, text in rows:
        w, hit, found = tokens(text), set(), set()
        for g, own in windows.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def data(spark, rng):
    items = [(i, prose(rng, 25)) for i in range(6)] + [(10, "Tiny item, É!"), (11, None), (12, ""), (2, prose(rng, 12))]
    rows = [(i, prose(rng, 30)) for i in range(15)]
    rows += [(20 + i, prose(rng, 5) + " " + items[i][1].upper().replace(" ", ", ") + " " + prose(rng, 5)) for i in range(6)]
    rows += [(40, "x tiny ITEM É y"), (41, None), (42, ""), (None, items[0][1]), (43, items[1][1]), (43, items[1][1]), (44, items[0][1][:60]), (45, (items[0][1] + " ") * 30)]
    return items, rows, frame(spark, rows, "doc_id long, text string", clash=("row", "w", "n", "_row", "item_id")), frame(spark, items, "item_id long, text string", clash=("words", "doc_id"))


def test_equals_brute_force_on_both_paths(spark, rng, monkeypatch):
    items, rows, docs, benchmark = data(spark, rng)
    for limit in (decontam.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontam.found, "__defaults__", (10, "item_id", limit))
        got = decontam.report(docs, benchmark).drop("spans").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, items, 10)


def test_documents_and_spans_go(spark, rng):
    items, rows, docs, benchmark = data(spark, rng)
    bad = {r[0] for r in brute(rows, items, 10) if r[5]}
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr)
    clean = decontam.remove_spans(docs, benchmark)
    assert clean.count() == len(rows)
    assert {r.doc_id: r.text for r in clean.collect()}[40] == "x y"


def test_empty_tables(spark, rng):
    _, rows, docs, benchmark = data(spark, rng)
    assert decontam.report(docs.limit(0), benchmark).count() == 0
    assert not decontam.report(docs, benchmark.limit(0)).filter("contaminated").count()


def test_native_plan(spark, rng):
    _, _, docs, benchmark = data(spark, rng)
    plan = decontam.report(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan

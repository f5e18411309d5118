import math
import re

from staylink.llm.license_scan import EVERY, PERCENT, PHRASES, TEMPLATES, Index, op12_license_scan, scan

from .conftest import frame, prose


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stands(words, phrase):
    return [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]


def plainly(rows, templates=TEMPLATES, phrases=PHRASES, percent=PERCENT):
    """Every template at every relative position of every text."""
    texts = [words_of(t) for _, t in rows]
    held = [set(w) for w in texts]
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        places = sorted((i, label) for p, label in phrases for i in stands(w, p.split()))
        found = []
        for t, (label, text, keys) in enumerate(templates):
            s = text.split()
            weight = [1 + round(1000 * math.log((len(rows) + 1) / (sum(x in h for h in held) + 1))) for x in s]
            wide, best = max(1, len(s) // EVERY), None
            for d in range(-len(s), len(w)):
                def met(i, at):
                    return 0 <= at < len(w) and w[at] == s[i]

                if not any(met(i, d + i) for i in range(len(s))):
                    continue
                got = sum(x for i, x in enumerate(weight) if any(met(i, d + i + e) for e in range(wide + 1)))
                inside = w[max(d, 0) : max(0, d + len(s) + wide)]
                if 100 * got >= percent * sum(weight) and all(stands(inside, k.split()) for k in keys) and (best is None or got / sum(weight) > best[1]):
                    best = (d, got / sum(weight))
            if best:
                found.append((label, t, *best))
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        out.append((doc_id, len(w), len(places), first, last, sorted({x for _, x in places}), found))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, [tuple(m) for m in r.matches]) for r in scan(df, **options).collect()), key=repr)


def damaged(rng, words):
    """A few words left out, put in or changed."""
    out = []
    for w in words:
        x = rng.random()
        if x < 0.08:
            continue
        out += [w, "inserted"] if x > 0.95 else ["changed"] if x > 0.88 else [w]
    return out


def cases(rng):
    rows = []
    for i in range(90):
        _, text, _ = TEMPLATES[i % len(TEMPLATES)]
        words = text.split() if i < len(TEMPLATES) else damaged(rng, text.split())
        spelled = " ".join(w.upper() if rng.random() < 0.2 else w for w in words).replace("2 0", "2.0").replace(" nc", "-NC")
        rows.append((i, f"{prose(rng, rng.randrange(30))} {spelled} {prose(rng, rng.randrange(10))}"))
    rows += [(200 + i, prose(rng, 50)) for i in range(40)]
    rows += [(300, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0. Licensed under the MIT License"), (301, "under under the the mit mit license license")]
    rows += [(302, "cc by nc cc by nc"), (303, "MIT license"), (None, "cc by nc"), (None, None), (304, None), (305, ""), (306, " . "), (307, "apache license version"), (308, "2 0 cc by"), (300, "same id, other text"), (302, "cc by nc cc by nc")]
    # a notice that only two neighbouring texts would make together
    rows += [(310, "released under the"), (311, "mit license"), (312, "license version 3"), (313, "日本 licensed under the GNU Général public license")]
    return rows


def test_equals_every_place(spark, rng):
    rows = cases(rng)
    df = frame(spark, rows, "doc_id long, text string", clash=("n_words", "word", "labels"))
    want = plainly(rows)
    assert got(df) == want
    assert {m[0] for r in want for m in r[-1]} == {t[0] for t in TEMPLATES}
    assert any(0 < m[3] < 1 for r in want for m in r[-1])  # damaged notices are found too


def test_own_templates(spark, rng):
    templates = (("one", "a b a b a c", ("a c",)), ("two", "x", ()), ("three", "b b", ("b b",)))
    phrases = (("a b", "ab"), ("c", "c"))
    rows = [(i, " ".join(rng.choice("abcxy") for _ in range(rng.randrange(25)))) for i in range(150)]
    df = frame(spark, rows, "doc_id long, text string")
    for percent in (60, 100):
        assert got(df, templates=templates, phrases=phrases, percent=percent) == plainly(rows, templates, phrases, percent)


def test_anchors_are_the_rarest_words_that_a_match_cannot_miss():
    index = Index((("x", "the license of unobtainium", ()),), (), 75, {"the": 1, "license": 30, "of": 2, "unobtainium": 90})
    (_, _, whole, anchors, _), = index.plans
    assert whole == 123 and anchors == [3]


def test_very_long_text(spark, rng):
    tail = "released under the MIT license"
    rows = [(1, "license " * 300_000 + tail), (2, "x" * 3_000_000), (3, tail)]
    found = {r.doc_id: r for r in scan(frame(spark, rows, "doc_id long, text string")).collect()}
    assert found[1].n_words == 300_005 and (found[1].n_base, found[1].first_word) == (1, 300_001) and [m.label for m in found[1].matches] == ["mit"]
    assert found[2].n_words == 1 and found[2].matches == [] and found[3].matches[0].share == 1.0


def test_empty_table(spark, tmp_path):
    df = frame(spark, [], "doc_id long, text string")
    assert scan(df).collect() == []
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_license_scan(spark, str(tmp_path)).collect() == []

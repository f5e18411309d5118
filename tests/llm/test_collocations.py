import re
from collections import Counter, defaultdict

import pytest

from staylink.llm.collocations import collocations, op13_collocations

from .conftest import frame


def plainly(rows, least, top, percent):
    """The rule over all phrases, one at a time."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, b in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= percent * found[p[i : i + m]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(rng, texts=300):
    """Words of very different frequency, set phrases, ties and repeated rows in several languages."""
    word = [f"w{i}" for i in range(40)] + ["é", "日本", "A", "a"]
    weight = [1 / (i + 1) for i in range(len(word))]
    fixed = ["new york city hall", "once upon a", "new york", "ad hoc", "rock and roll band"]
    rows = []
    for i in range(texts):
        parts = rng.choices(word + fixed, weights=weight + [0.4] * len(fixed), k=rng.randrange(60))
        rows.append((rng.choice(["en", "en", "de", None, "und", "", "fr"]), "".join(p + rng.choice("     ,.;\t\n\r") + " " * rng.randrange(2) for p in parts)))
    return rows + [rows[3]] * 20 + [("en", None), (None, None), ("xx", ""), ("xx", " . , "), ("yy", "only once")]


@pytest.mark.parametrize(("least", "top", "percent"), [(5, 8, 80), (3, 3, 50), (2, 10_000, 80)])
def test_equals_brute_force(spark, rng, least, top, percent):
    rows = corpus(rng)
    df = frame(spark, rows, "lang string, text string", clash=("w1", "a", "n", "score"))
    got = sorted(map(tuple, collocations(df, least, top, percent).collect()))
    assert got == plainly(rows, least, top, percent)


def test_several_rounds_settle_the_same(spark, rng):
    """Set phrases drop nearly all of the pairs that score best, so the first threshold is too high."""
    rows = corpus(rng, 60) + [("en", " ".join(f"p{i}q{k}" for k in range(30))) for i in range(25) for _ in range(6)]
    df = frame(spark, rows, "lang string, text string")
    assert sorted(map(tuple, collocations(df, 5, 40, 80).collect())) == plainly(rows, 5, 40, 80)


def test_word_ids_that_collide_are_dealt_anew(spark, rng):
    rows = corpus(rng, 60)
    df = frame(spark, rows, "lang string, text string")
    assert sorted(map(tuple, collocations(df, 3, 20, 80, dropped_bits=58).collect())) == plainly(rows, 3, 20, 80)


def test_very_long_text(spark, rng):
    rows = [("en", "ping pong table, " * 200_000 + "x" * 2_000_000), ("en", "ping pong")]
    df = frame(spark, rows, "lang string, text string")
    got = [tuple(r) for r in collocations(df).collect()]
    n = 3 * 200_000 + 1 + 2
    assert got == [("en", 1, "ping pong table", 200_000, 200_001, 200_000, n, 2000000 * 200_000 // 400_001)]


def test_empty_table(spark, tmp_path):
    df = frame(spark, [], "lang string, text string, doc_id long")
    assert collocations(df).collect() == []
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_collocations(spark, str(tmp_path)).collect() == []

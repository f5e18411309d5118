import hashlib
import re

from staylink.llm.phrase_dedup import repeated

from .conftest import frame, prose


def brute(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - k + 1):
            if i is not None and first[tuple(w[s : s + k])] < i:
                gone |= set(range(s, s + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, rng):
    passage, other = prose(rng, 60), prose(rng, 30)
    rows = [(i, prose(rng, rng.randrange(40))) for i in range(20)]
    rows += [(i, prose(rng, 9) + "  \n" + passage + "\t" + prose(rng, 5)) for i in range(20, 40)]
    rows += [(i, other.upper() + " é漢 " + passage[: rng.randrange(100, 300)]) for i in range(40, 60)]
    rows += [(5, other), (5, other), (None, passage), (None, None), (61, None), (62, ""), (63, " \n "), (64, passage * 40), (65, "x " * 3000), (66, "x " * 500)]
    docs = frame(spark, rows, "doc_id long, text string", clash=("block", "key", "first", "low"))
    got = repeated(docs, block_bytes=2000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got), key=repr) == brute(rows, 13)


def test_empty_table(spark):
    assert repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0

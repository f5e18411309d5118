import hashlib
import re

from staylink.llm.fill_middle import Rates, op11_fill_middle, restore, transform

from .conftest import frame


def plainly(doc_id, text):
    """The rule, character by character."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cases(rng):
    letters = "abcXYZ   <>PSM\n\té日😀\x00."
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(None, "no id at all"), (None, None), (3, None), (4, ""), (5, "<P>"), (6, "a <S> b"), (7, "x<M>"), (8, "<P"), (9, "S>"), (10, "<" * 50)]
    # a sentinel that only two neighbouring texts would make together, and repeated rows
    rows += [(700, "ends with <"), (701, "P> begins"), (702, "ends <P"), (703, ">"), (704, "same"), (704, "same"), (704, "other text")]
    rows += [(-5, "negative id"), (800, "long " * 300_000), (801, "日" * 200_000)]
    return rows


def test_equals_plain_rule_and_restores(spark, rng):
    rows = cases(rng)
    df = frame(spark, rows, "doc_id long, text string", clash=("form", "n", "output"))
    out = transform(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    key = repr
    got = sorted(map(tuple, out.collect()), key=key)
    assert got == sorted((plainly(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = sorted(map(tuple, restore(transform(df)).collect()), key=key)
    assert back == sorted(((i, t or "") for i, t in rows), key=key)


def test_digests_are_of_the_real_output(spark, rng):
    rows = [r for r in cases(rng) if r[0] is None or r[0] < 900]
    df = frame(spark, rows, "doc_id long, text string")

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    got = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in transform(df, digests=True).collect()), key=repr)
    assert got == sorted(((i, sha(plainly(i, t)[5]), sha(t or "")) for i, t in rows), key=repr)


def test_rates(spark):
    df = frame(spark, [(i, "some words in a row") for i in range(300)], "doc_id long, text string")
    assert {r.form for r in transform(df, Rates(plain=0, spm=100)).collect()} == {"spm"}
    assert {r.form for r in transform(df, Rates(plain=100)).collect()} == {"plain"}


def test_empty_table(spark, tmp_path):
    df = frame(spark, [], "doc_id long, text string")
    assert transform(df).collect() == [] and restore(transform(df)).collect() == []
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_fill_middle(spark, str(tmp_path)).collect() == []

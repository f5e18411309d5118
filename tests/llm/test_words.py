import numpy as np
import pyarrow as pa
import pytest

from staylink.llm import words as w
from staylink.llm.line_dedup import dedup_lines
from staylink.llm.phrase_dedup import repeated
from staylink.llm.signature_join import near_duplicates

from .conftest import frame, prose


def thue_morse(n):
    """The string that every polynomial hash modulo 2**64 takes for its complement."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_spans_hash_depends_on_content_alone(rng):
    spans = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 7, 8, 9, 100, 70_000, 300_000, 0, 5]]
    raw = np.frombuffer(b"x".join(spans), np.uint8)
    ends = np.cumsum([len(s) + 1 for s in spans]) - 1
    starts = ends - np.array([len(s) for s in spans])
    together = w.spans_hash(raw, starts, ends)
    alone = [w.spans_hash(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0] for s in spans]
    assert together.tolist() == alone
    assert together[0] == together[9] and len(set(alone)) == len(alone) - 1
    other = w.spans_hash(raw, starts, ends, salt=w._ODD2)
    assert (other[1:9] != together[1:9]).all()


@pytest.mark.parametrize("size", [1024, 4096, 1 << 18])
def test_thue_morse_words_differ(size):
    words = w.Words(pa.array(list(thue_morse(size))))
    for salt in (w._ODD, w._ODD2):
        assert len(set(words.hashes(salt).tolist())) == 2


def test_strangers_are_found_by_their_bytes():
    words = w.Words(pa.array(["aa bb aa", "cc bbb aa", "x" * 400_000 + " " + "x" * 399_999 + "y"]))
    #                          0  1  2     3  4   5   6        7
    which, first = np.array([0, 1, 0, 1, 1, 0, 2, 2]), np.array([0, 1, 6])
    assert np.flatnonzero(words.strangers(first, which)).tolist() == [3, 4, 7]


def test_nothing_large_stays_in_the_worker():
    w.Words(pa.array(["abc " * 1_000_000])).hashes()
    kept = [v for v in vars(w).values() if isinstance(v, np.ndarray)]
    assert sum(v.nbytes for v in kept) < 1 << 20 and w._kept_weights.cache_info().maxsize * w._KEPT * 8 <= 4 << 20


def test_different_texts_stay_apart(spark, rng):
    t, c = thue_morse(1024)
    assert {r.n_removed for r in dedup_lines(frame(spark, [(1, t), (2, c)], "doc_id long, text string")).collect()} == {0}
    tail = prose(rng, 12)
    rows = frame(spark, [(1, f"{t} {tail}"), (2, f"{c} {tail}")], "doc_id long, text string")
    assert {r.n_removed for r in repeated(rows).collect()} == {0}
    linked = near_duplicates(frame(spark, [(1, t), (2, c)], "doc_id long, text string"), k=5, percent=80)
    assert sorted((r.doc_id, r.component_id) for r in linked.collect()) == [(1, 1), (2, 2)]


def test_ids_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from staylink.llm.packing import WordIds
    from staylink.llm.token_count import WholeTokens

    texts = [x for n in (64, 1024, 4096) for x in thue_morse(n)]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(WordIds(path).encode_all(texts)) == want
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert WholeTokens(path).counts([f"a {t}" for t in texts]) == [len(library.encode(f"a {t}", add_special_tokens=False).ids) for t in texts]


def test_two_texts_of_one_id_are_two_documents(spark, rng):
    """Ordinary in merged crawls: an id with two contents loses no line, link or row."""
    from staylink.llm.lattice_dedup import links

    import corpus_pipeline as p

    line, own = "a line of more than twenty-four characters", "found nowhere else in the whole of this corpus"
    df = frame(spark, [(1, f"{line}\nx"), (2, f"{line}\ny"), (2, f"{own}\nz"), (2, f"{own}\nz")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_removed) for r in dedup_lines(df).collect())
    assert got == [(1, f"{line}\nx", 0), (2, f"{own}\nz", 0), (2, f"{own}\nz", 0), (2, "y", 1)]

    vectors = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.01, 1.0], "a"), (3, [1.0, 0.01], "a"), (4, [-1.0, 0.0], "a"), (4, [-1.0, 0.0], "a")]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in links(frame(spark, vectors, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]

    t, u = prose(rng, 60), prose(rng, 60)
    rows = [(1, t), (2, t), (2, u), (3, u), (4, None), (4, "")]
    df = frame(spark, rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=repr)
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4)]

    docs = df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    kept = p.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, t), (2, u), (4, None), (4, "")], key=repr)


def test_distinct_words_are_told_apart_by_their_bytes():
    texts = ["aa bb aa\tbé", None, "", " cc bbb aa ", "x" * 70_000 + " " + "x" * 69_999 + "y", "\x00 \x00\x00"]
    words = w.Words(pa.array(texts))
    which, values = words.distinct()
    want = [x.encode() for t in texts if t for x in t.replace("\t", " ").split(" ") if x]
    assert [values[k] for k in which.tolist()] == want and len(values) == len(set(want))
    assert w.Words(pa.array(["", None])).distinct()[1] == []


def test_packing_takes_equal_runs_by_bytes_and_hashes_no_words(monkeypatch):
    import public_tokenizers

    from staylink.llm.packing import WordIds

    def refuse(*_, **__):
        raise AssertionError("a hash of every word")

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two one", "", "two  three\none", "Ünïcode two"]
    want = [WordIds(path).encode(t) for t in texts]
    monkeypatch.setattr(w.Words, "hashes", refuse)
    assert list(WordIds(path).encode_all(texts)) == want

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from staylink.llm import packing, token_count

from .conftest import frame, prose

ODD = ["", None, " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "  x  \n\n y", "é́ ١٢ ½ 漢字 \U0001f600", "don't I'LL 'S", "x" * 30_000, "\x00\x1c\x85\xa0\u180e a", "a\n  x", "a \n b", " a", "a ", "ΑΣ ΟΔΟΣ", "<|startoftext|>A<|endoftext|>", "_x_ ǅ ʰ ⅷ ²", "word " * 9000]


def documents(spark, rng):
    rows = [(i, prose(rng, rng.randrange(900))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (1, "again"), (1, "again")]
    return rows, frame(spark, rows, "doc_id long, text string", clash=("id", "n_tokens", "key", "length"))


def test_counts_equal_the_library(spark, rng):
    rows, docs = documents(spark, rng)
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows), key=repr)
    got = token_count.count_tokens(docs, path).collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


def test_whole_tokens_are_proven():
    model = token_count.counter_for(P.path("byte_bpe_50k.json"))
    assert len(model.whole) > 40_000
    sample = sorted(model.whole)[::997]
    assert all(len(model.tokenizer.encode(t, add_special_tokens=False).ids) == 1 for t in sample)
    seen = model.pretoken_report(["the quick brown fox qzxqzx"])
    assert seen["whole"] and seen["merged"]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_count.WholeTokens(P.path("word_bpe_49k.json"))


def test_pieces_and_places(spark, rng):
    rows, docs = documents(spark, rng)
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256].tobytes()
            want.append((i, k, at, len(part) // 4, zlib.crc32(part)))
    got = packing.pack(docs, path, capacity=256, per_shard=16).toPandas()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows_of = [(None if i != i else int(i), *map(int, r)) for i, *r in got[keys].values.tolist()]
    assert sorted(rows_of, key=repr) == sorted(want, key=repr)
    ordered = got.sort_values(["sequence_id", "offset"])
    by = ordered.groupby("sequence_id").length
    assert (by.cumsum() - ordered.length == ordered.offset).all() and by.sum().max() <= 256
    assert got.sequence_id.nunique() <= 1.1 * packing.lower_bound(got.length.tolist(), 256)
    assert packing.pack(docs.limit(0), path).count() == 0
    with_ids = packing.pack(docs, path, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in with_ids)


def test_genetic_algorithm_improves_on_best_fit(rng):
    lengths = [rng.choice((7, 11, 13, 17, 19, 23, 29, 31)) for _ in range(300)]
    start = packing.Bins(lengths, 60)
    start.best_fit(sorted(range(300), key=lengths.__getitem__, reverse=True))
    bins = packing.evolve(lengths, 60, 1, [], 200, 8)
    used = [0] * (max(bins) + 1)
    for n, b in zip(lengths, bins, strict=True):
        used[b] += n
    assert max(used) <= 60 and packing.lower_bound(lengths, 60) <= len(used) <= len(start.items)
    again = packing.evolve(lengths, 60, 2, [bins], 10, 4)
    assert max(again) <= max(bins)


def test_crossover_keeps_every_piece(rng):
    lengths = [rng.randrange(1, 60) for _ in range(120)]
    parents = []
    for _ in range(2):
        one = packing.Bins(lengths, 60)
        one.best_fit(rng.sample(range(120), 120))
        parents.append(one)
    child = packing.crossover(*parents, rng)
    assert sorted(i for items in child.items for i in items) == list(range(120)) and min(child.room) >= 0


def test_run_cache_is_small_and_exact(rng, monkeypatch):
    path = P.path("word_bpe_49k.json")
    texts = [" ".join(f"w{rng.randrange(10**7)}é," for _ in range(900)) for _ in range(5)] + ["y" * 200 + " x", "", "x y"]
    plain = packing.WordIds(path)
    want = [plain.encode(t) for t in texts]
    model = packing.WordIds(path)
    assert list(model.encode_all(texts)) == want and list(model.encode_all(texts[::-1])) == want[::-1]
    runs = model.runs
    assert len(runs) > 4000 and sum(x.nbytes for x in (runs.hash, runs.place, runs.raw, runs.ids)) < 100 * len(runs)
    monkeypatch.setattr(packing, "CACHE", 7)  # forgets all the time
    model = packing.WordIds(path)
    assert [x for t in texts for x in model.encode_all([t])] == want and len(model.runs) <= 7
    monkeypatch.setattr(packing, "hash", lambda run: len(run) % 3, raising=False)  # runs that share a hash
    model = packing.WordIds(path)
    assert [x for t in texts for x in model.encode_all([t])] == want == list(model.encode_all(texts))

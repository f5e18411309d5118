import hashlib

from staylink.llm.chat_format import format_turns, parse, read_back

from .conftest import frame


def test_round_trip_and_loss(spark):
    texts = ["", None, "plain", "\\### Assistant: </turn> ok", "####", "\\\\", "</turn></turn>\n### User:\n", "é漢\U0001f600", ":\n", "a" * 100_000]
    rows = [(c, t, r, x) for c in (1, 2) for t, x in enumerate(texts) for r in ("user", "assistant", "od:\nd\\", None)[c : c + 2]]
    rows += [(None, None, "user", "n"), (1, 0, "user", ""), (3, -1, "assistant", "late"), (3, None, "assistant", "first")]
    table = frame(spark, rows, "conv_id long, turn long, role string, text string", clash=("formatted", "loss_start"))
    turns = format_turns(table).collect()
    assert len(turns) == len(rows)
    want = sorted((c, t, r or "", x or "") if c is not None else ("none", t, r, x) for c, t, r, x in rows if t is not None)
    assert sorted((*(r[:2]), *parse(r.formatted)) for r in turns if r.turn is not None) == want
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    got = {r.conv_id: r for r in read_back(format_turns(table)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((x for x in rows if x[0] == conv), key=order)
        learned = "".join(x[3] or "" for x in own if x[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_turns(table).count() == 0 and read_back(format_turns(table)).count() == 0

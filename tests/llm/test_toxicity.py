import numpy as np
import pyarrow as pa

from staylink.llm import toxicity as t

from .conftest import frame, prose

SF = "/root/testdata/sf0.1"


def test_grammar_scores_clauses():
    model = t.Model({"zork": 1.0}, {"blarg": 0.9})
    x = model.features(pa.array(["you zork", "not a zork", "he said zork", "zork", "Blarging. you", "calm words", None, "", "you kill"]))
    index = {p: i for i, p in enumerate(t.PATTERNS)}
    plain, aimed = index[("insult", frozenset())], index[("insult", frozenset({"aimed"}))]
    denied, reported = index[("insult", frozenset({"denied"}))], index[("insult", frozenset({"aimed", "reported"}))]
    assert x[0, aimed] and x[1, denied] and x[2, reported] and x[3, plain] and x[4, plain]
    assert not x[5:8].any() and x[8, index[("threat", frozenset({"aimed"}))]]
    s = model.scores(x)
    assert s[0] > s[1] > s[5] and s[3] > s[1]


def test_composition_runs_both():
    both = t.compose(t.negation(), t.target())
    state = 0
    for symbol in (t.NEGATION, t.TARGET):
        state = both.step[state, symbol]
    assert both.marks[state] == {"denied", "aimed"}


def test_learns_from_labels_and_nulls(spark, rng):
    rows = [(i, prose(rng, 30) + (" grumpf snarfel" if i % 4 == 0 else "")) for i in range(200)] + [(None, "grumpf"), (500, None), (501, "")]
    labels = [(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None), (900, 1), (0, 1)]
    docs = frame(spark, rows, "doc_id long, text string", clash=("toxic", "score", "features"))
    model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grumpf" in model.words
    got = t.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == int(r.doc_id is None or r.doc_id % 4 == 0) for r in got if r.doc_id is None or r.doc_id < 200)
    assert t.score_toxicity(docs.limit(0), model).count() == 0
    assert t.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).words == {}


def test_held_out_accuracy(spark):
    scored = t.op4_toxicity(spark, SF).filter("held_out").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").toPandas()
    both = scored.merge(labels, on="doc_id")
    assert np.mean(both.predicted == both.toxic) > 0.97
    assert both[both.toxic == 1].predicted.mean() > 0.85 and both[both.toxic == 0].predicted.mean() < 0.02

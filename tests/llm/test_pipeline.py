import corpus_pipeline as pipeline
from staylink.llm.shared import components, written

from .conftest import groups, prose

SF = "/root/testdata/sf0.001"
COLUMNS = list(pipeline.COLUMNS)


def test_components(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = groups(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in low.items() if n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_decide(spark, rng):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    unique = [prose(rng, 80) for _ in range(20)]
    near = unique[0].split()
    near[40] = "changed"
    texts = [*unique, unique[1], " ".join(near), unique[2] + "\n" + prose(rng, 40), prose(rng, 20) + " " + bench, None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]
    assert stages["toxicity"](spark, docs, SF).columns == COLUMNS
    lines = {r.doc_id: r for r in stages["line dedup"](spark, docs, SF).collect()}
    assert set(range(26)) - set(lines) == {20} and lines[22].text == texts[22].split("\n")[1] and lines[22].n_chars == len(lines[22].text)
    kept = stages["n-gram jaccard join"](spark, docs, SF)
    assert kept.columns == COLUMNS and set(range(26)) - {r.doc_id for r in kept.collect()} == {20, 21}
    clean = stages["benchmark decontamination"](spark, docs, SF)
    assert clean.columns == COLUMNS and set(range(26)) - {r.doc_id for r in clean.collect()} == {23}
    for name in ("line dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"):
        assert stages[name](spark, docs.limit(0), SF).count() == 0


def test_line_stage_takes_short_copies(spark):
    rows = [(1, "Share this\nfirst own line", "en", "s", 25), (2, "Share this\nsecond own line", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {1: ("Share this\nfirst own line", 25), 2: ("second own line", 15)}


def test_run_covers_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
    got = pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert pipeline.ORACLE_SQL is None


def test_stages_hand_small_batches_to_python(spark):
    """Whole texts go to the workers some megabytes at a time, however many rows a batch may have."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('abcdefgh', 512) text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        got = pipeline.small_batches(lambda _, d, __: d.mapInArrow(sizes, "n long"))(spark, docs, "")
        assert max(r.n for r in got.collect()) < 5 << 20
        assert all(hasattr(stage, "__wrapped__") for _, stage in pipeline.STAGES)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)

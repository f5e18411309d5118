"""The training-corpus pipeline: stages over `documents`, each written and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylink.llm import decontam, line_dedup, packing, signature_join, toxicity
from staylink.llm.shared import written

#: Columns that every stage but the last returns, in this order.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Most that Spark hands to a Python worker at once. Its 10,000 rows are 20 MB and more of whole texts,
#: held by the JVM and by the worker, of every task, at the same time.
BATCH = "4m"


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage in a session of small Arrow batches; the setting stays, since stages are lazy."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects (score of 0.5 or more) go; all others stay unchanged."""
    model = toxicity.learned(spark, docs, sf_dir)
    return toxicity.featured(docs.select(*COLUMNS), model, list(COLUMNS)).filter("score < 0.5").select(*COLUMNS)


@small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, equal ones at any length, and documents that consisted of such lines alone.

    n_chars is counted anew where the text changed. Other documents stay, empty ones too.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), short=True)
    kept = kept.filter(~((F.col("n_removed") > 0) & F.col("text").rlike(r"^\s*$")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents linked at a Jaccard similarity of 0.8 or more of their
    5-word shingles, the one of smallest id stays (of two texts of one id, the one of smaller hash).
    Rows of equal id and text are one document; rows without an id all stay, and so do texts
    without words. Columns beyond those of documents are dropped."""
    found = signature_join.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80, groups=True)
    leaders = found.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    leaders = leaders.select(F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"))
    wordless = found.filter("group_id is null and doc_id is not null").select("doc_id", "text_hash").distinct()
    keyed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    kept = keyed.join(leaders.unionByName(wordless), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.select(*COLUMNS).unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


@small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs.select(*COLUMNS), benchmark)


@small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs


#: Learned scores and a genetic algorithm are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None

"""What the operators share: written tables, projections that survive clashing names, components, runs of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    A local session without the setting gets a temporary folder; a cluster session
    without it is an error, since no machine-local folder would be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    kept = getattr(spark, "_llm_folder", None)
    if kept:
        return kept
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark._llm_folder = "file://" + tempfile.mkdtemp(prefix="llm-")
    return spark._llm_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table under the shared folder, read back: cuts lineage, so a lost
    executor costs the tasks it ran and not the stages before them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one run that are deleted together, once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/llm-{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()


def written_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table bucketed by key under the shared folder: groups by key need no further shuffle."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    buckets = min(buckets, 50_000)
    out = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd")
    out.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns under the names the operator uses: out_name=in_name.

    Other columns, whatever their names, never enter the operator's plan.
    """
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in wanted.items()])


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id that each node of the edges (a, b) reaches.

    Alternating large-star and small-star rounds; every round is written to the shared
    folder, so the plan stays small. The minimum over a node's neighbours is a partial
    aggregate, and the join back is an equi join that adaptive execution splits when one
    node has very many neighbours.
    """
    now = written(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").selectExpr("b a", "m b").filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.selectExpr("b a", "m b").unionByName(joined.selectExpr("a", "m b")).filter("a <> b").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.selectExpr("a node", "b component").unionByName(now.selectExpr("b node", "b component")).distinct()
        before = state


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows of equal key; the rows come sorted by it."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [np.asarray(batch.column(c)) for c in key]
        change = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1
        if kept and tuple(p[0] for p in parts) != last:
            yield pa.Table.from_batches(kept)
            kept = []
        bounds = [0, *change.tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            kept.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept = []
        last = tuple(p[-1] for p in parts)
    if kept:
        yield pa.Table.from_batches(kept)

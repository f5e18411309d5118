"""SRC-1 / SRC-2: delimited text in, every column as text, typed later in one place.

R's ``read.csv`` maps the text ``NA`` to missing; so does ``nullValue="NA"`` here.
Columns are read as strings with an explicit schema (no inference pass over the
data) and typed by the clean step, where a bad value becomes null instead of
failing the job. Lines with too few or too many fields are neither padded nor cut: they
go to a table of rejects with their file, text and reason (:func:`read_with_rejects`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_text_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    *,
    sep: str = ",",
    keep_corrupt: bool = False,
) -> DataFrame:
    """Read CSV files with a header into string columns named ``columns``."""
    fields = [T.StructField(c, T.StringType(), True) for c in columns]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    reader = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("sep", sep)
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
    )
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(list(path) if not isinstance(path, str) else path)


def read_with_rejects(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], *, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the well-formed lines in string columns, and ``file, line, n_fields, reason``
    for each line that does not have the columns' number of fields.

    Both are read from the files when they are used; nothing is held. Reasons: ``too few fields``,
    ``too many fields``, or ``malformed`` (a quote that never closes).
    """
    raw = read_text_csv(spark, path, columns, sep=sep, keep_corrupt=True)
    # always true, but it keeps every column in the read: a reader that is asked for some columns
    # only does not see that a line has too few or too many
    read = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in [*columns, CORRUPT]])) >= 0
    bad = F.col(CORRUPT).isNotNull()
    rows = raw.filter(read & ~bad).select(*[F.col(f"`{c}`") for c in columns])
    # the fields of a line: separators outside quotes, plus one
    bare = F.regexp_replace(F.col(CORRUPT), '"([^"]|"")*"', "")
    fields = (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1
    n = fields.cast("int")
    reason = F.when(F.contains(bare, F.lit('"')), "malformed").when(n < len(columns), "too few fields").when(n > len(columns), "too many fields")
    named = raw.select("*", F.col("_metadata.file_path").alias("_file")).filter(read & bad)
    rejects = named.select(
        F.col("_file").alias("file"), F.col(CORRUPT).alias("line"), n.alias("n_fields"), F.coalesce(reason, F.lit("malformed")).alias("reason")
    )
    return rows, rejects


def write_text_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write a DataFrame as CSV with a header (used to hand text data to SRC-1 in tests)."""
    df.write.mode(mode).option("header", True).csv(path)

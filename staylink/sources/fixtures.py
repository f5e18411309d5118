"""Views over the driver's TPC-H-like tables with the shape of linked hospital data.

FIXTURES.md section B defines them: a person is a customer, an episode an order,
the episode's end is its start plus the order's largest line quantity in days,
the diagnosis is the order priority, the separation mode the order status, deaths
come from customers with a low balance (some with a second, conflicting record),
and diagnosis rows are the part types of an order's lines.

Only the needed columns are selected, so the parquet scans read just those.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def fx_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, episode_id, start_date, end_date, age, diag_code, mode."""
    t = load_tables(spark, sf_dir, ["orders", "lineitem"])
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    los = t["lineitem"].groupBy("l_orderkey").agg(F.max("l_quantity").alias("los"))
    start = F.col("o_orderdate").cast("date")
    return o.join(los, o["o_orderkey"] == los["l_orderkey"], "left").select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderkey").alias("episode_id"),
        start.alias("start_date"),
        F.date_add(start, F.coalesce(F.col("los"), F.lit(0.0)).cast("int")).alias("end_date"),
        (F.lit(40) + F.col("o_custkey") % 40 + F.year("o_orderdate") - 1995).cast("int").alias("age"),
        F.col("o_orderpriority").alias("diag_code"),
        F.col("o_orderstatus").alias("mode"),
    )


def fx_episode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode view as a CSV reader returns it: every column text, dates day-month-year.

    Three layouts are mixed by episode id (``01/07/2005``, ``1/7/2005``, ``01JUL2005``) so
    the date parser is exercised on the whole table.
    """
    e = fx_episode(spark, sf_dir)

    def fmt(c: str):
        k = F.col("episode_id") % 3
        return (
            F.when(k == 0, F.date_format(c, "dd/MM/yyyy"))
            .when(k == 1, F.date_format(c, "d/M/yyyy"))
            .otherwise(F.upper(F.date_format(c, "ddMMMyyyy")))
        )

    return e.select(
        F.col("person_id").cast("string").alias("person_id"),
        F.col("episode_id").cast("string").alias("episode_id"),
        fmt("start_date").alias("start_date"),
        fmt("end_date").alias("end_date"),
        F.col("age").cast("string").alias("age"),
        "diag_code",
        "mode",
    )


def fx_episode_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode view with what real extracts hold, by key arithmetic: persons, start dates,
    ages, codes and modes missing, and whole rows repeated."""
    e = fx_episode(spark, sf_dir)
    k = F.col("episode_id")
    gaps = {"person_id": 97, "start_date": 101, "age": 11, "diag_code": 13, "mode": 7}
    e = e.withColumns({c: F.when(k % n != 0, F.col(c)) for c, n in gaps.items()})
    return e.unionByName(e.filter(k % 17 == 0))


def fx_episode_dirty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty view as text: missing values empty, and the two copies of a repeated row with
    their dates in different layouts."""
    e = fx_episode_dirty(spark, sf_dir)
    copies = fx_episode_dirty(spark, sf_dir).filter(F.col("episode_id") % 17 == 0).distinct()

    def text(df: DataFrame, layout: str) -> DataFrame:
        dates = {c: F.date_format(c, layout) for c in ("start_date", "end_date")}
        return df.select(*[dates.get(c, F.col(c)).cast("string").alias(c) for c in df.columns])

    return text(e.distinct(), "d/M/yyyy").unionByName(text(copies, "ddMMMyyyy"))


def write_broken_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The dirty text view as CSV, with malformed lines among the others: every 19th episode once more
    without its last field, every 23rd with a field too many."""
    t = fx_episode_dirty_text(spark, sf_dir)
    k = F.col("episode_id").cast("long")
    fields = [F.coalesce(F.col(c), F.lit("NA")) for c in t.columns]
    whole = t.select(F.concat_ws(",", *fields).alias("line"))
    short = t.filter(k % 19 == 0).select(F.concat_ws(",", *fields[:-1]).alias("line"))
    wide = t.filter(k % 23 == 0).select(F.concat_ws(",", *fields, F.lit("extra")).alias("line"))
    lines = whole.unionByName(short).unionByName(wide).withColumnRenamed("line", ",".join(t.columns))
    # one text column whose name is the header; a separator that no line holds
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)


def fx_episode_hot(episodes: DataFrame) -> DataFrame:
    """Flagged episodes with a third of them moved to person 0, and a seventh to person -1 on
    one single day."""
    k, day = F.col("episode_id"), F.lit(dt.date(1998, 5, 5))
    one_day = k % 7 == 1
    moved = {c: F.when(one_day, day).otherwise(F.col(c)) for c in ("start_date", "end_date")}
    person = F.when(one_day, F.lit(-1)).when(k % 3 == 0, F.lit(0)).otherwise(F.col("person_id"))
    return episodes.withColumns(moved | {"person_id": person})


def fx_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and the order date as text: eight day-month-year layouts, and ISO."""
    o = load_tables(spark, sf_dir, ["orders"])["orders"].select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    layouts = ["dd/MM/yyyy", "d-M-yyyy", "ddMMMyyyy", "d MMMM yyyy", "dd-MMM-yy", "d.M.yy", "ddMMyyyy", "ddMMyy"]
    k = F.col("o_orderkey") % len(layouts)
    text = F.coalesce(*[F.when(k == i, F.date_format("d", f)) for i, f in enumerate(layouts)])
    return o.select("o_orderkey", text.alias("dmy"), F.date_format("d", "yyyy-MM-dd").alias("ymd"))


def fx_icd_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, code: each order line's part key picks a code of the Charlson map, written
    with a dot and a further digit as extracts have it."""
    codes = icd_codes()
    li = load_tables(spark, sf_dir, ["lineitem"])["lineitem"].select("l_orderkey", "l_partkey")
    table = F.array(*[F.lit(c) for c in codes])
    code = F.element_at(table, (F.col("l_partkey") % len(codes) + 1).cast("int"))
    dotted = F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 9), (F.col("l_partkey") % 2).cast("string"))
    return li.select(F.col("l_orderkey").alias("episode_id"), dotted.alias("code"))


def icd_codes() -> list[str]:
    """The first prefix of every condition of the Charlson map, and a code of none."""
    from staylink.operators.comorbidity import charlson_rows

    first: dict[str, str] = {}
    for prefix, condition, _ in charlson_rows():
        first.setdefault(condition, prefix)
    return [*first.values(), "S720"]


def fx_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, death_date, age_death; persons with key % 10 = 0 get a second, earlier record."""
    c = load_tables(spark, sf_dir, ["customer"])["customer"].select("c_custkey", "c_acctbal")
    c = c.filter(F.col("c_acctbal") < 1500)
    first = c.select(
        F.col("c_custkey").alias("person_id"),
        F.date_add(F.lit(dt.date(1999, 1, 1)), (F.col("c_custkey") % 1300).cast("int")).alias("death_date"),
        (F.lit(60) + F.col("c_custkey") % 30).cast("int").alias("age_death"),
    )
    second = c.filter(F.col("c_custkey") % 10 == 0).select(
        F.col("c_custkey").alias("person_id"),
        F.date_add(F.lit(dt.date(1998, 1, 1)), (F.col("c_custkey") % 1000).cast("int")).alias("death_date"),
        (F.lit(59) + F.col("c_custkey") % 30).cast("int").alias("age_death"),
    )
    return first.unionByName(second)


def fx_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, code: the part types of an order's lines (repeats kept, as in a long table)."""
    t = load_tables(spark, sf_dir, ["lineitem", "part"])
    li = t["lineitem"].select("l_orderkey", "l_partkey")
    pa = t["part"].select("p_partkey", "p_type")
    return li.join(pa, li["l_partkey"] == pa["p_partkey"]).select(
        F.col("l_orderkey").alias("episode_id"), F.col("p_type").alias("code")
    )


# Fixed values of the fixture code map (FIXTURES.md B): code prefix, condition, weight.
FX_CODE_MAP_ROWS: list[tuple[str, str, int]] = [
    ("PROMO", "promo", 1),
    ("LARGE", "large", 2),
]


def fx_code_map(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("prefix", T.StringType(), False),
            T.StructField("condition", T.StringType(), False),
            T.StructField("weight", T.IntegerType(), False),
        ]
    )
    return spark.createDataFrame(FX_CODE_MAP_ROWS, schema)

"""Benchmark decontamination with DataFrame functions only.

Benchmark items become a set of word windows (k words; a shorter item is one window).
Every document is tokenised once; the hash of the first words of a window is looked up at every
place in the broadcast set inside the scan, and the whole window verified on the words; only hits,
and one row with the size of each document, leave it. The hit spans then
give the words to remove, or the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylink.llm.shared import columns, written

#: Runs of bytes other than 00-2F, 3A-60 and 7B-7F, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows that are broadcast at most (hash, words and item: about 100 bytes each). Those of
#: a larger benchmark meet the documents' windows in a shuffle instead.
BROADCAST_WINDOWS = 200_000

#: Words of a window that are looked up before the rest is compared.
HEAD = 4


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, k: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words, n): the distinct windows of every item. Items without words have none."""
    items = columns(benchmark, item_id=item_col, text=text_col).select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, k), " "))).alias("words")).distinct().withColumn("n", F.size(F.split("words", " ")))


def row_key() -> Column:
    """Tells rows apart without numbering them: rows of equal id and text have equal results."""
    return F.struct("doc_id", F.xxhash64("text").alias("h"))


def head_hash(words: Column, start: Column, m: int) -> Column:
    """Hash of the m words from start (from 1) of an array of words."""
    return F.xxhash64(F.lit(m), *[F.get(words, start - 1 + j) for j in range(m)])


def found(docs: DataFrame, benchmark: DataFrame, k: int = 10, item_col: str = "item_id", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs (doc_id, text) to (row, size, start, n, item_id), texts tokenised once: a row of start 0 with
    the number of words for every document, and one for every occurrence of every window.

    Each word position is looked up by the hash of a window's first HEAD words (or of all, if it has
    fewer); where one can start, the whole window is compared, word for word.
    """
    windows = written(windows_of(benchmark, k, item_col).withColumn("m", F.least("n", F.lit(HEAD))), "windows")
    heads = [r.m for r in windows.select("m").distinct().orderBy("m").collect()] or [HEAD]  # at most HEAD numbers
    w, i, m = F.col("w"), F.col("i"), F.col("m")
    each = docs.select(row_key().alias("row"), words_of(F.col("text")).alias("w"))
    each = each.select("row", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("i"))
    # place 0 stands for the document; the words go along by reference, within one generated loop
    if len(heads) > 1:
        each = each.select("*", F.explode(F.array(*[F.lit(h) for h in heads])).alias("m")).filter((i > 0) | (m == heads[0]))
    else:
        each = each.withColumn("m", F.lit(heads[0]))

    def by_head(words: Column, start: Column) -> Column:
        out = F.when(m == heads[0], head_hash(words, start, heads[0]))
        for h in heads[1:]:
            out = out.when(m == h, head_hash(words, start, h))
        return out

    each = each.withColumn("h", F.when(i == 0, F.lit(0).cast("long")).otherwise(by_head(w, i)))
    keys = windows.select(by_head(F.split("words", " "), F.lit(1)).alias("key"), "words", "n", "item_id")
    document = docs.sparkSession.createDataFrame([(0, None, 0, None)], keys.schema)  # lets the documents' own rows pass
    keys = keys.unionByName(document)

    def same(words: Column, start: Column) -> Column:
        return F.array_join(F.slice(words, start, F.greatest(F.col("n"), F.lit(1))), " ") == F.col("words")

    at_place = (F.col("h") == F.col("key")) & ((i == 0) == F.col("words").isNull())
    out = [F.col("row"), F.when(i == 0, F.size("w")).alias("size"), i.alias("start"), "n", "item_id"]
    if windows.count() <= broadcast_windows:
        return each.join(F.broadcast(keys), at_place & ((i == 0) | same(w, F.greatest(i, F.lit(1))))).select(*out)
    # without a broadcast only the places travel; texts come back for those where a window can start
    own = each.filter("i = 0").select(F.col("row"), F.size("w").alias("size"), i.alias("start"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("item_id"))
    places = each.filter("i > 0").select("row", "i", "h").join(keys.filter("words is not null"), F.col("h") == F.col("key"))
    places = places.groupBy(F.col("row").alias("at")).agg(F.collect_set(F.struct("i", "n", "words", "item_id")).alias("c"))
    texts = docs.select(row_key().alias("row"), "text").dropDuplicates(["row"])
    texts = texts.join(places, texts["row"].eqNullSafe(places["at"])).select("row", words_of(F.col("text")).alias("w"), F.explode("c").alias("c")).select("row", "w", "c.*")
    met = texts.filter(same(w, i)).select("row", F.lit(None).cast("int").alias("size"), i.alias("start"), "n", "item_id")
    return own.unionByName(met)


def hits(docs: DataFrame, benchmark: DataFrame, k: int = 10, item_col: str = "item_id") -> DataFrame:
    """docs (doc_id, text) to (row, start, n, item_id): every occurrence of every window."""
    return found(docs, benchmark, k, item_col).filter("start > 0").select("row", "start", "n", "item_id")


def covered(spans: Column) -> Column:
    """Words that a sorted array of (start, n) spans covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            F.greatest(a.end, s.start + s.n - 1).alias("end"),
            (a.total + F.greatest(F.lit(0), s.start + s.n - 1 - F.greatest(a.end, s.start - 1))).cast("long").alias("total"),
        ),
        lambda a: a.total,
    )


def report(docs: DataFrame, benchmark: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row.

    spans are the hit (start, n) word ranges, 1-based. Null texts have no words; repeated
    rows and null ids are judged one by one; an empty benchmark hits nothing.
    """
    own = columns(docs, doc_id=id_col, text=text_col)
    hit = F.col("start") > 0
    # sets of spans and items are partial aggregates, bounded by one document's words
    each = found(own, benchmark, k, item_col).groupBy("row").agg(
        F.max("size").cast("long").alias("n_words"),
        F.count_if(~hit).alias("copies"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("start", "n")))).alias("spans"),
        F.sort_array(F.collect_set(F.when(hit, F.col("item_id")))).alias("items"),
    )
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))  # equal rows each have theirs
    return each.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark window. Rows with
    null texts stay."""
    bad = hits(columns(docs, doc_id=id_col, text=text_col), benchmark, k, item_col).select(F.col("row").alias("hit")).distinct()
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole")
    key = F.struct(docs[f"`{id_col}`"].alias("doc_id"), F.xxhash64(docs[f"`{text_col}`"]).alias("h")).alias("key")
    keyed = docs.select(whole, key)
    return keyed.join(bad, keyed["key"].eqNullSafe(bad["hit"]), "left_anti").select("whole.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the normalised words of every document without those in hit spans."""
    own = columns(docs, doc_id=id_col, text=text_col)
    spans = hits(own, benchmark, k).groupBy(F.col("row").alias("hit")).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    keyed = own.withColumn("row", row_key())
    joined = keyed.join(spans, keyed["row"].eqNullSafe(spans["hit"]), "left").select("doc_id", words_of(F.col("text")).alias("w"), F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"))
    kept = F.filter("w", lambda _, i: ~F.exists("spans", lambda s: (i + 1 >= s.start) & (i + 1 < s.start + s.n)))
    return joined.select("doc_id", F.array_join(kept, " ").alias("text"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs, benchmark).drop("spans")


SQL = r"""
with tok as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), win as (
  select distinct cast(item_id as varchar) item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from item where len(w) > 0)
), spot as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from tok, (select distinct n from win) where len(w) >= n
), hit as (
  select doc_id, i, spot.n, item_id from spot join win on win.n = spot.n and win.g = array_to_string(w[i:i + spot.n - 1], ' ')
), pos as (
  select doc_id, count(distinct p) c from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id
), its as (
  select doc_id, count(distinct item_id) c, string_agg(distinct item_id, ',' order by item_id) s from hit group by doc_id
)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(pos.c, 0) as bigint) n_hit, cast(coalesce(its.c, 0) as bigint) n_items,
  sha256(coalesce(its.s, '')) items_sha256, coalesce(pos.c, 0) > 0 contaminated
from tok left join pos using (doc_id) left join its using (doc_id)
"""

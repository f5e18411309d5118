"""Comorbidity score and groups (DOM-10, SCL-10, SCL-11).

Diagnosis codes are matched to conditions by prefix. Instead of a ``LIKE`` join
(a theta join that compares every code with every prefix), each code is cut into
its prefixes of the lengths the map uses, and those are equi-joined to the map,
which is a fixed, bounded table and is broadcast. Each condition counts once per
episode; a worse form suppresses its milder form; the score is the sum of weights.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylink.functions.flags import ordered_label

# Charlson conditions and weights (Charlson et al. 1987) with ICD-10 codes
# after Quan et al. 2005 (Med Care 43:1130). Codes are prefixes without the dot.
# "A-B" is every code from A to B of the same length; "E10-E14/01689" appends each
# listed fourth character to each code of the range.
CHARLSON_ICD10 = """
myocardial_infarction     1  I21 I22 I252
heart_failure             1  I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290
peripheral_vascular       1  I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959
cerebrovascular           1  G45 G46 H340 I60-I69
dementia                  1  F00-F03 F051 G30 G311
chronic_pulmonary         1  I278 I279 J40-J47 J60-J67 J684 J701 J703
rheumatic                 1  M05 M06 M315 M32-M34 M351 M353 M360
peptic_ulcer              1  K25-K28
mild_liver                1  B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944
diabetes_uncomplicated    1  E10-E14/01689
diabetes_complicated      2  E10-E14/23457
hemiplegia_paraplegia     2  G041 G114 G801 G802 G81 G82 G830-G834 G839
renal                     2  I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992
malignancy                2  C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97
severe_liver              3  I850 I859 I864 I982 K704 K711 K721 K729 K765-K767
metastatic_solid_tumour   6  C77-C80
hiv_aids                  6  B20-B22 B24
"""

# A condition on the left is not counted when the one on the right is present.
CHARLSON_HIERARCHY = {
    "mild_liver": "severe_liver",
    "diabetes_uncomplicated": "diabetes_complicated",
    "malignancy": "metastatic_solid_tumour",
}

# Score intervals, group codes and labels of the reference's table and plot.
SCORE_GROUPS = [("[0,1)", 0, 1, "0"), ("[1,3)", 1, 3, "1-2"), ("[3,Inf)", 3, None, "3+")]
GROUP_LEVELS = ["0", "1-2", "3+"]
GROUP_LABELS = ["CCI 0", "CCI 1–2", "CCI 3+"]

MAP_SCHEMA = T.StructType(
    [
        T.StructField("prefix", T.StringType(), False),
        T.StructField("condition", T.StringType(), False),
        T.StructField("weight", T.IntegerType(), False),
    ]
)


def _expand(token: str) -> list[str]:
    """Expand one code token of :data:`CHARLSON_ICD10` to plain prefixes."""
    token, _, fourth = token.partition("/")
    if "-" in token:
        a, b = token.split("-")
        head = re.match(r"[A-Z]+", a).group(0)
        lo, hi, width = int(a[len(head):]), int(b[len(head):]), len(a) - len(head)
        codes = [f"{head}{i:0{width}d}" for i in range(lo, hi + 1)]
    else:
        codes = [token]
    return [c + d for c in codes for d in fourth] if fourth else codes


def charlson_rows(text: str = CHARLSON_ICD10) -> list[tuple[str, str, int]]:
    rows = []
    for line in text.strip().splitlines():
        name, weight, *tokens = line.split()
        rows.extend((p, name, int(weight)) for t in tokens for p in _expand(t))
    return rows


def charlson_prefix_lengths() -> list[int]:
    return sorted({len(p) for p, _, _ in charlson_rows()})


def charlson_map(spark: SparkSession) -> DataFrame:
    """The ICD-10 Charlson map as a table ``prefix, condition, weight``."""
    return spark.createDataFrame(charlson_rows(), MAP_SCHEMA)


def comorbidity_score(
    index: DataFrame,
    diagnoses: DataFrame,
    code_map: DataFrame,
    *,
    episode_col: str = "episode_id",
    code_col: str = "code",
    hierarchy: dict[str, str] | None = None,
    prefix_lengths: list[int] | None = None,
) -> DataFrame:
    """Per index episode: ``cci_score`` (0 when nothing matches).

    ``diagnoses`` is a long table (episode, code); only the index episodes' rows are used.
    ``code_map`` is a table (prefix, condition, weight); it is joined by equality, so its
    measured size decides whether it is broadcast. The prefix lengths it uses are read from it (a
    small job) unless given.
    """
    hierarchy = CHARLSON_HIERARCHY if hierarchy is None else hierarchy
    lengths = prefix_lengths or sorted(r[0] for r in code_map.select(F.length("prefix")).distinct().collect())
    # A semi join needs no distinct keys; repeated codes collapse in the sets of conditions,
    # which are partial aggregates and no larger than the map's conditions.
    ids = index.select(episode_col)
    code = F.upper(F.regexp_replace(F.col(code_col), r"[.\s]", ""))
    dx = diagnoses.select(episode_col, code.alias("_code")).join(ids, episode_col, "left_semi")
    cut = dx.select(
        episode_col, F.explode(F.array(*[F.substring("_code", 1, n) for n in lengths])).alias("prefix")
    )
    hit = cut.join(code_map, "prefix").withColumn("_below", F.lit(None).cast("string"))
    if hierarchy:
        # the milder form that a worse one suppresses: a literal of a few fixed pairs
        below = F.create_map(*[F.lit(x) for mild, worse in hierarchy.items() for x in (worse, mild)])
        hit = hit.withColumn("_below", below[F.col("condition")])
    # one aggregate: the distinct matched conditions with weights, and the suppressed ones
    found = hit.groupBy(episode_col).agg(
        F.collect_set(F.struct("condition", "weight")).alias("_c"), F.collect_set("_below").alias("_off")
    )
    left = F.filter("_c", lambda x: ~F.array_contains(F.col("_off"), x["condition"]))
    score = found.select(episode_col, F.aggregate(left, F.lit(0), lambda a, x: a + x["weight"]).alias("cci_score"))
    return (
        index.join(score, episode_col, "left")
        .withColumn("cci_score", F.coalesce(F.col("cci_score"), F.lit(0)))
    )


def long_diagnoses(wide: DataFrame, columns: list[str], *, episode_col: str = "episode_id", code_col: str = "code") -> DataFrame:
    """Diagnosis columns of an episode table as the long table (episode, code), nulls left out."""
    codes = F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias(code_col)
    return wide.select(episode_col, codes).filter(F.col(code_col).isNotNull())


def score_groups(df: DataFrame, score_col: str = "cci_score") -> DataFrame:
    """``ccicat`` (interval), ``cci_group`` (0 / 1-2 / 3+), ``cci_label`` and ``cci_rank``."""
    s = F.col(score_col)
    cat = None
    grp = None
    for interval, lo, hi, g in SCORE_GROUPS:
        cond = (s >= lo) if hi is None else ((s >= lo) & (s < hi))
        cat = F.when(cond, F.lit(interval)) if cat is None else cat.when(cond, F.lit(interval))
        grp = F.when(cond, F.lit(g)) if grp is None else grp.when(cond, F.lit(g))
    label, rank = ordered_label("cci_group", GROUP_LEVELS, GROUP_LABELS)
    return df.withColumns({"ccicat": cat, "cci_group": grp}).withColumns({"cci_label": label, "cci_rank": rank})

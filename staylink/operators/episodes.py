"""Episode ingest, flags and sequences (DOM-1, DOM-2, DOM-3, WIN-1..WIN-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylink.config import EpisodeCols, Study
from staylink.functions.dates import parse_dmy
from staylink.functions.flags import pattern_flag, threshold_flag
from staylink.operators.scan import drop_block, ordered_scan
from staylink.sources.stages import StageStore


def _id(c: str, id_type: str | None) -> Column:
    """A text id trimmed, empty as missing; cast only when a type is asked for."""
    text = F.nullif(F.trim(F.col(c)), F.lit(""))
    return text if id_type is None else text.try_cast(id_type)


def type_episodes(raw: DataFrame, cols: EpisodeCols = EpisodeCols(), date_parser=parse_dmy, id_type: str | None = None) -> DataFrame:
    """Text columns (as read by SRC-1) to typed ones: dates ``date``, age ``int``; ids keep their
    type (``P77`` stays ``P77``) unless ``id_type`` names one.

    A value that does not parse becomes null (never an error), as ``dmy`` gives NA.
    """
    return raw.withColumns(
        {
            **{c: _id(c, id_type) for c in (cols.person, cols.episode) if c in raw.columns},
            cols.start: date_parser(cols.start),
            cols.end: date_parser(cols.end),
            cols.age: F.col(cols.age).try_cast("double").cast("int"),
        }
    )


def with_episode_id(df: DataFrame, cols: EpisodeCols = EpisodeCols()) -> DataFrame:
    """A tiebreak for extracts without an episode id: whole-row duplicates go first, then each
    row's id is a hash of its typed values and of which are missing. Two spellings of one date
    are one episode; a null before or after a value makes a difference."""
    one = df.distinct()
    marked = [x for c in one.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return one.withColumn(cols.episode, F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *marked)), 16, "0") for k in (1, 2)]))


def in_period(cols: EpisodeCols, study: Study) -> Column:
    """FLT-1: the whole episode lies in the study period, both ends inclusive; null dates fail."""
    return (F.col(cols.start) >= F.lit(study.start)) & (F.col(cols.end) <= F.lit(study.end))


def clean_episodes(df: DataFrame, cols: EpisodeCols = EpisodeCols(), study: Study = Study()) -> DataFrame:
    """DOM-1: whole-row duplicates dropped, then only episodes inside the study period.

    The distinct comes first (as in the reference) and is an aggregate on all columns,
    so copies of a row collapse map-side before the shuffle. Rows without a person id
    cannot be linked and are dropped here (counted by :func:`staylink.operators.quality.profile`).
    """
    return df.distinct().filter(in_period(cols, study) & F.col(cols.person).isNotNull())


def add_flags(df: DataFrame, cols: EpisodeCols = EpisodeCols(), study: Study = Study()) -> DataFrame:
    """DOM-2: ``age_flag`` (age >= threshold, null if age null), ``hip_flag`` (code matches, never null)."""
    return df.withColumns(
        {
            "age_flag": threshold_flag(cols.age, study.age_threshold),
            "hip_flag": pattern_flag(cols.code, study.hip_pattern),
        }
    )


def sequence_episodes(
    df: DataFrame,
    cols: EpisodeCols = EpisodeCols(),
    study: Study = Study(),
    *,
    with_file_seq: bool = True,
    keep_block: bool = False,
    store: StageStore | None = None,
) -> DataFrame:
    """DOM-3: the four counters of the reference, in one ordered scan per person.

    Order within a person: start, end, episode id (unique, so ties are settled the same
    way on every run).

    - ``file_seq``    position in the whole table ordered by (person, start, end, id)
    - ``person_seq``  position within the person
    - ``hip_cumcount`` running count of hip episodes, ``post_index`` = 1 from the first on
    - ``index_seq``   position counted from the first hip episode (0 before it)
    - ``hip_seq``     number of the hip episode among the person's hip episodes (0 on others)

    ``index_seq`` is ``person_seq - first_hip_pos + 1`` and ``hip_seq`` is the running
    hip count on hip rows: the same numbers as a ``row_number`` over (person, post_index)
    and (person, hip_flag), without two more sorts.
    """
    hip = F.col("hip_flag") == 1
    out = ordered_scan(
        df,
        [cols.person],
        cols.order(),
        {
            "person_seq": ("count", None),
            "hip_cumcount": ("sum", F.col("hip_flag").cast("int")),
            "_first_hip": ("first_pos", hip),
        },
        ranges=study.ranges,
        global_position="file_seq" if with_file_seq else None,
        store=store,
    )
    out = out.withColumns(
        {
            "hip_cumcount": F.col("hip_cumcount").cast("int"),
            "post_index": (F.col("hip_cumcount") > 0).cast("int"),
            "index_seq": F.when(
                F.col("_first_hip").isNotNull() & (F.col("person_seq") >= F.col("_first_hip")),
                F.col("person_seq") - F.col("_first_hip") + 1,
            )
            .otherwise(0)
            .cast("int"),
            "hip_seq": F.when(hip, F.col("hip_cumcount")).otherwise(0).cast("int"),
        }
    ).drop("_first_hip")
    return out if keep_block else drop_block(out)


def file_sequence(df: DataFrame, cols: EpisodeCols = EpisodeCols(), study: Study = Study()) -> DataFrame:
    """WIN-1: ``file_seq`` = 1..N over the whole table in (person, start, end, id) order.

    No window over the whole table: a prefix sum over the scan's ranges and a position in each.
    """
    out = ordered_scan(
        df,
        [cols.person],
        cols.order(),
        {},
        ranges=study.ranges,
        global_position="file_seq",
    )
    return drop_block(out)

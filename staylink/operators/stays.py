"""Transfer stays and hip stays (DOM-4, DOM-7, DOM-13, WIN-7, JN-2).

A stay is a run of a person's episodes joined by overlap or transfer. In
(start, end, id) order a new stay begins when

- the episode starts after the latest end seen so far for the person, or
- it starts on that latest end day and the previous episode's separation mode is
  not a transfer mode,

so nested and overlapping episodes always join, and a same-day episode joins
only after a transfer. The latest end seen so far is a running maximum, not the
previous row's end, because a long episode may hold several nested ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.config import EpisodeCols, Study
from staylink.operators.scan import drop_block, ordered_scan, segment_max
from staylink.sources.stages import StageStore


def transfer_stays(
    df: DataFrame, cols: EpisodeCols = EpisodeCols(), study: Study = Study(), *, keep_block: bool = False, store: StageStore | None = None
) -> DataFrame:
    """DOM-4: add ``stay_seq`` (1..), ``trans_seq`` (0 = first episode of the stay),
    ``stay_size``, ``admdate_first``, ``sepdate_last`` and ``totlos`` (days).

    Three levels that depend on each other: where a stay breaks, the stay's number and first
    row, the stay's maxima. All are windows over the same ranges, so the rows are read where
    they lie and shuffled no more."""
    modes = list(study.transfer_modes)
    start, end = F.col(cols.start), F.col(cols.end)
    scan = dict(ranges=study.ranges, store=store)
    s = ordered_scan(
        df,
        [cols.person],
        cols.order(),
        {
            "_pos": ("count", None),
            "_prev_end": ("max_before", end),
            "_prev_mode": ("prev", F.col(cols.mode)),
        },
        **scan,
    )
    after_transfer = F.coalesce(F.col("_prev_mode").isin(modes), F.lit(False))
    prev_end = F.col("_prev_end")
    new_stay = F.coalesce(
        prev_end.isNull() | (start > prev_end) | ((start == prev_end) & ~after_transfer), F.lit(True)
    )
    s = s.withColumn("_brk", new_stay)
    s = ordered_scan(
        s,
        [cols.person],
        cols.order(),
        {
            "stay_seq": ("sum", F.col("_brk").cast("int")),
            "_stay_first": ("last_pos", F.col("_brk")),
            "admdate_first": ("max", F.when(F.col("_brk"), start)),
        },
        **scan,
    )
    s = s.withColumns(
        {
            "stay_seq": F.col("stay_seq").cast("int"),
            "trans_seq": (F.col("_pos") - F.col("_stay_first")).cast("int"),
        }
    )
    s = segment_max(
        s, [cols.person], "stay_seq", {"sepdate_last": end, "stay_size": F.col("trans_seq") + 1}
    )
    s = s.withColumn("totlos", F.datediff("sepdate_last", "admdate_first")).drop(
        "_pos", "_prev_end", "_prev_mode", "_brk", "_stay_first"
    )
    return s if keep_block else drop_block(s)


def hip_stays(
    df: DataFrame,
    cols: EpisodeCols = EpisodeCols(),
    study: Study = Study(),
    *,
    hip_col: str = "hip_flag",
    keep_block: bool = False,
    store: StageStore | None = None,
) -> DataFrame:
    """DOM-7 / WIN-7 / JN-2: ``hf_stays_all`` numbers a person's stays whose first episode
    is a hip episode (1, 2, ...); every episode of such a stay gets the number, other
    episodes 0. Needs ``trans_seq`` from :func:`transfer_stays`.

    Two running values in one scan: the count of hip-stay starts so far, and the latest
    stay start so far (a running maximum of the start row's order key with its hip flag
    attached). No join back on (person, stay); rows that have their ranges from
    :func:`transfer_stays` are not shuffled.
    """
    stay_start = F.col("trans_seq") == 0
    first_hip = stay_start & (F.col(hip_col) == 1)
    last_start = F.when(
        stay_start, F.struct(F.col(cols.start), F.col(cols.end), F.col(cols.episode), F.col(hip_col).alias("hip"))
    )
    s = ordered_scan(
        df,
        [cols.person],
        cols.order(),
        {"_hs": ("sum", first_hip.cast("int")), "_last_start": ("max", last_start)},
        ranges=study.ranges,
        store=store,
    )
    s = s.withColumn(
        "hf_stays_all", F.when(F.col("_last_start.hip") == 1, F.col("_hs")).otherwise(0).cast("int")
    )
    s = s.drop("_hs", "_last_start")
    return s if keep_block else drop_block(s)

"""The next event after an anchor, for every anchor (JN-7).

Anchors and events are united in one table and put in order once; a running minimum from behind
then gives each anchor its next event. An anchor and an event meet in no join, so a person with very many
of both costs what the rows cost, and is cut into ranges like any other (operators/scan.py).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylink.operators.scan import drop_block, ordered_scan
from staylink.sources.stages import StageStore


def next_after(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor_time: str,
    event_time: str,
    *,
    carry: Sequence[str] = (),
    names: Sequence[str] = ("next_time",),
    strict: bool = True,
    ranges: int | None = None,
    store: StageStore | None = None,
) -> DataFrame:
    """``anchors`` with the time of the earliest event of the same key after ``anchor_time`` (on or
    after it if not ``strict``), and that event's ``carry`` columns, under ``names``; null where
    there is none or the anchor has no time or key. Among events of one time the smallest ``carry``
    values count. Events without a time or key take no part.
    """
    keys, carry = list(keys), list(carry)
    if len(names) != 1 + len(carry):
        raise ValueError("one name for the time and one for each carried column")
    known = F.col(event_time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    event = F.struct(F.col(event_time), *carry)
    rows = anchors.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(anchor_time).alias("_t"), F.struct(*anchors.columns).alias("_anchor"))
    found = events.filter(known).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(event_time).alias("_t"), event.alias("_event"))
    rows = rows.unionByName(found, allowMissingColumns=True)
    # behind an anchor stand the events that count: at equal times, strictly, the anchor comes last
    side = F.col("_anchor").isNotNull()
    rows = rows.withColumn("_side", (side if strict else ~side).cast("int"))
    rows = ordered_scan(rows, [f"_k_{k}" for k in keys], ["_t", "_side"], {"_next": ("min_after", F.col("_event"))}, ranges=ranges, store=store)
    rows = drop_block(rows).filter(side)
    usable = F.col("_t").isNotNull()
    for k in keys:
        usable = usable & F.col(f"_k_{k}").isNotNull()
    out = [F.when(usable, F.col(f"_next.{c}")).alias(n) for c, n in zip([event_time, *carry], names, strict=True)]
    return rows.select("_anchor.*", *out)


def next_admissions(stays: DataFrame, person: str, start: str, *, ranges: int | None = None, store: StageStore | None = None) -> DataFrame:
    """JN-7 / DOM-8 for every discharge, not the first alone: one row a stay (``person, stay_seq,
    sepdate_last``) with ``next_admission_date``, the earliest start of any later admission of the
    person strictly after the stay's discharge day, and ``days_to_next``."""
    discharges = stays.filter(F.col("trans_seq") == 0).select(person, "stay_seq", "sepdate_last")
    out = next_after(discharges, stays.select(person, start), [person], "sepdate_last", start, names=["next_admission_date"], ranges=ranges, store=store)
    return out.withColumn("days_to_next", F.datediff("next_admission_date", "sepdate_last"))

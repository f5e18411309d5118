"""Flags, recodes and labels (SCL-7..SCL-11, FLT-11)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bool01(cond: Column) -> Column:
    """Boolean to 0/1 ``int``; null stays null (R: ``(cond) * 1``)."""
    return cond.cast("int")


def threshold_flag(c: str | Column, threshold: int | float) -> Column:
    """1 if ``c >= threshold``, 0 if below, null if ``c`` is null."""
    return bool01(_c(c) >= F.lit(threshold))


def pattern_flag(c: str | Column, pattern: str) -> Column:
    """1 if the text matches the regular expression, else 0; a null text gives 0, never null."""
    return bool01(F.coalesce(_c(c).rlike(pattern), F.lit(False)))


def if_else(cond: Column, yes, no) -> Column:
    """R ``if_else``: a null condition gives null (Spark's ``when`` would take the else branch)."""
    yes_c = yes if isinstance(yes, Column) else F.lit(yes)
    no_c = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes_c).when(~cond, no_c)


def recode(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Value-by-value recode; a value not in the mapping is kept (as R's ``recode``)."""
    col = _c(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(col == F.lit(k), F.lit(v))) if out is None else out.when(col == F.lit(k), F.lit(v))
    return col if out is None else out.otherwise(col)


def ordered_label(c: str | Column, levels: Sequence[str], labels: Sequence[str]) -> tuple[Column, Column]:
    """Ordered factor: (label, rank). A value not among ``levels`` gives null for both."""
    col = _c(c)
    lab = None
    rank = None
    for i, (lv, lb) in enumerate(zip(levels, labels, strict=True), start=1):
        lab = F.when(col == lv, F.lit(lb)) if lab is None else lab.when(col == lv, F.lit(lb))
        rank = F.when(col == lv, F.lit(i)) if rank is None else rank.when(col == lv, F.lit(i))
    return lab, rank

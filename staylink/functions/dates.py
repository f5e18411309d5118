"""Date parsing and arithmetic (SCL-1..SCL-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_dmy(c: str | Column) -> Column:
    """Text day-month-year to ``date``; an impossible date (31/02/2006) or junk gives null.

    Any separator or none between the parts, month as number or English name (short or
    long, any case), four- or two-digit year, or eight or six digits in a row: 01/07/2005,
    1-7-2005, 1.7.05, 01072005, 010705, 01JUL2005, 1 July 2005, 01-Jul-05. A two-digit year of 69 and above is
    19xx, a lower one 20xx. The text is brought to ``d/M/yyyy`` and parsed once.
    """
    s = F.lower(F.trim(_c(c)))
    plain = r"^(\d{1,2})[^0-9a-z]+(\d{1,2})[^0-9a-z]+(\d{4}|\d{2})$"
    solid = r"^(\d{2})(\d{2})(\d{4}|\d{2})$"
    named = r"^(\d{1,2})[^0-9a-z]*([a-z]{3,9})[^0-9a-z]*(\d{4}|\d{2})$"

    def part(i: int) -> Column:
        return F.when(s.rlike(plain), F.regexp_extract(s, plain, i)).when(s.rlike(solid), F.regexp_extract(s, solid, i)).when(s.rlike(named), F.regexp_extract(s, named, i))

    names = "|".join(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"))
    word = F.regexp_extract(s, named, 2)
    known = (F.length(word) == 3) | word.rlike(f"^({names}|sept)$")
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(word, 1, 3))
    month = F.when(s.rlike(named), F.when(known & (number > 0), number.cast("string"))).otherwise(part(2))
    y = part(3)
    year = F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y.cast("int") >= 69, F.lit("19")).otherwise(F.lit("20")), y))
    return F.try_to_date(F.concat_ws("/", F.nullif(part(1), F.lit("")), month, year), "d/M/yyyy")


def parse_ymd(c: str | Column) -> Column:
    """ISO text (or a date/timestamp) to ``date``; junk gives null."""
    return F.try_to_date(_c(c).cast("string"), "yyyy-MM-dd")


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from ``earlier`` to ``later`` as ``int`` (R: ``as.numeric(later - earlier)``)."""
    return F.datediff(_c(later), _c(earlier))


def least_date(*cols: str | Column) -> Column:
    """Earliest of the dates, nulls skipped (R: ``pmin(..., na.rm = TRUE)``)."""
    return F.least(*[_c(c) for c in cols])

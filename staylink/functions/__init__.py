"""Column-level helpers (scalar functions): all built from ``pyspark.sql.functions``."""

from staylink.functions.dates import days_between, least_date, parse_dmy, parse_ymd
from staylink.functions.flags import (
    bool01,
    if_else,
    ordered_label,
    pattern_flag,
    recode,
    threshold_flag,
)

__all__ = [
    "bool01",
    "days_between",
    "if_else",
    "least_date",
    "ordered_label",
    "parse_dmy",
    "parse_ymd",
    "pattern_flag",
    "recode",
    "threshold_flag",
]

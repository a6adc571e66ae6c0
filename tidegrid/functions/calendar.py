"""Calendar features of a timestamp as native expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feature names are fixed: column names and proposals refer to them.
BASIC = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,  # Monday = 0
    "dayofyear": F.dayofyear,
    "hour": F.hour,
    "minute": F.minute,
    "quarter": F.quarter,
    "weekofyear": F.weekofyear,  # ISO 8601
}
FLAGS = {
    "is_weekend": lambda t: F.weekday(t) >= 5,
    "is_month_start": lambda t: F.dayofmonth(t) == 1,
    "is_month_end": lambda t: t.cast("date") == F.last_day(t),
}
ALL = (*BASIC, *FLAGS)
PERIODS = {"hour": 24, "month": 12, "dayofweek": 7}


def time_columns(
    time_col: str, features: Sequence[str] | None = None, cyclical: bool = True
) -> dict[str, Column]:
    """Columns ``{time_col}_{feature}``; the six sine / cosine columns depend on ``cyclical`` only."""
    chosen = ALL if features is None else tuple(features)
    unknown = [f for f in chosen if f not in ALL]
    if unknown:
        raise ValueError(f"unknown time features {unknown}, use {sorted(ALL)}")
    t = F.col(time_col)
    out = {f"{time_col}_{f}": BASIC[f](t).cast("int") for f in chosen if f in BASIC}
    out |= {f"{time_col}_{f}": FLAGS[f](t).cast("int") for f in chosen if f in FLAGS}
    if cyclical:
        for name, period in PERIODS.items():
            angle = BASIC[name](t) * F.lit(2 * math.pi) / period
            out[f"{time_col}_{name}_sin"] = F.sin(angle)
            out[f"{time_col}_{name}_cos"] = F.cos(angle)
    return out


def baseline_columns(ts: str) -> dict[str, Column]:
    """The un-prefixed calendar columns of the manual feature set."""
    t = F.col(ts)
    return {
        "hour": F.hour(t).cast("int"),
        "weekday": F.weekday(t).cast("int"),
        "month": F.month(t).cast("int"),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    }

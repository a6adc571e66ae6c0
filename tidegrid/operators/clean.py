"""Missing values: conversion, dropping and filling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.layout import POS, Series, carry, positions


def to_numeric(value: Column | str) -> Column:
    """Text to double; unreadable text, NaN and infinity markers of missing become NULL."""
    number = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    return F.when(~F.isnan(number), number)


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL is the one missing marker; Spark would count NaN as a value."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    chosen = floats if cols is None else floats & set(cols)
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


def to_datetime(value: Column | str, fmt: str | None = None) -> Column:
    """Strict conversion of a time column; a value that is no timestamp is an error."""
    value = F.col(value) if isinstance(value, str) else value
    return F.to_timestamp_ntz(value, F.lit(fmt)) if fmt else value.cast("timestamp_ntz")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows complete in ``cols`` (NaN counts as missing)."""
    return df.na.drop(subset=list(cols))


def fill_interpolate(
    df: DataFrame, s: Series, cols: Sequence[str], limit: int = 24, drop_empty: bool = False
) -> DataFrame:
    """Linear interpolation by row position, at most ``limit`` rows from each side of a gap.

    The inside of a longer gap keeps the value reached ``limit`` rows after its start; leading
    and trailing gaps take the nearest value. ``drop_empty`` leaves out series in which one of
    the columns has no value at all.
    """
    df = positions(df, s)
    pos = F.col(POS)
    near = {}
    for c in cols:
        near[f"v_{c}"] = F.col(c)
        near[f"p_{c}"] = F.when(F.col(c).isNotNull(), pos)
    carried = carry(
        df,
        s,
        POS,
        forward={f"__prev_{n}": e for n, e in near.items()},
        backward={f"__next_{n}": e for n, e in near.items()},
    )

    if drop_empty:
        carried = _without_empty(carried, [(f"__prev_v_{c}", f"__next_v_{c}") for c in cols])

    def filled(c: str) -> Column:
        v0, p0 = F.col(f"__prev_v_{c}"), F.col(f"__prev_p_{c}")
        v1, p1 = F.col(f"__next_v_{c}"), F.col(f"__next_p_{c}")
        reach = F.when((pos - p0 <= limit) | (p1 - pos <= limit), pos - p0).otherwise(F.lit(limit))
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p0.isNull(), v1)
            .when(p1.isNull(), v0)
            .otherwise(v0 + (v1 - v0) * reach / (p1 - p0))
        )

    return carried.select(
        *[filled(c).alias(c) if c in cols else F.col(c) for c in df.columns if c != POS]
    )


def _without_empty(carried: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that a fill can complete, judged on the carried values before the fill itself."""
    known = [F.col(a).isNotNull() | F.col(b).isNotNull() for a, b in pairs]
    return carried.where(reduce(and_, known))


def fill_forward(df: DataFrame, s: Series, cols: Sequence[str], drop_empty: bool = False) -> DataFrame:
    """Last known value; leading gaps take the first known value."""
    df = positions(df, s)
    carried = carry(
        df,
        s,
        POS,
        forward={f"__prev_{c}": F.col(c) for c in cols},
        backward={f"__next_{c}": F.col(c) for c in cols},
    )
    if drop_empty:
        carried = _without_empty(carried, [(f"__prev_{c}", f"__next_{c}") for c in cols])
    return carried.select(
        *[
            F.coalesce(f"__prev_{c}", f"__next_{c}").alias(c) if c in cols else F.col(c)
            for c in df.columns
            if c != POS
        ]
    )


METHODS = ("interpolate", "forward", "drop")


def stays_complete(s: Series, load_method: str, weather_method: str) -> bool:
    return s.complete and "drop" not in (load_method, weather_method)


def fill_missing(
    df: DataFrame,
    s: Series,
    target: str = "LOAD",
    stations: Sequence[str] = (),
    load_method: str = "interpolate",
    weather_method: str = "interpolate",
    limit: int = 24,
) -> DataFrame:
    """Fill target and stations, then drop the rows that are still incomplete.

    A filled column stays NULL only if it is NULL throughout its series, so with both methods
    filling, whole series are dropped and the grid of the others stays complete
    (:func:`stays_complete`).
    """
    for method in (load_method, weather_method):
        if method not in METHODS:
            raise ValueError(f"unknown fill method {method!r}, use one of {METHODS}")
    if load_method == "drop":
        df = drop_missing(df, [target])
        s = Series(s.keys, s.ts, s.step, s.chunk, False, s.ties)
    done = []
    for method in ("interpolate", "forward"):
        cols = [target] if load_method == method else []
        cols += list(stations) if weather_method == method else []
        if cols and method == "interpolate":
            df = fill_interpolate(df, s, cols, limit, drop_empty=True)
        elif cols:
            df = fill_forward(df, s, cols, drop_empty=True)
        done += cols
    rest = [c for c in (target, *stations) if c not in done and not (c == target and load_method == "drop")]
    return drop_missing(df, rest) if rest else df

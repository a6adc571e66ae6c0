"""Lag, rolling, calendar and cross features.

A feature is a named recipe. Recipes are collected first and turned into as few selects as
possible: all window features of one level share one window and therefore one shuffle and sort.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions import moments
from tidegrid.functions.arithmetic import add_across, cross_column
from tidegrid.functions.calendar import baseline_columns, time_columns
from tidegrid.operators.clean import to_datetime
from tidegrid.operators.layout import Series, ordered, windowed

DEFAULT_STATS = ("mean", "std", "max", "min")
DEFAULT_LAGS = (1, 2, 24, 168)
DEFAULT_WINDOWS = (6, 12, 24)


@dataclass(frozen=True)
class Feature:
    """``expr`` for a row-wise column, ``build`` for one that needs the ordered window; ``frame`` is the same column
    as a trailing frame of ``functions.moments``."""

    name: str
    needs: tuple[str, ...]
    expr: Column | None = None
    build: Callable[[WindowSpec], Column] | None = None
    before: int = 0
    after: int = 0
    frame: tuple[str, str, int, int, int] | None = None


def _skew(c: str, w: WindowSpec) -> Column:
    n = F.count(c).over(w).cast("double")
    adjusted = F.skewness(c).over(w) * F.sqrt(n * (n - 1)) / (n - 2)
    constant = F.min(c).over(w) == F.max(c).over(w)
    return F.when(n >= 3, F.when(constant, F.lit(0.0)).otherwise(adjusted))


def _kurt(c: str, w: WindowSpec) -> Column:
    n = F.count(c).over(w).cast("double")
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c).over(w) + 6)
    constant = F.min(c).over(w) == F.max(c).over(w)
    return F.when(n >= 4, F.when(constant, F.lit(-3.0)).otherwise(adjusted))


STATS: dict[str, Callable[[str, WindowSpec], Column]] = {
    "mean": lambda c, w: F.avg(c).over(w),
    "std": lambda c, w: F.stddev_samp(c).over(w),
    "var": lambda c, w: F.var_samp(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "median": lambda c, w: F.percentile(c, 0.5).over(w),
    "sum": lambda c, w: F.sum(c).over(w),
    "skew": _skew,
    "kurt": _kurt,
}


def _whole(values: Sequence[int], low: int, what: str) -> list[int]:
    values = list(values)
    if not values:
        raise ValueError(f"{what} must not be empty")
    bad = [v for v in values if isinstance(v, bool) or not isinstance(v, int) or v < low]
    if bad:
        raise ValueError(f"{what} takes integers >= {low}, got {bad}")
    return values


def lag_recipes(target: str, lags: Sequence[int]) -> list[Feature]:
    return [
        Feature(f"{target}_lag_{k}", (target,), build=lambda w, k=k: F.lag(target, k).over(w), before=k)
        for k in _whole(lags, 1, "lags")
    ]


def rolling_recipes(
    target: str,
    windows: Sequence[int],
    stats: Sequence[str] | None = None,
    center: bool = False,
    min_periods: int | None = None,
    shift: int = 0,
) -> list[Feature]:
    """Statistics over the last ``w`` rows, the current one included.

    ``shift=1`` ends the frame one row earlier, so that the value to be predicted stays outside.
    """
    stats = DEFAULT_STATS if stats is None else tuple(stats)
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}, use {sorted(STATS)}")
    out = []
    for size in _whole(windows, 2, "windows"):
        ahead = (size - 1) // 2 if center else 0
        first, last = -(size - 1 - ahead) - shift, ahead - shift
        need = min_periods or size
        for stat in stats:

            def build(w, stat=stat, first=first, last=last, need=need):
                frame = w.rowsBetween(first, last)
                return F.when(F.count(target).over(frame) >= need, STATS[stat](target, frame))

            name = f"{target}_rolling_{size}_{stat}" + (f"_shift_{shift}" if shift else "")
            out.append(
                Feature(
                    name, (target,), build=build, before=max(-first, 0), after=max(last, 0),
                    frame=(stat, target, first, last, need) if stat in moments.STATS and last <= 0 else None,
                )
            )
    return out


def time_recipes(
    time_col: str, features: Sequence[str] | None = None, cyclical: bool = True
) -> list[Feature]:
    return [
        Feature(name, (time_col,), expr=e)
        for name, e in time_columns(time_col, features, cyclical).items()
    ]


def cross_recipe(col1: str, col2: str, operation: str) -> Feature:
    name, expr = cross_column(col1, col2, operation)
    return Feature(name, (col1, col2), expr=expr)


def apply_recipes(df: DataFrame, s: Series, recipes: Sequence[Feature], pos: str | None = None) -> DataFrame:
    """Append the recipes in order; a recipe may use the output of an earlier one. ``pos`` names the rows' positions
    (``layout.positions``) where ``df`` has them, so that they are not numbered again."""
    pending: dict[str, Feature] = {}
    for r in recipes:
        missing = [c for c in r.needs if c not in df.columns and c not in pending]
        if missing:
            raise ValueError(f"column(s) {missing} do not exist, available: {df.columns}")
        if any(c in pending for c in r.needs):
            df, pending = _flush(df, s, pending, pos), {}
        if r.name in df.columns or r.name in pending:
            warnings.warn(f"column {r.name!r} exists and is replaced", stacklevel=2)
        pending[r.name] = r
    return _flush(df, s, pending, pos)


def _flush(df: DataFrame, s: Series, pending: dict[str, Feature], pos: str | None) -> DataFrame:
    floats = {c for c, t in df.dtypes if t == "double"}
    summed = {n: r for n, r in pending.items() if r.frame is not None and r.frame[1] in floats}
    frames = {n: r for n, r in pending.items() if r.build is not None and n not in summed}
    scalars = {n: r.expr for n, r in pending.items() if r.expr is not None}
    order = [c for c in df.columns if c not in pending] + list(pending)
    if scalars:
        kept = [c for c in df.columns if c not in scalars]
        df = df.select(*kept, *[e.alias(n) for n, e in scalars.items()])
    if summed:
        df = df.drop(*summed)
        df = ordered(df, s, lambda rows, group: moments.trailing(rows, group, {n: r.frame for n, r in summed.items()}), before=max(r.before for r in summed.values()), pos=pos)
    if frames:
        df = windowed(
            df,
            s,
            lambda w: {n: r.build(w) for n, r in frames.items()},
            before=max(r.before for r in frames.values()),
            after=max(r.after for r in frames.values()),
            pos=pos,
        )
    return df.select(*order) if pending else df


def generate_lag_features(df: DataFrame, s: Series, target_col: str, lag_list: Sequence[int]) -> DataFrame:
    return apply_recipes(df, s, lag_recipes(target_col, lag_list))


def generate_rolling_features(
    df: DataFrame,
    s: Series,
    target_col: str,
    window_list: Sequence[int],
    stats: Sequence[str] | None = None,
    center: bool = False,
    min_periods: int | None = None,
    shift: int = 0,
) -> DataFrame:
    recipes = rolling_recipes(target_col, window_list, stats, center, min_periods, shift)
    return apply_recipes(df, s, recipes)


def generate_time_features(
    df: DataFrame, time_col: str, features: Sequence[str] | None = None, cyclical: bool = True
) -> DataFrame:
    if time_col not in df.columns:
        raise ValueError(f"column {time_col!r} does not exist, available: {df.columns}")
    if not df.schema[time_col].dataType.typeName().startswith("timestamp"):
        df = df.withColumn(time_col, to_datetime(time_col))
    added = time_columns(time_col, features, cyclical)
    kept = [c for c in df.columns if c not in added]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def generate_cross_features(df: DataFrame, col1: str, col2: str, operation: str) -> DataFrame:
    for c in (col1, col2):
        if c not in df.columns:
            raise ValueError(f"column {c!r} does not exist, available: {df.columns}")
    name, expr = cross_column(col1, col2, operation)
    return df.withColumn(name, expr)


def generate_all_features(
    df: DataFrame,
    s: Series,
    target_col: str,
    time_col: str,
    lag_list: Sequence[int] = DEFAULT_LAGS,
    rolling_windows: Sequence[int] = DEFAULT_WINDOWS,
    rolling_stats: Sequence[str] = DEFAULT_STATS,
    cross_pairs: Sequence[tuple[str, str, str]] = (),
    time_features: Sequence[str] | None = None,
    cyclical: bool = True,
) -> tuple[DataFrame, dict]:
    """All four families at once and a report of what was added."""
    lags = lag_recipes(target_col, lag_list)
    rolling = rolling_recipes(target_col, rolling_windows, rolling_stats)
    times = time_recipes(time_col, time_features, cyclical)
    crosses = [cross_recipe(*p) for p in cross_pairs]
    out = apply_recipes(df, s, [*lags, *rolling, *times, *crosses])
    new = [c for c in out.columns if c not in df.columns]
    report = {
        "n_original_cols": len(df.columns),
        "n_new_cols": len(new),
        "n_total_cols": len(out.columns),
        "new_columns": new,
        "lag_count": len(lags),
        "rolling_count": len(rolling),
        "time_count": len(times),
        "cross_count": len(crosses),
    }
    return out, report


# The manual feature set, in output order (names are part of the interface).
BASELINE_FEATURES = (
    "hour", "weekday", "month", "is_weekend",
    "lag_1", "lag_24", "lag_168",
    "temp", "temp_lag_24", "temp_mean", "temp_min", "temp_max", "temp_std",
    "rolling_mean_24_load", "rolling_std_24_load", "rolling_mean_168_load",
    "rolling_mean_24_temp",
)
META_COLUMNS = ("task_id", "ZONEID", "TIMESTAMP")


def build_baseline_features(
    df: DataFrame, s: Series, stations: Sequence[str], target: str = "LOAD"
) -> DataFrame:
    """The 17 manual features: one window of 168 rows look-back, then one row-wise select."""
    return baseline_rows(baseline_windows(df, s, stations, target), s, stations)


def baseline_rows(df: DataFrame, s: Series, stations: Sequence[str]) -> DataFrame:
    """The manual features in their order: those of a row alone join those of :func:`baseline_windows`."""
    plain = {**baseline_columns(s.ts), "temp": F.col(stations[0])}
    rows = add_across(df.select("*", *[c.alias(n) for n, c in plain.items()]), stations)
    return rows.select(*[c for c in df.columns if c not in BASELINE_FEATURES], *BASELINE_FEATURES)


def baseline_windows(df: DataFrame, s: Series, stations: Sequence[str], target: str = "LOAD") -> DataFrame:
    """The manual features that look back. Columns that a row gives by itself are not moved for them.

    The statistics of 168 rows are put together from those of 24: a frame of a week is seven frames of a day, each looked up
    at its last row. So a row costs a frame of 24 rows and six lags instead of 168 updates, and no difference
    of running sums loses digits.
    """
    rows = add_across(df, stations).select(*df.columns, "temp_mean")
    ends = range(24, 168, 24)

    def days(w: WindowSpec) -> dict[str, Column]:
        day = w.rowsBetween(-23, 0)
        return {
            "rolling_std_24_load": STATS["std"](target, day),
            "rolling_mean_24_temp": F.avg("temp_mean").over(day),
            "__sum": F.sum(F.col(target).cast("double")).over(day),
            "__n": F.count(target).over(day),
        }

    def weeks(w: WindowSpec) -> dict[str, Column]:
        def week(c: str) -> Column:
            return sum((F.coalesce(F.lag(c, k).over(w), F.lit(0)) for k in ends), F.coalesce(F.col(c), F.lit(0)))

        return {
            "lag_1": F.lag(target, 1).over(w),
            "lag_24": F.lag(target, 24).over(w),
            "lag_168": F.lag(target, 168).over(w),
            "temp_lag_24": F.lag(stations[0], 24).over(w),
            "rolling_mean_24_load": F.try_divide("__sum", "__n"),
            "rolling_std_24_load": F.col("rolling_std_24_load"),
            "rolling_mean_168_load": F.try_divide(week("__sum"), week("__n")),
            "rolling_mean_24_temp": F.col("rolling_mean_24_temp"),
        }

    return windowed(rows, s, days, before=168, then=weeks).drop("temp_mean")


def feature_columns(
    df: DataFrame, target: str, time_col: str, base: Sequence[str] | None = None
) -> list[str]:
    """Either the members of a fixed list that exist, or everything but target, time and meta."""
    if base is not None:
        return [c for c in base if c in df.columns]
    return [c for c in df.columns if c not in (target, time_col, *META_COLUMNS)]

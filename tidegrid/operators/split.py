"""Train / validation / test by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.layout import Series, index_rows, join_by_series
from tidegrid.session import materialize

ROW, ROWS = "__row", "__rows"


def _ends(train_ratio: float, val_ratio: float, gap: int):
    """Row numbers at which the training part ends and the validation part ends."""
    n = F.col(ROWS)
    train_end = (n * F.lit(float(train_ratio))).cast("long")
    return train_end, train_end + (n * F.lit(float(val_ratio))).cast("long") + gap


def _cut_at_times(df: DataFrame, s: Series, train_ratio: float, val_ratio: float, gap: int, stage: bool) -> DataFrame:
    """The sequential split where no two rows of a series share a time: keys and times alone are numbered, the times at which
    the parts begin (one row per series) meet the rows."""
    timed = F.col(s.ts).isNotNull()
    row, (train_end, val_end) = F.col(ROW), _ends(train_ratio, val_ratio, gap)
    numbered = index_rows(df.where(timed).select(*s.keys, s.ts), s, ROW, ROWS)
    begins = {"__gap": train_end, "__val": train_end + gap, "__test": val_end}
    cuts = numbered.groupBy(*s.keys).agg(*[F.min(F.when(row == at, F.col(s.ts))).alias(c) for c, at in begins.items()])
    if stage:
        cuts = materialize(cuts, "cuts")
    after = {c: F.coalesce(F.col(s.ts) >= F.col(c), F.lit(False)) for c in begins}  # a part that never begins has no row
    label = F.when(after["__test"], F.lit("test")).when(after["__val"], F.lit("val")).when(~after["__gap"], F.lit("train"))
    labelled = join_by_series(df, cuts, s.keys).select(*df.columns, F.when(timed, label).alias("split"))
    return labelled.where(F.col("split").isNotNull() | ~timed)


def _sequential_label(train_ratio: float, val_ratio: float, gap: int):
    row, (train_end, val_end) = F.col(ROW), _ends(train_ratio, val_ratio, gap)
    return (
        F.when(row < train_end, F.lit("train"))
        .when((row >= train_end + gap) & (row < val_end), F.lit("val"))
        .when(row >= val_end, F.lit("test"))
    )


def split_timeseries(
    df: DataFrame,
    s: Series,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    method: str = "sequential",
    gap: int = 0,
    by_time: bool = False,
    stage: bool = False,
) -> DataFrame:
    """Add ``split``. Rows of the gap behind the training part belong to no split and are dropped;
    rows without a time are kept with a NULL split.

    ``yearly`` tests on the last year of a series, validates on the one before, and falls back
    to ``sequential`` for series with fewer than three years. ``by_time`` states that no two rows of a series share
    a time: ``sequential`` then finds the times at which the parts begin, and the rows themselves are not numbered.
    ``stage`` writes these times first: Spark then knows their size, and where it lets it broadcast them no row is shuffled.
    """
    if method not in ("sequential", "yearly"):
        raise ValueError(f"unknown split method {method!r}")
    if by_time and method == "sequential":
        return _cut_at_times(df, s, train_ratio, val_ratio, gap, stage)
    label = _sequential_label(train_ratio, val_ratio, gap)
    numbered = index_rows(df, s, ROW, ROWS)
    if method == "yearly":
        # One row per series and calendar year, so the ranking never sees the rows themselves.
        years = df.where(F.col(s.ts).isNotNull()).groupBy(*s.keys, F.year(s.ts).alias("__year")).agg(F.lit(1).alias("__one"))
        newest = Window.partitionBy(*s.keys).orderBy(F.col("__year").desc())
        ranked = years.select(*s.keys, "__year", F.row_number().over(newest).alias("__k"))
        last = ranked.groupBy(*s.keys).agg(
            F.max("__k").alias("__years"),
            F.max(F.when(F.col("__k") == 1, F.col("__year"))).alias("__test"),
            F.max(F.when(F.col("__k") == 2, F.col("__year"))).alias("__val"),
        )
        numbered = join_by_series(numbered, last, s.keys)
        year = F.year(s.ts)
        label = F.when(F.col("__years") < 3, label).otherwise(
            F.when(year == F.col("__test"), F.lit("test"))
            .when(year == F.col("__val"), F.lit("val"))
            .otherwise(F.lit("train"))
        )
    timed = F.col(s.ts).isNotNull()
    return numbered.select(*df.columns, F.when(timed, label).alias("split")).where(F.col("split").isNotNull() | ~timed)


def split_profile(df: DataFrame, keys: tuple[str, ...], ts: str) -> DataFrame:
    """Rows and time range per split."""
    return df.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )

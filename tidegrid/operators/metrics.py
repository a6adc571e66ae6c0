"""Forecast errors as aggregate expressions, so any grouping works and partial sums are combined early."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO = 1e-8  # a magnitude up to this counts as zero (fixed)


def _pair(y: str, p: str) -> tuple[Column, Column]:
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    return F.when(both, F.col(y)), F.when(both, F.col(p))


def rmse(y: str, p: str) -> Column:
    a, b = _pair(y, p)
    return F.sqrt(F.avg((a - b) * (a - b)))


def mae(y: str, p: str) -> Column:
    a, b = _pair(y, p)
    return F.avg(F.abs(a - b))


def mape(y: str, p: str, zero: float = ZERO) -> Column:
    """Percent, over the rows whose actual value is not zero; NULL if there is none."""
    a, b = _pair(y, p)
    return F.avg(F.when(F.abs(a) > zero, F.abs((a - b) / a))) * 100


def smape(y: str, p: str, zero: float = ZERO) -> Column:
    a, b = _pair(y, p)
    size = F.abs(a) + F.abs(b)
    return F.avg(F.when(size > zero, F.abs(a - b) * 200 / size))


def r2(y: str, p: str) -> Column:
    """NULL when the actual values do not vary."""
    a, b = _pair(y, p)
    total = F.var_pop(a) * F.count(a)
    return F.lit(1.0) - F.try_divide(F.sum((a - b) * (a - b)), total)


METRICS = {"RMSE": rmse, "MAE": mae, "MAPE": mape, "SMAPE": smape, "R2": r2}


def metrics_by(
    df: DataFrame, keys: Sequence[str], y: str, p: str, digits: int | None = 4, prefix: str = ""
) -> DataFrame:
    """All metrics and the row count ``N`` in one aggregation."""
    exprs = []
    for name, f in METRICS.items():
        e = f(y, p)
        exprs.append((F.round(e, digits) if digits is not None else e).alias(prefix + name))
    return df.groupBy(*keys).agg(*exprs, F.count(_pair(y, p)[0]).alias(prefix + "N"))


def metric_deltas(history: DataFrame, run: Sequence[str]) -> DataFrame:
    """Change of each metric against the state before the round, 4 decimals.

    ``history``: run columns, ``iteration``, ``metric``, ``value`` and, where it was recorded, ``before``;
    without it the previous round's value is taken.
    """
    w = Window.partitionBy(*run, "metric").orderBy("iteration")
    previous = F.lag("value").over(w)
    if "before" in history.columns:
        previous = F.coalesce("before", previous)
    return history.select(*run, "iteration", "metric", previous.alias("before"), F.col("value").alias("after")).select(
        "*", F.round(F.col("after") - F.col("before"), 4).alias("delta")
    )


def with_errors(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.withColumn("error", F.col(y) - F.col(p)).withColumn("abs_error", F.abs(F.col(y) - F.col(p)))


def pair_predictions(
    predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], y: str, p: str
) -> DataFrame:
    """Match predictions with a truth table on series and time."""
    return with_errors(predictions.join(actuals, list(keys)), y, p)

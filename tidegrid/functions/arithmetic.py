"""Column arithmetic: crosses of two columns and statistics across columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# operation -> word in the column name (fixed, names are part of the interface)
CROSS_WORDS = {
    "add": "plus",
    "subtract": "minus",
    "diff": "minus",
    "multiply": "multiply",
    "divide": "div",
    "ratio": "div",
}


def finite_or_null(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)


def cross_column(col1: str, col2: str, operation: str) -> tuple[str, Column]:
    """Name and expression of one cross."""
    op = operation.lower().strip()
    if op not in CROSS_WORDS:
        raise ValueError(f"unknown operation {operation!r}, use {sorted(CROSS_WORDS)}")
    word = CROSS_WORDS[op]
    a, b = F.col(col1), F.col(col2)
    expr = {
        "plus": lambda: a + b,
        "minus": lambda: a - b,
        "multiply": lambda: a * b,
        "div": lambda: finite_or_null(F.try_divide(a, b)),
    }[word]()
    return f"{col1}_{word}_{col2}", expr


def add_across(df: DataFrame, cols: Sequence[str], prefix: str = "temp") -> DataFrame:
    """Add mean, minimum, maximum and sample deviation over several columns, skipping NULL.

    Two selects: the mean is computed once and then used by every term of the deviation.
    """
    count = reduce(add, [F.col(c).isNotNull().cast("int") for c in cols])
    total = reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    mean, n = F.col(f"{prefix}_mean"), F.col("__present")
    first = df.select("*", count.alias("__present"), F.try_divide(total, count).alias(f"{prefix}_mean"))
    spread = reduce(add, [F.coalesce((F.col(c) - mean) * (F.col(c) - mean), F.lit(0.0)) for c in cols])
    low = F.least(*cols) if len(cols) > 1 else F.col(cols[0])
    high = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    return first.select(
        *df.columns,
        f"{prefix}_mean",
        low.alias(f"{prefix}_min"),
        high.alias(f"{prefix}_max"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias(f"{prefix}_std"),
    )


def acf_bar(value: Column | str, width: int = 20) -> Column:
    """Text bar of a correlation: sign and up to ``width`` blocks, a dot for zero."""
    v = F.col(value) if isinstance(value, str) else value
    blocks = F.greatest(F.lit(1), F.floor(F.abs(v) * width).cast("int"))
    bar = F.concat(F.when(v > 0, F.lit("+")).otherwise(F.lit("-")), F.repeat(F.lit("█"), blocks))
    return F.when(v == 0, F.lit("·")).otherwise(bar)

"""Scalers that learn from the training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.layout import join_by_series


STATS = "__scale"


@dataclass(frozen=True)
class Scaler:
    """``stats`` has one row per series with ``c_<col>`` (centre) and ``s_<col>`` (scale). Rows of a
    series without training rows stay and get NULL."""

    stats: DataFrame
    keys: tuple[str, ...]
    cols: tuple[str, ...]

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the statistics of each row's series as one struct, which ``transform`` and ``inverse`` then read
        without a join of their own."""
        names = [c for c in self.stats.columns if c not in self.keys]
        return join_by_series(df, self.stats.select(*self.keys, F.struct(*names).alias(STATS)), self.keys)

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = {c: (F.col(c) - self._of(f"c_{c}")) / self._of(f"s_{c}") for c in self.cols}
        return self._select(df, out, suffix)

    def inverse(self, df: DataFrame, suffix: str = "", col: str | None = None, like: str | None = None) -> DataFrame:
        """Undo the scaling of all columns, or of one column by the numbers of ``like``."""
        pairs = {col: like} if col else {c: c for c in self.cols}
        out = {c: F.col(c) * self._of(f"s_{k}") + self._of(f"c_{k}") for c, k in pairs.items()}
        return self._select(df, out, suffix)

    @staticmethod
    def _of(name: str) -> Column:
        return F.col(STATS)[name]

    def _select(self, df: DataFrame, out: dict, suffix: str) -> DataFrame:
        joined = df if STATS in df.columns else self.attach(df)
        if suffix:
            return joined.select(*df.columns, *[e.alias(c + suffix) for c, e in out.items()])
        return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def fit_scaler(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    kind: str = "standard",
    split: str = "split",
) -> Scaler:
    """``standard``: mean and population deviation; ``minmax``: minimum and range. A constant
    column gets scale 1."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler {kind!r}")
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise KeyError(f"columns {absent} do not exist")
    exprs = []
    for c in cols:
        centre = F.avg(c) if kind == "standard" else F.min(c)
        width = F.stddev_pop(c) if kind == "standard" else F.max(c) - F.min(c)
        exprs += [centre.alias(f"c_{c}"), F.when(width == 0, F.lit(1.0)).otherwise(width).alias(f"s_{c}")]
    stats = df.where(F.col(split) == "train").groupBy(*keys).agg(*exprs)
    return Scaler(stats, tuple(keys), tuple(cols))

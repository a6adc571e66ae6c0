"""Time-series feature engineering and forecast evaluation on Spark DataFrames."""

from tidegrid.operators.layout import Series

__all__ = ["Series"]

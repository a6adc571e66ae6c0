"""Skewness and kurtosis of trailing frames against Spark's own window aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import LOOSE, SMALL, frame
from tidegrid.operators import features

PANDAS = {"skew": lambda x: x.skew(), "kurt": lambda x: x.kurt()}


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(3)
    parts = []
    for series in (0, 1, 2):
        x = rng.gamma(2.0, 1.0, 400) + 1e6
        x[rng.random(400) < 0.2] = np.nan
        x[100:150] = 5.0
        x[300:330] = np.nan
        parts.append(pd.DataFrame({"series": series, "ts": pd.date_range("2020-01-01", periods=400, freq="h"), "LOAD": x}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("s", [SMALL, LOOSE])
@pytest.mark.parametrize("shift", [0, 1])
@pytest.mark.parametrize("stat", ["skew", "kurt"])
def test_frames_equal_those_of_pandas(spark, readings, s, shift, stat, monkeypatch):
    monkeypatch.setitem(features.STATS, stat, None)  # no window aggregate
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")  # batches end inside frames and chunks
    try:
        out = features.generate_rolling_features(frame(spark, readings), s, "LOAD", [6, 30], [stat, "max"], min_periods=2, shift=shift)
        got = out.toPandas().sort_values(["series", "ts"]).reset_index(drop=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(readings)
    least = {"skew": 3, "kurt": 4}[stat]
    for size in (6, 30):
        name = f"LOAD_rolling_{size}_{stat}" + ("_shift_1" if shift else "")
        for series, part in readings.groupby("series"):
            x = part["LOAD"].reset_index(drop=True)
            mine = got.loc[got["series"] == series, name].tolist()
            for i in range(len(x)):
                frame_ = x[max(0, i + 1 - shift - size) : max(0, i + 1 - shift)].dropna()
                if len(frame_) < least:
                    assert math.isnan(mine[i])
                elif frame_.nunique() == 1:
                    assert mine[i] == {"skew": 0.0, "kurt": -3.0}[stat]
                else:
                    assert mine[i] == pytest.approx(PANDAS[stat](frame_ - frame_.mean()), rel=1e-6, abs=1e-6)


def test_values_that_are_nan_and_rows_without_key_or_time(spark):
    """NaN is a value, NULL is none; all rows come back, those without a time with NULL."""
    df = spark.range(40).select(
        F.when(F.col("id") % 2 == 0, F.lit("a")).alias("series"),
        F.expr("if(id < 38, timestamp_ntz'2020-01-01' + make_dt_interval(0, int(id)), null)").alias("ts"),
        F.expr("CASE WHEN id IN (10, 11) THEN double('NaN') WHEN id % 5 = 0 THEN NULL ELSE double(id * id) END").alias("LOAD"),
    )
    window = Window.partitionBy("series", F.col("ts").isNull()).orderBy("ts").rowsBetween(-4, 0)
    want = df.select("*", F.when(F.col("ts").isNotNull() & (F.count("LOAD").over(window) >= 3), features.STATS["skew"]("LOAD", window)).alias("want"))
    got = features.generate_rolling_features(df, LOOSE, "LOAD", [5], ["skew"], min_periods=3)
    both = [sorted(map(str, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()))) for d in (got, want)]
    assert both[0] == both[1] and len(both[0]) == 40

from __future__ import annotations

import math
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegrid.operators.layout import Series  # noqa: E402
from tidegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hourly() -> pd.DataFrame:
    """500 hours with a daily and a weekly cycle."""
    rng = np.random.default_rng(42)
    i = np.arange(500)
    return pd.DataFrame(
        {
            "series": 0,
            "ts": pd.date_range("2020-01-01", periods=500, freq="h"),
            "LOAD": 500 + 50 * np.sin(2 * math.pi * i / 24) + 30 * np.sin(2 * math.pi * i / 168) + rng.normal(0, 15, 500),
            "temp": 20 + 10 * np.sin(2 * math.pi * i / 24) + rng.normal(0, 3, 500),
        }
    )


SMALL = Series(keys=("series",), chunk=37, complete=True)  # many chunk borders
LOOSE = Series(keys=("series",), chunk=37)


def frame(spark, pdf: pd.DataFrame):
    """Spark frame with zone-less times and NULL for NaN."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    cols = [
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if f.dataType.typeName().startswith("timestamp")
        else F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if f.dataType.typeName() == "double"
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def pandas_of(df, *order: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)

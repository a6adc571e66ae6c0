"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import catalog
from check_sql import TABLES, compare
from tidegrid.operators.features import BASELINE_FEATURES

SF = "/root/testdata/sf0.001"
FAST = (
    "proj_to_numeric", "cross_divide", "time_basic", "lag_features", "rolling_kurt", "fill_interpolate", "split_sequential",
    "preprocess", "target_stats", "metric_r2", "importance_bottom10", "ts_candidates", "scan_all_tasks", "spec_validate_feature",
)

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    ok, text = compare(spark, con, name, SF)
    assert ok, text


def test_windows_hold_every_prepared_feature(spark, con):
    ok, text = compare(spark, con, "sliding_windows_all", SF)
    assert ok, text
    got = catalog.QUERIES["sliding_windows_all"](spark, SF)
    assert {f"{c}_sum" for c in ("LOAD", *BASELINE_FEATURES)} <= set(got.columns) and len(BASELINE_FEATURES) == 17
    assert got.select("steps", "channels").distinct().collect() == [(24, 18)]

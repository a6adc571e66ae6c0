"""Samples of parts without holes are numbered by their times."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import pandas as pd
import pytest
from conftest import LOOSE, frame

import catalog
from tidegrid.operators import samples
from tidegrid.operators.layout import without_holes

SF = "/root/testdata/sf0.001"


def test_holes_are_seen(spark, hourly):
    two = pd.concat([hourly, hourly.iloc[7:300].assign(series=1)])
    assert without_holes(frame(spark, two), LOOSE) == replace(LOOSE, complete=True)
    assert without_holes(frame(spark, two.drop(index=100)), LOOSE) == LOOSE
    untimed = frame(spark, two).selectExpr("series", "LOAD", "if(LOAD = max(LOAD) over (), null, ts) as ts")
    assert without_holes(untimed, LOOSE) == LOOSE
    nowhere = frame(spark, two.iloc[:9]).selectExpr("series", "LOAD", "cast(null as timestamp_ntz) as ts")
    assert without_holes(nowhere, LOOSE) == LOOSE


def test_times_number_the_same_samples(spark, hourly, monkeypatch):
    monkeypatch.setattr(samples, "BLOCK", 40)
    df = frame(spark, pd.concat([hourly, hourly.iloc[7:60].assign(series=1), hourly.iloc[3:20].assign(series=2)]))
    each = [samples.sliding_windows(df, s, ["temp"], "LOAD", 8, 2).orderBy("series", "ts").collect() for s in (LOOSE, without_holes(df, LOOSE))]
    assert each[0] == each[1] and len(each[0]) == 491 + 44 + 8


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")
def test_rows_of_the_prepared_table_are_not_numbered(spark, monkeypatch):
    seen, positions = [], samples.positions
    monkeypatch.setattr(samples, "positions", lambda df, s: seen.append(s.complete) or positions(df, s))
    catalog.QUERIES["sliding_windows_all"](spark, SF)
    assert seen == [True]

"""Chunked operators against pandas on whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import LOOSE, SMALL, frame, pandas_of
from pyspark.sql import functions as F

from tidegrid.operators import clean, features, samples, scale, split
from tidegrid.operators.grid import regularize
from tidegrid.operators.layout import Series, carry, index_rows, join_by_series, positions, windowed


def _skewed(seed: int = 1, n: int = 900) -> pd.DataFrame:
    """Three series; one holds most rows, one is short; long and short gaps everywhere."""
    rng = np.random.default_rng(seed)
    parts = []
    for key, size in ((1, n), (2, 60), (3, 200)):
        v = np.round(rng.normal(100, 20, size), 3)
        v[rng.random(size) < 0.3] = np.nan
        if size > 300:
            v[100:180] = np.nan
            v[:7] = np.nan
            v[-5:] = np.nan
        parts.append(pd.DataFrame({"series": key, "ts": pd.date_range("2021-03-01", periods=size, freq="h"), "LOAD": v}))
    return pd.concat(parts, ignore_index=True)


def test_row_numbers_are_exact_over_chunks(spark):
    pdf = _skewed().dropna()
    out = pandas_of(index_rows(frame(spark, pdf), LOOSE, "rn", "n"), "series", "ts")
    expected = pdf.groupby("series").cumcount()
    assert out["rn"].tolist() == expected.tolist()
    assert (out["n"] == out.groupby("series")["rn"].transform("size")).all()


@pytest.mark.parametrize("complete", [True, False])
def test_windows_do_not_depend_on_the_chunks(spark, complete):
    pdf = _skewed()
    s = Series(keys=("series",), chunk=37, complete=complete)

    def build(w):
        return {
            "lag": F.lag("LOAD", 50).over(w),
            "lead": F.lead("LOAD", 3).over(w),
            "mean": F.avg("LOAD").over(w.rowsBetween(-24, 0)),
        }

    out = pandas_of(windowed(frame(spark, pdf), s, build, before=50, after=3), "series", "ts")
    g = pdf.groupby("series")["LOAD"]
    np.testing.assert_allclose(out["lag"], g.shift(50))
    np.testing.assert_allclose(out["lead"], g.shift(-3))
    mean = g.rolling(25, min_periods=1).mean().reset_index(level=0, drop=True)
    np.testing.assert_allclose(out["mean"], mean, rtol=1e-12)


def test_carry_crosses_empty_chunks(spark):
    pdf = _skewed()
    df = positions(frame(spark, pdf), SMALL, "pos")
    got = carry(df, SMALL, "pos", {"prev": F.col("LOAD")}, {"next": F.col("LOAD")})
    out = pandas_of(got, "series", "ts")
    g = pdf.groupby("series")["LOAD"]
    np.testing.assert_allclose(out["prev"], g.ffill())
    np.testing.assert_allclose(out["next"], g.bfill())


@pytest.mark.parametrize("limit", [3, 24])
def test_interpolation_equals_pandas(spark, limit):
    pdf = _skewed()
    out = pandas_of(clean.fill_interpolate(frame(spark, pdf), SMALL, ["LOAD"], limit), "series", "ts")
    expected = pdf.groupby("series")["LOAD"].transform(
        lambda x: x.interpolate(method="linear", limit=limit, limit_direction="both").ffill().bfill()
    )
    np.testing.assert_allclose(out["LOAD"], expected, rtol=1e-12)


def test_fill_methods(spark):
    pdf = _skewed()
    pdf["w1"] = pdf["LOAD"].where(pdf["series"] != 2)  # series 2 has no station value at all
    df = frame(spark, pdf)
    forward = pandas_of(clean.fill_missing(df, SMALL, "LOAD", ["w1"], "forward", "forward"), "series", "ts")
    assert set(forward["series"]) == {1, 3}
    g = pdf[pdf["series"] != 2].groupby("series")["LOAD"]
    np.testing.assert_allclose(forward["LOAD"], g.transform(lambda x: x.ffill().bfill()))
    dropped = clean.fill_missing(df, SMALL, "LOAD", ["w1"], "drop", "drop")
    assert dropped.count() == pdf.dropna().shape[0]
    with pytest.raises(ValueError):
        clean.fill_missing(df, SMALL, load_method="spline")


def test_lags_crosses_and_calendar(spark, hourly):
    df = frame(spark, hourly)
    out = pandas_of(features.generate_lag_features(df, SMALL, "LOAD", [1, 24]), "ts")
    assert out.loc[100, "LOAD_lag_24"] == hourly.loc[76, "LOAD"]
    assert out["LOAD_lag_24"].isna().sum() == 24
    crossed = pandas_of(features.generate_cross_features(df, "LOAD", "temp", "multiply"), "ts")
    np.testing.assert_allclose(crossed["LOAD_multiply_temp"], hourly["LOAD"] * hourly["temp"])
    zero = hourly.assign(LOAD=hourly["LOAD"].where(hourly.index > 0, 0.0))
    ratio = pandas_of(features.generate_cross_features(frame(spark, zero), "temp", "LOAD", "divide"), "ts")
    assert ratio["temp_div_LOAD"].isna().tolist() == [True] + [False] * 499
    diff = features.generate_cross_features(df, "LOAD", "LOAD", "diff")
    assert diff.agg(F.max(F.abs("LOAD_minus_LOAD"))).first()[0] == 0
    times = pandas_of(features.generate_time_features(df, "ts"), "ts")
    assert times.filter(regex="_(sin|cos)$").abs().max().max() <= 1
    assert (times["ts_dayofweek"] == hourly["ts"].dt.dayofweek).all()
    assert (times["ts_weekofyear"] == hourly["ts"].dt.isocalendar().week.astype(int)).all()
    assert (times["ts_is_month_end"] == hourly["ts"].dt.is_month_end.astype(int)).all()


@pytest.mark.parametrize("center", [False, True])
def test_rolling_equals_pandas(spark, hourly, center):
    pdf = hourly.copy()
    pdf.loc[50:53, "LOAD"] = np.nan
    pdf.loc[200:230, "LOAD"] = 5.0  # constant stretch
    stats = list(features.STATS)
    got = features.generate_rolling_features(frame(spark, pdf), SMALL, "LOAD", [6, 11], stats, center, 4)
    out = pandas_of(got, "ts")
    for w in (6, 11):
        roll = pdf["LOAD"].rolling(w, center=center, min_periods=4)
        for stat in stats:
            name = f"LOAD_rolling_{w}_{stat}"
            np.testing.assert_allclose(out[name], getattr(roll, stat)(), rtol=1e-6, atol=1e-6, err_msg=name)


def test_rolling_shift_leaves_the_current_row_out(spark, hourly):
    got = features.generate_rolling_features(frame(spark, hourly), SMALL, "LOAD", [24], ["mean"], shift=1)
    expected = hourly["LOAD"].shift(1).rolling(24).mean()
    np.testing.assert_allclose(pandas_of(got, "ts")["LOAD_rolling_24_mean_shift_1"], expected, rtol=1e-10)


@pytest.mark.parametrize(
    "call",
    [
        lambda df: features.generate_lag_features(df, SMALL, "none", [1]),
        lambda df: features.generate_lag_features(df, SMALL, "LOAD", [0, -1]),
        lambda df: features.generate_lag_features(df, SMALL, "LOAD", []),
        lambda df: features.generate_rolling_features(df, SMALL, "LOAD", [1]),
        lambda df: features.generate_rolling_features(df, SMALL, "LOAD", [6], ["percentile"]),
        lambda df: features.generate_cross_features(df, "LOAD", "temp", "power"),
        lambda df: features.generate_cross_features(df, "LOAD", "none", "add"),
        lambda df: features.generate_time_features(df, "ts", ["century"]),
    ],
)
def test_bad_arguments(spark, hourly, call):
    with pytest.raises(ValueError):
        call(frame(spark, hourly))


def test_all_families_and_report(spark, hourly):
    out, report = features.generate_all_features(
        frame(spark, hourly), SMALL, "LOAD", "ts", cross_pairs=[("temp", "LOAD_lag_1", "multiply")]
    )
    counts = (report["lag_count"], report["rolling_count"], report["time_count"], report["cross_count"])
    assert counts == (4, 12, 18, 1)
    assert report["n_new_cols"] == sum(counts) and report["n_total_cols"] == len(out.columns)
    row = pandas_of(out, "ts").iloc[30]
    assert row["temp_multiply_LOAD_lag_1"] == pytest.approx(hourly.loc[30, "temp"] * hourly.loc[29, "LOAD"])


def test_station_statistics_skip_missing(spark):
    pdf = pd.DataFrame({"a": [1.0, np.nan, np.nan], "b": [3.0, 2.0, np.nan], "c": [8.0, np.nan, np.nan]})
    from tidegrid.functions.arithmetic import add_across

    out = add_across(frame(spark, pdf), ["a", "b", "c"]).toPandas()
    expected = pdf[["a", "b", "c"]]
    np.testing.assert_allclose(out["temp_mean"], expected.mean(axis=1))
    np.testing.assert_allclose(out["temp_std"], expected.std(axis=1))
    np.testing.assert_allclose(out["temp_max"], expected.max(axis=1))


def test_sequential_split_with_gap(spark):
    pdf = _skewed().dropna()
    out = pandas_of(split.split_timeseries(frame(spark, pdf), LOOSE, gap=5), "series", "ts")
    for key, group in out.groupby("series"):
        n = (pdf["series"] == key).sum()
        train, val = int(n * 0.7), int(n * 0.15)
        sizes = group["split"].value_counts().reindex(["train", "val", "test"], fill_value=0)
        assert sizes.tolist() == [train, val, max(n - train - val - 5, 0)]
        ranges = group.groupby("split")["ts"].agg(["min", "max"])
        assert ranges.loc["train", "max"] < ranges.loc["val", "min"]


def test_yearly_split_falls_back(spark):
    long = pd.DataFrame({"series": 1, "ts": pd.date_range("2018-01-01", "2020-12-31"), "LOAD": 1.0})
    short = pd.DataFrame({"series": 2, "ts": pd.date_range("2018-06-01", periods=100), "LOAD": 1.0})
    s = Series(keys=("series",), step=86400, chunk=50)
    out = split.split_timeseries(frame(spark, pd.concat([long, short])), s, method="yearly").toPandas()
    years = out[out["series"] == 1].groupby("split")["ts"].agg(lambda t: sorted(set(t.dt.year)))
    assert years.to_dict() == {"train": [2018], "val": [2019], "test": [2020]}
    assert out[out["series"] == 2]["split"].value_counts().to_dict() == {"train": 70, "val": 15, "test": 15}


@pytest.mark.parametrize("kind", ["standard", "minmax"])
def test_scaler_learns_from_train_only_and_inverts(spark, hourly, kind):
    pdf = hourly.assign(flat=3.0)
    parts = split.split_timeseries(frame(spark, pdf), SMALL)
    scaler = scale.fit_scaler(parts, ["series"], ["LOAD", "flat"], kind)
    out = pandas_of(scaler.transform(parts), "ts")
    train = pdf["LOAD"].iloc[:350]
    centre, width = (train.mean(), train.std(ddof=0)) if kind == "standard" else (train.min(), np.ptp(train))
    np.testing.assert_allclose(out["LOAD"], (pdf["LOAD"] - centre) / width, rtol=1e-9)
    assert (out["flat"] == 0).all()
    back = pandas_of(scaler.inverse(scaler.transform(parts)), "ts")
    np.testing.assert_allclose(back["LOAD"], pdf["LOAD"])


def test_samples_equal_slices(spark, hourly):
    df = frame(spark, hourly)
    out = pandas_of(samples.sliding_windows(df, SMALL, ["temp"], "LOAD", seq_len=24, pred_len=3), "ts")
    assert len(out) == 500 - 24 - 3 + 1
    data = hourly[["LOAD", "temp"]].to_numpy()
    for i in (0, 1, 255, 256, 400, len(out) - 1):
        np.testing.assert_array_equal(np.array(out["x"][i].tolist() if hasattr(out["x"][i], "tolist") else out["x"][i], dtype=object).tolist(), data[i : i + 24].tolist())
        assert list(out["y"][i]) == data[i + 24 : i + 27, 0].tolist()
    with pytest.raises(ValueError):
        samples.check_length(df, SMALL, 498, 3)


def test_samples_stay_inside_their_split(spark, hourly):
    parts = split.split_timeseries(frame(spark, hourly), SMALL)
    out = samples.sliding_windows(parts, LOOSE.with_keys("split"), [], "LOAD", 24, 1)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 350 - 24, "val": 75 - 24, "test": 75 - 24}


def test_join_by_series_keeps_every_row(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("series"), "id")
    stats = spark.createDataFrame([(0, "a"), (None, "n")], "series long, name string")
    out = join_by_series(big, stats, ["series"])
    assert out.columns == ["series", "id", "name"] and out.count() == 1000
    assert {(r["series"], r["name"]) for r in out.select("series", "name").distinct().collect()} == {(0, "a"), (1, None), (None, "n")}


def test_absent_steps_are_made_behind_the_last_shuffle(spark):
    """Chunk borders, a NULL key, readings of one step, and rows without a time; only known steps and chunk ends move."""
    readings = spark.sql("""SELECT * FROM VALUES ('a', timestamp_ntz'2020-01-01 05:10', 1L), ('a', timestamp_ntz'2020-01-01 05:50', 2L),
        ('a', timestamp_ntz'2020-01-20 07:00', 3L), (NULL, timestamp_ntz'2020-01-03 00:00', 4L), ('b', NULL, 5L), ('a', NULL, 6L) AS t(series, ts, v)""")
    out = regularize(readings, SMALL, {"v": F.sum("v"), "n": F.max("v")}, ("v",))
    got = {(r.series, r.ts): (r.v, r.n) for r in out.collect()}
    at = lambda day, hour: pd.Timestamp(2020, 1, day, hour).to_pydatetime()
    steps = pd.date_range(at(1, 5), at(20, 7), freq="h")
    known = {("a", at(1, 5)): (3, 2), ("a", at(20, 7)): (3, 3), (None, at(3, 0)): (4, 4), ("b", None): (5, 5), ("a", None): (6, 6)}
    assert out.count() == len(got) == len(steps) + 3
    assert got == {("a", t.to_pydatetime()): (None, None) for t in steps} | known
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.index("Generate explode(__steps") < plan.index("Exchange")


@pytest.mark.parametrize(("gap", "n"), [(0, 100), (3, 100), (2, 4), (0, 1)])
def test_parts_cut_at_times_are_those_of_row_numbers(spark, gap, n):
    """Holes, a NULL key, rows without a time and series too short for every part; the other columns aren't numbered."""
    rows = spark.range(3 * n).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("series"), (F.lit("2020-01-01").cast("timestamp_ntz")
        + F.make_dt_interval(hours=(F.col("id") * 7).cast("int"))).alias("ts"), F.col("id").cast("double").alias("LOAD"))
    df = rows.unionByName(rows.limit(2).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    by_number = split.split_timeseries(df, LOOSE, gap=gap)
    by_time = split.split_timeseries(df, LOOSE, gap=gap, by_time=True)
    key = lambda r: (r.series or 0, r.LOAD, str(r.ts))
    assert sorted(by_time.collect(), key=key) == sorted(by_number.collect(), key=key)
    plan = by_time.groupBy("split").agg(F.sum("LOAD"))._jdf.queryExecution().executedPlan().toString()
    numbering = [x for x in plan.splitlines() if "Window [row_number()" in x]
    assert numbering and not any("LOAD" in x for x in numbering)

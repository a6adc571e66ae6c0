from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import LOOSE, SMALL, frame, pandas_of
from pyspark.sql import functions as F

from tidegrid.operators import metrics, profile
from tidegrid.operators.features import apply_recipes, lag_recipes
from tidegrid.operators.layout import Series
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.plans.context import dataset_profile, history_summary, iteration_context, propose_features
from tidegrid.sources import sinks


def test_metric_vectors(spark):
    y, p = [100, 200, 300, 400, 500], [110, 190, 310, 390, 510]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double")
    row = metrics.metrics_by(df, [], "y", "p").first()
    assert (row["RMSE"], row["MAE"], row["R2"], row["N"]) == (10.0, 10.0, 0.995, 5)
    assert row["MAPE"] == round(np.mean([10 / v for v in y]) * 100, 4)
    zeros = spark.createDataFrame([(0.0, 5.0), (100.0, 110.0), (0.0, 0.0), (200.0, 190.0)], "y double, p double")
    row = metrics.metrics_by(zeros, [], "y", "p", prefix="val_").first()
    assert row["val_MAPE"] == 7.5
    assert row["val_SMAPE"] == round((200 + 200 * 10 / 210 + 200 * 10 / 390) / 3, 4)
    flat = metrics.metrics_by(zeros.where("y = 0"), [], "y", "p").first()
    assert flat["MAPE"] is None and flat["R2"] is None


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    tiny, huge = 5e-324, 1.7e308
    pdf = pd.concat(
        [
            pd.DataFrame({"g": 1, "v": rng.lognormal(0, 3, 6000)}),
            pd.DataFrame({"g": 2, "v": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000))}),
            pd.DataFrame({"g": 3, "v": [4.0]}),
            pd.DataFrame({"g": 4, "v": rng.integers(0, 5, 29).astype(float)}),
            pd.DataFrame({"g": 5, "v": [-huge, -tiny, -0.0, 0.0, tiny, 1.0, np.nextafter(1.0, 2.0), np.nextafter(1.0, 0.0), huge]}),
            pd.DataFrame({"g": 6, "v": np.exp2(rng.uniform(-1000, 1000, 900)) * rng.choice([-1, 1], 900)}),
            pd.DataFrame({"g": 7, "v": 1.0 + np.arange(400) * 2.0**-52}),
            pd.DataFrame({"g": None, "v": [3.0, 1.0, 2.0]}),
        ]
    )
    qs = {"low": 0.05, "mid": 0.5, "high": 0.95, "first": 0.0, "last": 1.0}
    data = frame(spark, pdf).unionByName(spark.createDataFrame([(8.0, None), (1.0, None)], "g double, v double"))
    out = exact_quantiles(data, ["g"], "v", qs).toPandas().set_index("g")
    assert len(out) == 8
    for g, group in pdf.groupby("g", dropna=False):
        assert out.loc[g, "n"] == len(group)
        for name, q in qs.items():
            ordered, h = np.sort(group["v"].to_numpy()), (len(group) - 1) * q
            lo, hi = ordered[int(np.floor(h))], ordered[int(np.ceil(h))]
            assert out.loc[g, name] == lo + (hi - lo) * (h - np.floor(h)), (g, name)


def test_one_hot_group_is_counted_by_many_tasks(spark):
    """A million distinct values of one group: no window or sort sees them, and what a task hands on is a histogram."""
    values = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).cast("double").alias("v"))
    out = exact_quantiles(values, ["g"], "v", {"mid": 0.5, "high": 0.999})
    want = np.sort((np.arange(1_000_000) * 7919) % 1_000_003)
    row = out.first()
    assert (row["n"], row["mid"]) == (1_000_000, (want[499_999] + want[500_000]) / 2) and row["high"] == pytest.approx(np.quantile(want, 0.999), rel=1e-15)


def test_autocorrelation_and_season(spark, hourly):
    pdf = hourly.copy()
    pdf.loc[10:12, "LOAD"] = np.nan
    indexed = profile.indexed_target(frame(spark, pdf), LOOSE, "LOAD")
    got = {r["lag"]: r["acf"] for r in profile.acf(indexed, LOOSE, "LOAD").collect()}
    series = pdf["LOAD"].dropna().reset_index(drop=True)
    assert sorted(got) == [k for k in profile.ACF_LAGS if k <= len(series) // 4]
    for k, v in got.items():
        assert v == pytest.approx(series.autocorr(k), abs=6e-5)
    season = profile.seasonality(profile.acf(indexed, LOOSE, "LOAD"), ["series"]).first()
    assert season["has_daily"] and season["acf_168"] == 0.0
    flat = pdf.assign(LOAD=1.0)
    flat_rows = profile.acf(profile.indexed_target(frame(spark, flat), LOOSE, "LOAD"), LOOSE, "LOAD", [1, 600])
    assert [(r["lag"], r["acf"]) for r in flat_rows.collect()] == [(1, 0.0)]


@pytest.mark.parametrize(("slope", "label"), [(1.0, "strong up"), (-0.3, "weak down"), (0.0, "none")])
def test_trend(spark, slope, label):
    pdf = pd.DataFrame({"series": 1, "ts": pd.date_range("2020-01-01", periods=100, freq="h")})
    pdf["LOAD"] = 200 + slope * np.arange(100)
    row = profile.trend(profile.indexed_target(frame(spark, pdf), SMALL, "LOAD"), SMALL, "LOAD").first()
    assert row["trend_slope"] == pytest.approx(slope) and row["trend_strength"] == label


@pytest.mark.parametrize(
    ("freq", "label"), [("30s", "30 seconds"), ("15min", "15 minutes"), ("h", "60 minutes"), ("6h", "6 hours"), ("7D", "7 days")]
)
def test_frequency_labels(spark, freq, label):
    pdf = pd.DataFrame({"series": 1, "ts": pd.date_range("2020-01-01", periods=40, freq=freq), "LOAD": 1.0})
    assert profile.sampling_frequency(frame(spark, pdf), LOOSE).first()["frequency"] == label


def test_describe_new_columns(spark, hourly):
    before = frame(spark, hourly)
    after = apply_recipes(before, SMALL, lag_recipes("LOAD", [24]))
    row = profile.describe_new_columns(before, after).first()
    expected = hourly["LOAD"].shift(24).describe()
    assert row["column"] == "LOAD_lag_24" and row["null_ratio"] == round(24 / 500, 4)
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q75", "75%"), ("max", "max")):
        assert row[ours] == pytest.approx(expected[theirs])
    assert profile.describe_new_columns(before, before).columns == ["message"]


IMPORTANCE = [("lag_1", 1.5e6), ("lag_24", 8e5), ("hour", 3e5), ("temp", 2e5), ("f5", 1e5), ("f6", 5e4), ("f7", 2e4), ("f8", 1e4), ("f9", 5e3), ("f10", 1e3), ("is_weekend", 500.0)]


def test_importance_reports(spark):
    table = spark.createDataFrame(IMPORTANCE, "feature string, importance_gain double")
    top, bottom = profile.importance_top(table).collect(), profile.importance_bottom(table).collect()
    assert [r["feature"] for r in top] == [f for f, _ in IMPORTANCE[:10]]
    assert {r["feature"] for r in bottom} == {f for f, _ in IMPORTANCE[1:]}
    assert top[0]["norm_pct"] == round(1.5e6 / sum(g for _, g in IMPORTANCE) * 100, 2)
    few = spark.createDataFrame([("a", 5.0), ("b", 0.0)], table.schema)
    assert {r["feature"] for r in profile.importance_bottom(few).collect()} == {"a", "b"}


def test_history_prefers_the_largest_drop(spark):
    rows = [("r", 0, "RMSE", 10.0), ("r", 1, "RMSE", 8.5), ("r", 2, "RMSE", 8.2), ("r", 1, "MAE", 6.7), ("r", 2, "MAE", 6.5)]
    deltas = metrics.metric_deltas(spark.createDataFrame(rows, "run string, iteration int, metric string, value double"), ["run"])
    best = profile.best_iteration(deltas, ["run"]).first()
    assert (best["best_iteration"], best["best_delta"]) == (1, -1.5)
    wide = spark.createDataFrame(
        [("r", i, v, v, 3, 1, ["a", "b", "c", "d", "e", "f"]) for i, v in enumerate((10.0, 8.5, 8.4995, 8.4))],
        "run string, iteration int, RMSE double, MAE double, proposed int, skipped int, added array<string>",
    )
    ctx = {r["iteration"]: r for r in iteration_context(wide, ["run"]).collect()}
    assert [ctx[i]["stop"] for i in range(4)] == [False, False, True, False]
    assert ctx[1]["previous_features"] == ["b", "c", "d", "e", "f"] and ctx[0]["previous_features"] == []
    line = [r for r in history_summary(wide, ["run"]).collect() if r["iteration"] == 1][0]
    assert line["metrics_delta"] == "RMSE:-1.5000, MAE:-1.5000" and line["added_cols"] == "a, b, c, d, e"


def test_dataset_profile(spark, hourly):
    table = spark.createDataFrame(IMPORTANCE, "feature string, importance_gain double")
    row = dataset_profile(frame(spark, hourly), SMALL, "LOAD", ["temp"], table, {"RMSE": 8.53}, name="demo").first()
    assert (row["n_samples"], row["frequency"], row["has_daily"], row["dataset_name"]) == (500, "60 minutes", True, "demo")
    assert row["target_q05"] == pytest.approx(hourly["LOAD"].quantile(0.05))
    assert row["target_cv"] == round(hourly["LOAD"].std() / hourly["LOAD"].mean(), 4)
    assert row["acf_summary"][24] == pytest.approx(hourly["LOAD"].autocorr(24), abs=6e-5)
    assert len(row["top10_features"]) == 10 and row["val_metrics"] == {"RMSE": 8.53}


def test_dataset_profile_equals_its_parts_for_every_series(spark):
    """A series without a key, one of five rows, one without values and one with holes and a row without a time."""
    rng, start = np.random.default_rng(3), datetime(2020, 1, 1)
    rows = [(None, start + timedelta(hours=h), float(rng.normal(50, 5) + h / 10)) for h in range(120)]
    rows += [(1, start + timedelta(hours=h), float(h)) for h in range(5)]
    rows += [(2, start + timedelta(hours=h), None) for h in range(4)]
    rows += [(3, start + timedelta(minutes=30 * h), None if h % 7 == 3 else float(rng.normal(9, 1))) for h in range(200)] + [(3, None, 4.0)]
    df = spark.createDataFrame(rows, "series int, ts timestamp_ntz, LOAD double")
    s = Series(chunk=50)
    got = {r["series"]: r for r in dataset_profile(df, s, "LOAD", []).collect()}
    assert {k: r["n_samples"] for k, r in got.items()} == {None: 120, 1: 5, 2: 4, 3: 201}
    indexed = profile.indexed_target(df, s, "LOAD")
    lags = profile.acf(indexed, s, "LOAD")
    for part in (profile.sampling_frequency(df, s).drop("n_steps"), profile.target_stats(df, ["series"], "LOAD").drop("n"),
                 profile.trend(indexed, s, "LOAD").drop("relative_change"), profile.seasonality(lags, ["series"])):
        for r in part.collect():
            whole = got[r["series"]]
            for c in part.columns[1:]:
                close = r[c] is not None and isinstance(r[c], float)
                assert whole[c] == (pytest.approx(r[c]) if close else r[c]), (r["series"], c)
    for key in (None, 1, 3):
        assert got[key]["acf_summary"] == {r["lag"]: r["acf"] for r in lags.where(F.col("series").eqNullSafe(F.lit(key))).collect()}
    assert (got[2]["acf_summary"], got[2]["target_mean"], got[2]["target_cv"], got[2]["frequency"]) == (None, None, 0.0, "60 minutes")


def test_proposals_follow_the_rules(spark):
    rows = spark.createDataFrame([(0, 12, -0.6), (0, 23, 0.9), (0, 48, 0.7), (0, 168, 0.55)], "scope int, lag int, acf double")
    top = spark.createDataFrame([(0, 1, "temp"), (0, 2, "lag_1"), (0, 3, "hour")], "scope int, rank int, feature string")
    got = pandas_of(propose_features(rows, top, ["hour", "lag_1", "lag_12", "lag_24", "ts_hour_sin"], ["scope"]), "pos")
    # lag 23 is next to lag 24; the rolling family is missing; at most five
    assert got["name"].tolist() == ["LOAD_rolling_24_mean", "LOAD_lag_48", "LOAD_lag_168", "LOAD_rolling_23_mean", "LOAD_rolling_48_mean"]
    full = ["hour", "lag_1", "lag_12", "lag_24", "lag_48", "lag_168", "rolling_mean_23_load", "rolling_mean_48_load", "rolling_mean_168_load", "ts_hour_sin"]
    rest = pandas_of(propose_features(rows, top, full, ["scope"]), "pos")
    assert rest["name"].tolist() == ["lag_1_minus_lag_12", "temp_multiply_lag_1", "temp_multiply_hour", "lag_1_multiply_hour"]


def test_weak_features_get_other_windows_and_a_small_gain_changes_the_kind(spark):
    rows = spark.createDataFrame([(0, 48, 0.7), (1, 48, 0.7)], "scope int, lag int, acf double")
    top = spark.createDataFrame([], "scope int, rank int, feature string")
    names = ["LOAD_rolling_10_std", "rolling_max_3_load", "temp_lag_24", "LOAD_rolling_96_min", "w1_rolling_8_mean"]
    weak = spark.createDataFrame([(s, i, n) for s in (0, 1) for i, n in enumerate(names, 1)], "scope int, rank int, feature string")
    last = spark.createDataFrame([(0, 0.3, ["rolling"]), (1, 0.009, ["lag", "rolling"])], "scope int, gain double, kinds array<string>")
    features = ["lag_1", "LOAD_rolling_48_mean", "ts_hour_sin", *names]
    got = propose_features(rows, top, features, ["scope"], weakest=weak, last=last).orderBy("scope", "pos").collect()
    want = ["LOAD_lag_48", "LOAD_rolling_20_std", "LOAD_rolling_5_std", "LOAD_rolling_6_max", "LOAD_rolling_192_min"]
    # half of 3 is no window, half of 96 is there; of two stale kinds the order stays
    assert [r["name"] for r in got] == [*want, *want]
    cross = spark.createDataFrame([(1, 1, "temp"), (1, 2, "hour")], "scope int, rank int, feature string")
    got = propose_features(rows, cross, features, ["scope"], weakest=weak, last=last).where("scope = 1").orderBy("pos").collect()
    assert [r["type"] for r in got] == ["cross", "lag", "rolling", "rolling", "rolling"]


def test_history_takes_a_round_once(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("b", 1, 7.0)], "run string, iteration int, RMSE double")
    sinks.append_history(rows, path, ["run"])
    again = spark.createDataFrame([("a", 2, 3.5), ("a", 3, 3.0)], "run string, iteration int, RMSE double")
    for _ in range(2):
        sinks.append_history(again, path, ["run"])
    got = sorted((r["run"], r["iteration"], r["RMSE"]) for r in spark.read.schema(rows.schema).parquet(path).collect())
    assert got == [("a", 1, 5.0), ("a", 2, 3.5), ("a", 3, 3.0), ("b", 1, 7.0)]


def test_sinks_round_trip(spark, tmp_path):
    pred = spark.createDataFrame([(1, 10.0, 12.5)], "k int, y double, p double")
    sinks.write_predictions(pred, str(tmp_path / "p"), ["k"], "y", "p")
    row = spark.read.parquet(str(tmp_path / "p")).first()
    assert (row["error"], row["abs_error"]) == (-2.5, 2.5)
    best = spark.createDataFrame([(5, 5.749, i, f"f{i}") for i in range(3)], "iteration int, rmse double, pos int, feature string")
    sinks.write_best_features(best, str(tmp_path / "b"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert text == ["# best feature set (iteration 5)", "# val RMSE: 5.749", "# number of features: 3", "", "f0", "f1", "f2"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_metrics_json(pred, str(tmp_path / "p"))
    table = spark.createDataFrame(IMPORTANCE, "feature string, importance_gain double")
    sinks.write_importance(table, str(tmp_path / "i"))
    back = spark.read.option("header", True).csv(str(tmp_path / "i")).agg(F.sum(F.col("importance_gain_norm").cast("double"))).first()[0]
    assert math.isclose(back, 100)


def test_short_series_keep_a_row(spark):
    df = spark.sql("SELECT s AS series, timestamp_ntz'2020-01-01' + make_dt_interval(0, CAST(i AS INT)) AS ts, CAST(i * i AS DOUBLE) AS LOAD"
                   " FROM VALUES ('short', 1), ('short', 2), ('long', 0) AS t(s, n) LATERAL VIEW explode(sequence(1, IF(s = 'long', 60, n))) x AS i").distinct()
    got = profile.acf(profile.indexed_target(df, SMALL, "LOAD"), SMALL, "LOAD").collect()
    assert [(r["lag"], r["acf"]) for r in got if r["series"] == "short"] == [(1, None)]
    assert all(r["acf"] is not None for r in got if r["series"] == "long") and len(got) > 2


def test_new_text_columns_have_counts_only(spark):
    before = spark.createDataFrame([(1,), (2,)], "a int")
    after = before.withColumn("word", F.when(F.col("a") == 1, "x")).withColumn("b", F.col("a") * 2)
    got = {r["column"]: r for r in profile.describe_new_columns(before, after).collect()}
    assert (got["word"]["count"], got["word"]["mean"], got["word"]["q50"]) == (1, None, None) and got["b"]["mean"] == 3

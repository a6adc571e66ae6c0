"""Rows with NULL keys or times, and series without training rows, go through every ordered operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import LOOSE, SMALL
from tidegrid.operators.clean import fill_forward, fill_interpolate
from tidegrid.operators.features import generate_lag_features, generate_rolling_features
from tidegrid.operators.layout import Series, chunk_of, fitted, index_rows, slot_of
from tidegrid.operators.scale import fit_scaler
from tidegrid.operators.split import split_timeseries
from tidegrid.session import configure

SCHEMA = "series string, ts timestamp_ntz, LOAD double"


def rows(spark):
    """120 hours of two series (one with a NULL name), a series of one row, and rows without a time."""
    hours = spark.range(120).select((F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), F.col("id").cast("double").alias("LOAD"))
    both = hours.select(F.lit("a").alias("series"), "ts", "LOAD").union(hours.select(F.lit(None).cast("string"), "ts", F.col("LOAD") + 1000))
    odd = spark.sql("""SELECT * FROM VALUES ('one', timestamp_ntz'2020-01-01', 5D), ('a', CAST(NULL AS timestamp_ntz), 7D),
        (CAST(NULL AS string), NULL, 8D), ('none', NULL, CAST(NULL AS double)) AS t(series, ts, LOAD)""")
    return both.union(odd)


@pytest.mark.parametrize("s", [SMALL, LOOSE])
def test_ordered_operators_keep_all_rows(spark, s):
    df = rows(spark)
    n = df.count()
    lagged = generate_lag_features(df, s, "LOAD", [1, 24])
    assert lagged.count() == n
    nulls = lagged.where("series IS NULL AND ts IS NOT NULL").orderBy("ts").collect()
    assert [r.LOAD_lag_1 for r in nulls] == [None, *(1000.0 + i for i in range(119))]  # over chunk borders
    assert lagged.where("ts IS NULL AND LOAD_lag_1 IS NULL").count() == 3
    rolled = generate_rolling_features(df, s, "LOAD", [5], ["mean"])
    assert rolled.count() == n and rolled.where("ts IS NULL AND LOAD_rolling_5_mean IS NULL").count() == 3


@pytest.mark.parametrize("fill", [fill_forward, fill_interpolate])
def test_fills_keep_all_rows_and_reach_over_chunks(spark, fill):
    df = rows(spark).withColumn("LOAD", F.when(F.pmod(F.hour("ts"), F.lit(6)) != 3, F.col("LOAD")).when(F.col("ts").isNull(), F.col("LOAD")))
    for s in (SMALL, LOOSE):
        out = fill(df, s, ["LOAD"])
        assert out.count() == df.count()
        assert out.where("series IS NULL AND LOAD IS NULL").count() == 0
        assert out.where("ts IS NULL").orderBy(F.desc_nulls_last("LOAD")).collect()[0].LOAD == 8.0


def test_split_keeps_rows_without_time(spark):
    df = rows(spark)
    for method in ("sequential", "yearly"):
        out = split_timeseries(df, LOOSE, method=method)
        assert out.count() == df.count()
        assert out.where("ts IS NULL AND split IS NULL").count() == 3
        assert {r.split: r["count"] for r in out.where("series IS NULL AND ts IS NOT NULL").groupBy("split").count().collect()} == {"train": 84, "val": 18, "test": 18}


def test_scaler_keeps_series_without_training_rows(spark):
    df = spark.createDataFrame([("a", "train", 1.0), ("a", "train", 3.0), ("a", "test", 5.0), (None, "train", 2.0), ("b", "test", 9.0)], "series string, split string, LOAD double")
    for kind in ("standard", "minmax"):
        scaler = fit_scaler(df, ["series"], ["LOAD"], kind)
        got = scaler.transform(df, "_s").collect()
        assert len(got) == 5 and [r.LOAD_s for r in got if r.series == "b"] == [None] and [r.LOAD_s for r in got if r.series is None] == [0.0]
        assert scaler.inverse(scaler.transform(df)).where("series = 'a'").agg(F.sum("LOAD")).first()[0] == pytest.approx(9.0)


def test_scratch_tables_go_with_their_scope(spark):
    from pathlib import Path

    from tidegrid.session import materialize, scratch_scope

    kept = materialize(spark.range(3), "outer")
    with scratch_scope(spark):
        inner = materialize(kept.selectExpr("id + 1 AS id"), "inner")
        path = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert inner.count() == 3 and path.exists()
    assert not path.exists() and kept.count() == 3


def test_chunks_of_data_denser_than_the_step(spark):
    """Second by second, in bursts, or all at once: chunks stay small as long as times can be told apart, numbers are exact."""
    s = Series(keys=("k",), step=3600, chunk=500)
    dense = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    burst = spark.range(6_000).select(F.lit(2).alias("k"), F.when(F.col("id") < 5_000, F.floor(F.col("id") / 50)).otherwise(F.col("id") * 3600).alias("at"))
    df = dense.unionByName(burst).select("k", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "at")
    finer = fitted(df, s)
    sizes = df.groupBy("k", chunk_of(slot_of(finer), finer.chunk).alias("c")).count().agg(F.max("count")).first()[0]
    assert sizes <= 1000 < 20_000 and finer.step < s.step
    numbered = index_rows(df, finer, "n").where("k = 1")
    assert numbered.count() == numbered.where("n = at").count() == 20_000
    once = df.withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz"))
    assert fitted(once, s) == s and fitted(df.where("false"), s) == s


@pytest.mark.parametrize(("partitions", "first"), [("4", 200), ("300", 300)])
def test_shuffles_begin_with_many_partitions(spark, partitions, first):
    """A task's share doesn't depend on a small number of shuffle partitions; a larger one is kept."""
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", partitions)
    configure(other)
    df = other.range(100).selectExpr("id % 3 AS series", "timestamp_ntz '2020-01-01' + make_dt_interval(0, int(id)) AS ts", "if(id % 5 = 0, null, double(id)) AS LOAD")
    plan = fill_interpolate(df, SMALL, ["LOAD"])._jdf.queryExecution().executedPlan().toString()
    assert f", {first})" in plan and ", 4)" not in plan

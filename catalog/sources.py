"""Files in and out. The files are written from the tables to the shared folder first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import (
    EVENT_TYPES,
    HOURLY,
    PANEL_SQL,
    R,
    STATIONS,
    SYSTEM_SQL,
    TYPES_SQL,
    by_type,
    panel,
    query,
    r,
    rounded,
    system,
    table,
)
from catalog.profiles import (
    GAINS_SQL,
    HISTORY_SQL,
    METRIC_SQL,
    gains,
    history_long,
)
from catalog.timestamps import HOUR_RAW, candidates_sql, resolve_sql
from tidegrid.operators import metrics, profile
from tidegrid.operators.features import generate_lag_features
from tidegrid.session import materialize, scratch_path
from tidegrid.sources import csv_tasks, sinks

_MEASURES = ("LOAD", *STATIONS)


def _write_train(df, path: str) -> None:
    """One training file (a folder of ordered parts). Missing values are written as unreadable text."""
    rows = df.select(
        F.col("series").alias("ZONEID"),
        F.expr(HOUR_RAW).alias("TIMESTAMP"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in _MEASURES],
        "ts",
    )
    ordered = rows.repartitionByRange("ts").sortWithinPartitions("ts").drop("ts")
    ordered.write.option("header", True).csv(path)


def _solved_sql(source: str) -> str:
    return f"""raws AS (SELECT *, {HOUR_RAW} AS raw, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM {source}),
    {candidates_sql('(SELECT * EXCLUDE (ts) FROM raws)', 'cand')}, {resolve_sql('cand', 'solved')}"""


_COLS = ", ".join(_MEASURES)


@query(
    "scan_train_csv",
    f"WITH {SYSTEM_SQL}, {_solved_sql('sys')} SELECT 0 AS task_id, ts, CAST(series AS INTEGER) AS ZONEID, {_COLS} FROM solved WHERE ts IS NOT NULL",
)
def scan_train_csv(spark, sf):
    path = scratch_path(spark, "train")
    _write_train(system(spark, sf), path)
    return csv_tasks.scan_train_csv(spark, path, STATIONS)


@query(
    "scan_all_tasks",
    f"WITH {TYPES_SQL}, {_solved_sql('typed')} SELECT CAST(series AS INTEGER) AS task_id, ts, CAST(series AS INTEGER) AS ZONEID, {_COLS} FROM solved WHERE ts IS NOT NULL",
)
def scan_all_tasks(spark, sf):
    """One task per event type (the other task numbers are absent), read by a single scan."""
    folder = scratch_path(spark, "tasks")
    rows = materialize(by_type(spark, sf), "typed")  # the readings are aggregated once for all tasks
    for task in range(1, len(EVENT_TYPES) + 1):
        _write_train(rows.where(F.col("series") == task), f"{folder}/Task {task}/L{task}-train.csv")
    return csv_tasks.scan_all_tasks(spark, folder, STATIONS)


@query("scan_solution", f"WITH {SYSTEM_SQL} SELECT ts, {_COLS} FROM sys")
def scan_solution(spark, sf):
    path = scratch_path(spark, "solution")
    date = F.concat_ws("/", F.month("ts"), F.dayofmonth("ts"), F.year("ts"))
    rows = system(spark, sf).select(
        date.alias("date"), F.hour("ts").alias("hour"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _MEASURES]
    )
    rows.write.option("header", True).csv(path)
    return csv_tasks.scan_solution(spark, path, STATIONS)


@query(
    "sink_predictions",
    f"""WITH {PANEL_SQL}, f AS (SELECT series, ts, LOAD AS actual, lag(LOAD, 1) OVER (PARTITION BY series ORDER BY ts) AS prediction FROM panel)
        SELECT series, ts, actual, prediction, {R('actual - prediction', 4)} AS error, {R('abs(actual - prediction)', 4)} AS abs_error
        FROM f WHERE actual IS NOT NULL AND prediction IS NOT NULL""",
)
def sink_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    df = generate_lag_features(panel(spark, sf).select("series", "ts", "LOAD"), HOURLY, "LOAD", [1])
    sinks.write_predictions(df.na.drop(), path, ["series", "ts"], "LOAD", "LOAD_lag_1")
    return rounded(spark.read.parquet(path), "error", "abs_error", digits=4)


@query(
    "sink_metrics_json",
    f"""SELECT l_suppkey, {R(METRIC_SQL['rmse'])} AS RMSE, {R(METRIC_SQL['mae'])} AS MAE, count(*) AS N, min(d) AS first_ts, max(d) AS last_ts
        FROM (SELECT l_suppkey, l_discount AS y, l_tax AS p, l_shipdate AS d FROM lineitem) GROUP BY l_suppkey""",
)
def sink_metrics_json(spark, sf):
    """One JSON record per supplier: errors, row count and time range."""
    path = scratch_path(spark, "metrics")
    record = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        r(metrics.rmse("l_discount", "l_tax")).alias("RMSE"),
        r(metrics.mae("l_discount", "l_tax")).alias("MAE"),
        F.count(F.lit(1)).alias("N"),
        F.min("l_shipdate").alias("first_ts"),
        F.max("l_shipdate").alias("last_ts"),
    )
    sinks.write_metrics_json(record, path)
    return spark.read.schema(record.schema).json(path)


@query(
    "sink_importance",
    f"WITH {GAINS_SQL} SELECT feature, importance_gain, {R('importance_gain_norm')} AS importance_gain_norm FROM shares",
)
def sink_importance(spark, sf):
    path = scratch_path(spark, "importance")
    sinks.write_importance(gains(spark, sf), path)
    schema = "feature string, importance_gain double, importance_gain_norm double"
    return rounded(spark.read.schema(schema).option("header", True).csv(path), "importance_gain_norm")


@query("sink_history", f"WITH {HISTORY_SQL} SELECT * REPLACE ({R('value')} AS value) FROM hlong")
def sink_history(spark, sf):
    """Three appends: the months before 1999, the rest, and the rest once more, as a retry would."""
    path = scratch_path(spark, "history")
    rows = history_long(spark, sf)
    border = 1999 * 12
    sinks.append_history(rows.where(F.col("iteration") <= border), path)
    for _ in range(2):
        sinks.append_history(rows.where(F.col("iteration") > border), path)
    return rounded(spark.read.schema(rows.schema).parquet(path), "value")


@query(
    "sink_best_features",
    f"""WITH {GAINS_SQL}, best AS (SELECT feature FROM shares ORDER BY importance_gain DESC, feature LIMIT 10),
        n AS (SELECT count(*) AS n, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))) + 1.3e-8, 4) AS rmse FROM lineitem) SELECT feature AS value FROM best
        UNION ALL SELECT '# best feature set (iteration ' || CAST(n AS VARCHAR) || ')' FROM n UNION ALL SELECT '# val RMSE: ' || CAST(rmse AS VARCHAR) FROM n
        UNION ALL SELECT '# number of features: 10' UNION ALL SELECT ''""",
)
def sink_best_features(spark, sf):
    """The ten strongest features in order of their gain as a text report, with the error of a discount forecast by the
    tax; the iteration number is the number of items."""
    path = scratch_path(spark, "best")
    top = profile.importance_top(gains(spark, sf))  # ten rows
    of = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("iteration"), r(metrics.rmse("l_discount", "l_tax"), 4).alias("rmse"))
    pos = F.row_number().over(Window.orderBy(F.col("gain").desc(), "feature"))
    best = top.crossJoin(F.broadcast(of)).select("iteration", "rmse", pos.alias("pos"), "feature")
    sinks.write_best_features(best, path)
    return spark.read.text(path)

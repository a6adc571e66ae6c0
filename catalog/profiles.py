"""Errors of forecasts, profiles of series, importance reports and iteration history."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.base import (
    DAILY,
    DAILY_SQL,
    HOURLY,
    PANEL_SQL,
    R,
    STATIONS,
    TYPES_SQL,
    by_type,
    daily_orders,
    panel,
    query,
    r,
    rounded,
    table,
)
from catalog.windows import PREPARED_SQL, prepared
from tidegrid.functions.arithmetic import acf_bar
from tidegrid.operators import metrics, profile
from tidegrid.operators.features import apply_recipes, lag_recipes, rolling_recipes
from tidegrid.plans.context import dataset_profile, history_summary, iteration_context

LOOSE = replace(HOURLY, complete=False)

# ---- metrics: discount as the actual value, tax as the forecast, per supplier ------------------


def _pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_discount", "l_tax")


METRIC_SQL = {
    "rmse": "sqrt(avg((y - p) * (y - p)))",
    "mae": "avg(abs(y - p))",
    "mape": "avg(CASE WHEN abs(y) > 1e-8 THEN abs((y - p) / y) END) * 100",
    "smape": "avg(CASE WHEN abs(y) + abs(p) > 1e-8 THEN 200 * abs(y - p) / (abs(y) + abs(p)) END)",
    "r2": "CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END",
}
_PAIR_SQL = "(SELECT l_suppkey, l_discount AS y, l_tax AS p FROM lineitem)"


def _metric(name: str):
    def run(spark, sf):
        value = getattr(metrics, name)("l_discount", "l_tax")
        return _pairs(spark, sf).groupBy("l_suppkey").agg(r(value).alias(name))

    return run


for _m, _sql in METRIC_SQL.items():
    query(f"metric_{_m}", f"SELECT l_suppkey, {R(_sql)} AS {_m} FROM {_PAIR_SQL} GROUP BY l_suppkey")(_metric(_m))


def _all_metrics_sql(prefix: str = "") -> str:
    return ", ".join(f"round({s}, 4) AS {prefix}{n.upper()}" for n, s in METRIC_SQL.items()) + f", count(y) AS {prefix}N"


@query(
    "metrics_all",
    f"""WITH {PREPARED_SQL} SELECT split, {_all_metrics_sql()} FROM (SELECT split, LOAD AS y, lag_24 AS p FROM prepared)
        GROUP BY split""",
)
def metrics_all(spark, sf):
    """All metrics of the naive day-before forecast on the prepared table."""
    return metrics.metrics_by(prepared(spark, sf).data, ["split"], "LOAD", "lag_24")


@query(
    "pred_actual",
    f"""WITH {PANEL_SQL}, shifted AS (SELECT series, ts + INTERVAL 24 HOUR AS ts, LOAD AS prediction FROM panel WHERE LOAD IS NOT NULL)
        SELECT p.series, p.ts, p.LOAD, s.prediction, {R('p.LOAD - s.prediction', 4)} AS error,
        {R('abs(p.LOAD - s.prediction)', 4)} AS abs_error FROM panel p JOIN shifted s ON s.series = p.series AND s.ts = p.ts
        WHERE p.LOAD IS NOT NULL""",
)
def pred_actual(spark, sf):
    """A separate forecast table (value of the day before) matched with the actual values."""
    known = panel(spark, sf).select("series", "ts", "LOAD").where(F.col("LOAD").isNotNull())
    day = F.expr("interval 24 hours")
    forecast = known.select("series", (F.col("ts") + day).alias("ts"), F.col("LOAD").alias("prediction"))
    out = metrics.pair_predictions(forecast, known, ["series", "ts"], "LOAD", "prediction")
    return rounded(out.select("series", "ts", "LOAD", "prediction", "error", "abs_error"), "error", "abs_error", digits=4)


# ---- profiles ------------------------------------------------------------------------------------


@query(
    "target_stats",
    """SELECT l_suppkey, n, {m} AS target_mean, {s} AS target_std, target_min, target_max, {a} AS target_q05, {b} AS target_q95,
       round(sd / mu, 4) AS target_cv FROM (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS mu, stddev_samp(l_extendedprice) AS sd,
       min(l_extendedprice) AS target_min, max(l_extendedprice) AS target_max, quantile_cont(l_extendedprice, 0.05) AS q05,
       quantile_cont(l_extendedprice, 0.95) AS q95 FROM lineitem GROUP BY l_suppkey)""".format(
        m=R("mu", 4), s=R("sd", 4), a=R("q05", 4), b=R("q95", 4)
    ),
)
def target_stats(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    out = profile.target_stats(rows, ["l_suppkey"], "l_extendedprice")
    return rounded(out, "target_mean", "target_std", "target_q05", "target_q95", digits=4)


def _dense(spark, sf):
    return panel(spark, sf).select("series", "ts", F.coalesce("LOAD", F.lit(0.0)).alias("load0"))


_LAGS = (1, 2, 3, 6, 12, 24, 48, 72, 168, 336)


def acf_sql(source: str, name: str, value: str) -> str:
    """CTEs ending in ``name(series, lag, acf)`` over the non-missing rows of ``source``."""
    lagged = ", ".join(f"lag(v, {k}) OVER (PARTITION BY series ORDER BY ts) AS l{k}" for k in _LAGS)
    corr = ", ".join(f"corr(v, l{k}) AS c{k}" for k in _LAGS)
    lists = ", ".join(f"c{k}" for k in _LAGS)
    return f"""
    {name}_v AS (SELECT series, ts, {value} AS v, count(*) OVER (PARTITION BY series) AS n FROM {source} WHERE {value} IS NOT NULL),
    {name}_l AS (SELECT *, {lagged} FROM {name}_v),
    {name}_c AS (SELECT series, max(n) AS n, {corr} FROM {name}_l GROUP BY series),
    {name}_u AS (SELECT series, n, unnest({list(_LAGS)}) AS lag, unnest([{lists}]) AS c FROM {name}_c),
    {name} AS (SELECT series, lag, round(CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END, 4) + CAST(0 AS DOUBLE) AS acf FROM {name}_u
               WHERE n >= 10 AND lag <= n // 4)"""


_DENSE_SQL = PANEL_SQL + ", dense AS (SELECT series, ts, coalesce(LOAD, 0) AS load0 FROM panel)"


@query("acf", f"WITH {_DENSE_SQL}, {acf_sql('dense', 'a', 'load0')} SELECT * FROM a")
def acf(spark, sf):
    return profile.acf(profile.indexed_target(_dense(spark, sf), HOURLY, "load0"), HOURLY, "load0")


@query(
    "acf_bar",
    f"""WITH {PANEL_SQL}, {acf_sql('panel', 'a', 'LOAD')} SELECT series, lag, acf, CASE WHEN acf = 0 THEN '·' ELSE
        (CASE WHEN acf > 0 THEN '+' ELSE '-' END) || repeat('█', greatest(1, CAST(floor(abs(acf) * 20) AS BIGINT))) END AS bar FROM a""",
)
def acf_bar_(spark, sf):
    """Bars of the correlations over the hours that have a load."""
    rows = panel(spark, sf).select("series", "ts", "LOAD")
    out = profile.acf(profile.indexed_target(rows, LOOSE, "LOAD"), LOOSE, "LOAD")
    return out.withColumn("bar", acf_bar("acf"))


def trend_sql(source: str, name: str, value: str) -> str:
    return f"""
    {name}_v AS (SELECT series, {value} AS v, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS x FROM {source} WHERE {value} IS NOT NULL),
    {name}_f AS (SELECT series, count(*) AS n, avg(v) AS mu, CASE WHEN count(*) >= 10 THEN regr_slope(v, x) ELSE 0 END AS b FROM {name}_v GROUP BY series),
    {name}_r AS (SELECT series, b, CASE WHEN n >= 10 AND mu <> 0 THEN b * n / mu ELSE 0 END AS rel FROM {name}_f),
    {name} AS (SELECT series, round(b, 6) AS trend_slope, round(rel, 6) AS relative_change,
        CASE WHEN abs(rel) > 0.3 THEN 'strong ' || (CASE WHEN b > 0 THEN 'up' ELSE 'down' END)
             WHEN abs(rel) > 0.1 THEN 'weak ' || (CASE WHEN b > 0 THEN 'up' ELSE 'down' END) ELSE 'none' END AS trend_strength FROM {name}_r)"""


@query("trend", f"WITH {PANEL_SQL}, {trend_sql('panel', 't', 'LOAD')} SELECT * FROM t")
def trend(spark, sf):
    rows = panel(spark, sf).select("series", "ts", "LOAD")
    return profile.trend(profile.indexed_target(rows, LOOSE, "LOAD"), LOOSE, "LOAD")


def season_sql(acf_name: str, name: str) -> str:
    return f"""
    {name}_s AS (SELECT series, coalesce(max(CASE WHEN lag = 24 THEN acf END), 0) AS acf_24,
                 coalesce(max(CASE WHEN lag = 168 THEN acf END), 0) AS acf_168 FROM {acf_name} GROUP BY series),
    {name} AS (SELECT *, acf_24 > 0.3 AS has_daily, acf_168 > 0.3 AS has_weekly,
               CASE WHEN greatest(acf_24, acf_168) > 0.7 THEN 'strong' WHEN greatest(acf_24, acf_168) > 0.3 THEN 'medium'
                    WHEN greatest(acf_24, acf_168) > 0.1 THEN 'weak' ELSE 'none' END AS seasonality_strength FROM {name}_s)"""


@query(
    "seasonality",
    f"WITH {_DENSE_SQL}, {acf_sql('dense', 'a', 'load0')}, {season_sql('a', 's')} SELECT * FROM s",
)
def seasonality(spark, sf):
    rows = profile.acf(profile.indexed_target(_dense(spark, sf), HOURLY, "load0"), HOURLY, "load0")
    return profile.seasonality(rows, ["series"])


_NEW = {
    "load0_lag_1": "lag(load0, 1) OVER (PARTITION BY series ORDER BY ts)",
    "load0_lag_24": "lag(load0, 24) OVER (PARTITION BY series ORDER BY ts)",
    "load0_rolling_6_max": "CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ts) >= 6 THEN max(load0) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END",
}


@query(
    "describe_new",
    f"WITH {_DENSE_SQL}, f AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _NEW.items())} FROM dense) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'double' AS dtype, count({c}) AS non_null,
            round(1 - CAST(count({c}) AS DOUBLE) / count(*), 4) AS null_ratio,
            count({c}) AS "count", {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, min({c}) AS "min", {R(f'quantile_cont({c}, 0.25)')} AS q25,
            {R(f'quantile_cont({c}, 0.5)')} AS q50, {R(f'quantile_cont({c}, 0.75)')} AS q75, max({c}) AS "max" FROM f"""
        for c in _NEW
    ),
)
def describe_new(spark, sf):
    before = _dense(spark, sf)
    after = apply_recipes(before, HOURLY, [*lag_recipes("load0", [1, 24]), *rolling_recipes("load0", [6], ["max"])])
    out = profile.describe_new_columns(before, after)
    return rounded(out, "mean", "std", "q25", "q50", "q75")


@query(
    "missing_profile",
    f"WITH {PANEL_SQL} "
    + " UNION ALL ".join(
        f"""SELECT series, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing,
            {R(f"(count(*) - count({c})) * CAST(100 AS DOUBLE) / count(*)", 3)} AS missing_pct FROM panel GROUP BY series"""
        for c in ("LOAD", *STATIONS)
    ),
)
def missing_profile(spark, sf):
    out = profile.missing_profile(panel(spark, sf), ["series"], ["LOAD", *STATIONS])
    pct = r(F.col("missing") * 100.0 / F.col("n_rows"), 3)
    return out.withColumn("missing_pct", pct)


@query(
    "task_profile",
    f"""WITH {PANEL_SQL} SELECT series AS task_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
        count(*) - count(LOAD) AS missing_target FROM panel GROUP BY series""",
)
def task_profile(spark, sf):
    return profile.task_profile(panel(spark, sf).withColumnRenamed("series", "task_id"), "task_id", "ts", "LOAD")


_PROFILE_COLS = ("n_samples", "frequency", "trend_slope", "trend_strength", "acf_24", "acf_168", "has_daily", "has_weekly", "seasonality_strength")


@query(
    "dataset_profile",
    f"""WITH {TYPES_SQL}, {acf_sql('typed', 'a', 'LOAD')}, {trend_sql('typed', 't', 'LOAD')}, {season_sql('a', 's')},
        m AS (SELECT series, count(*) AS n_samples, {R('avg(LOAD)', 4)} AS target_mean, {R('stddev_samp(LOAD)', 4)} AS target_std,
              {R('quantile_cont(LOAD, 0.05)', 4)} AS target_q05, {R('quantile_cont(LOAD, 0.95)', 4)} AS target_q95 FROM typed GROUP BY series)
        SELECT m.series, n_samples, '60 minutes' AS frequency, target_mean, target_std, target_q05, target_q95, trend_slope, trend_strength,
        acf_24, acf_168, has_daily, has_weekly, seasonality_strength, (SELECT acf FROM a WHERE a.series = m.series AND lag = 1) AS acf_1,
        (SELECT count(*) FROM a WHERE a.series = m.series) AS n_acf, 5 AS n_features, 'w5' AS last_feature,
        'click' AS top_feature FROM m JOIN t ON t.series = m.series JOIN s ON s.series = m.series""".replace(
        "'click' AS top_feature",
        "(SELECT event_type FROM events GROUP BY event_type ORDER BY sum(CAST(round(value * 100) AS BIGINT)) DESC, event_type LIMIT 1) AS top_feature",
    ),
)
def dataset_profile_(spark, sf):
    """One line per event type; the importance table is the total value of each type."""
    gains = (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("feature"))
        .agg(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("importance_gain"))
    )
    out = dataset_profile(by_type(spark, sf), HOURLY, "LOAD", list(STATIONS), gains, {"RMSE": 0.0})
    flat = out.select(
        "series",
        *_PROFILE_COLS,
        *[r(c, 4).alias(c) for c in ("target_mean", "target_std", "target_q05", "target_q95")],
        F.col("acf_summary")[1].alias("acf_1"),
        F.size("acf_summary").cast("long").alias("n_acf"),
        "n_features",
        F.element_at("current_features", -1).alias("last_feature"),
        F.col("top10_features")[0]["feature"].alias("top_feature"),
    )
    return flat


# ---- importance reports: gain = discounted value per part ------------------------------------------


def gains(spark, sf):
    cents = F.round(F.col("l_quantity") * F.col("l_discount") * 100).cast("long")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("feature"))
        .agg((F.sum(cents).cast("double") / 100).alias("importance_gain"))
    )


GAINS_SQL = """gains AS (SELECT 'part_' || CAST(l_partkey AS VARCHAR) AS feature,
    CAST(sum(CAST(round(l_quantity * l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 AS importance_gain FROM lineitem GROUP BY l_partkey),
    shares AS (SELECT *, importance_gain / (SELECT sum(importance_gain) FROM gains) * 100 AS importance_gain_norm FROM gains)"""


@query(
    "importance_share",
    f"WITH {GAINS_SQL} SELECT feature, importance_gain, {R('importance_gain_norm')} AS importance_gain_norm FROM shares",
)
def importance_share(spark, sf):
    return rounded(profile.importance_share(gains(spark, sf)), "importance_gain_norm")


_BRIEF_SQL = "feature, round(importance_gain, 1) AS gain, round(importance_gain_norm, 2) AS norm_pct"


@query(
    "importance_top10",
    f"WITH {GAINS_SQL} SELECT {_BRIEF_SQL} FROM shares ORDER BY importance_gain DESC, feature LIMIT 10",
)
def importance_top10(spark, sf):
    return profile.importance_top(gains(spark, sf))


@query(
    "importance_bottom10",
    f"""WITH {GAINS_SQL} SELECT {_BRIEF_SQL} FROM shares WHERE importance_gain > 0 OR
        (SELECT count(*) FROM gains WHERE importance_gain > 0) < 10 ORDER BY importance_gain, feature DESC LIMIT 10""",
)
def importance_bottom10(spark, sf):
    return profile.importance_bottom(gains(spark, sf))


# ---- history: one round per month and supplier -------------------------------------------------------

_MONTH_SQL = "CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER)"


SCALE = 1.0137  # keeps the errors away from exact halves of the fourth decimal


def history_wide(spark, sf):
    """RMSE and MAE per supplier and month, and the return flags seen in that month as columns."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", month.cast("int").alias("iteration"), "l_discount", (F.col("l_tax") * SCALE).alias("p"), "l_returnflag", "l_linestatus"
    )
    return rows.groupBy("l_suppkey", "iteration").agg(
        metrics.rmse("l_discount", "p").alias("RMSE"),
        metrics.mae("l_discount", "p").alias("MAE"),
        F.count(F.lit(1)).alias("proposed"),
        F.count_if(F.col("l_linestatus") == "O").alias("skipped"),
        F.sort_array(F.collect_set("l_returnflag")).alias("added"),
    )


def history_long(spark, sf):
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("RMSE", "MAE")]))
    return history_wide(spark, sf).select("l_suppkey", "iteration", pairs.alias("p")).select("l_suppkey", "iteration", "p.*")


HISTORY_SQL = f"""hist AS (SELECT l_suppkey, iteration, {METRIC_SQL['rmse']} AS RMSE, {METRIC_SQL['mae']} AS MAE, count(*) AS proposed,
    count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS skipped, list_sort(list(DISTINCT l_returnflag)) AS added
    FROM (SELECT *, {_MONTH_SQL} AS iteration, l_discount AS y, l_tax * {SCALE}::DOUBLE AS p FROM lineitem) GROUP BY l_suppkey, iteration),
    hlong AS (SELECT l_suppkey, iteration, 'RMSE' AS metric, RMSE AS value FROM hist
              UNION ALL SELECT l_suppkey, iteration, 'MAE', MAE FROM hist),
    deltas AS (SELECT l_suppkey, iteration, metric, lag(value) OVER w AS before, value AS after,
               round(value - lag(value) OVER w, 4) + CAST(0 AS DOUBLE) AS delta FROM hlong WINDOW w AS (PARTITION BY l_suppkey, metric ORDER BY iteration))"""


@query("metric_delta", f"WITH {HISTORY_SQL} SELECT * REPLACE ({R('before')} AS before, {R('after')} AS after) FROM deltas")
def metric_delta(spark, sf):
    return rounded(metrics.metric_deltas(history_long(spark, sf), ["l_suppkey"]), "before", "after")


@query(
    "best_iteration",
    f"""WITH {HISTORY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY delta, iteration) AS k FROM deltas
        WHERE metric = 'RMSE' AND delta IS NOT NULL) SELECT l_suppkey, iteration AS best_iteration, delta AS best_delta FROM k WHERE k = 1""",
)
def best_iteration(spark, sf):
    return profile.best_iteration(metrics.metric_deltas(history_long(spark, sf), ["l_suppkey"]), ["l_suppkey"])


@query(
    "iteration_context",
    f"""WITH {HISTORY_SQL}, c AS (SELECT l_suppkey, iteration, RMSE, MAE, CAST(row_number() OVER w AS INTEGER) AS round,
        round(RMSE - lag(RMSE) OVER w, 4) + CAST(0 AS DOUBLE) AS rmse_delta, round(MAE - lag(MAE) OVER w, 4) + CAST(0 AS DOUBLE) AS mae_delta,
        flatten(list(added) OVER (PARTITION BY l_suppkey ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prev
        FROM hist WINDOW w AS (PARTITION BY l_suppkey ORDER BY iteration))
        SELECT l_suppkey, iteration, round, {R('RMSE')} AS RMSE, {R('MAE')} AS MAE, rmse_delta, mae_delta, coalesce(array_to_string(prev[-5:], ','), '') AS previous_features,
        coalesce(abs(rmse_delta) < 0.001 AND round >= 3, false) AS stop FROM c""",
)
def iteration_context_(spark, sf):
    out = iteration_context(history_wide(spark, sf), ["l_suppkey"])
    return rounded(out, "RMSE", "MAE").withColumn("previous_features", F.concat_ws(",", "previous_features"))


@query(
    "iteration_history",
    f"""WITH {HISTORY_SQL}, c AS (SELECT *, RMSE - lag(RMSE) OVER w AS d1, MAE - lag(MAE) OVER w AS d2 FROM hist
        WINDOW w AS (PARTITION BY l_suppkey ORDER BY iteration)) SELECT l_suppkey, iteration, proposed, CAST(len(added) AS INTEGER) AS added, skipped,
        CASE WHEN d1 IS NULL THEN '' ELSE printf('RMSE:%+.4f, MAE:%+.4f', round(d1, 4) + CAST(0 AS DOUBLE), round(d2, 4) + CAST(0 AS DOUBLE)) END AS metrics_delta,
        array_to_string(added[1:5], ', ') AS added_cols FROM c""",
)
def iteration_history(spark, sf):
    return history_summary(history_wide(spark, sf), ["l_suppkey"])

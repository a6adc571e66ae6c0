"""Projections, calendar, cross and look-back features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    HOURLY,
    PANEL_SQL,
    R,
    STATIONS,
    fill_sql,
    panel,
    query,
    r,
    rounded,
    table,
)
from tidegrid.functions import arithmetic, calendar
from tidegrid.operators import clean, features
from tidegrid.operators.layout import positions

W5 = ", ".join(STATIONS)


@query(
    "proj_to_numeric",
    """SELECT o_orderkey, try_cast(o_orderpriority AS DOUBLE) AS bad,
              try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS good,
              CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders""",
)
def proj_to_numeric(spark, sf):
    price = F.when(F.col("o_orderstatus") == "F", F.lit("nan")).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        clean.to_numeric("o_orderpriority").alias("bad"),
        clean.to_numeric(F.substring("o_orderpriority", 1, 1)).alias("good"),
        clean.to_numeric(price).alias("price"),
    )


@query("proj_to_datetime", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def proj_to_datetime(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select("event_id", clean.to_datetime(text).alias("ts"))


@query(
    "filter_dropna",
    f"WITH {PANEL_SQL} SELECT series, ts, LOAD, w1 FROM panel WHERE LOAD IS NOT NULL AND w1 IS NOT NULL",
)
def filter_dropna(spark, sf):
    return clean.drop_missing(panel(spark, sf).select("series", "ts", "LOAD", "w1"), ["LOAD", "w1"])


_LIST = f"[x for x in [{W5}] if x IS NOT NULL]"
_ACROSS_SQL = f"""{R(f"list_avg({_LIST})")} AS temp_mean, list_min({_LIST}) AS temp_min,
    list_max({_LIST}) AS temp_max, {R(f"CASE WHEN len({_LIST}) > 1 THEN list_stddev_samp({_LIST}) END")} AS temp_std"""


@query("proj_station_stats", f"WITH {PANEL_SQL} SELECT series, ts, {_ACROSS_SQL} FROM panel")
def proj_station_stats(spark, sf):
    out = arithmetic.add_across(panel(spark, sf), STATIONS)
    return rounded(out.drop("LOAD", *STATIONS), "temp_mean", "temp_std")


@query("proj_temp_alias", f"WITH {PANEL_SQL} SELECT series, ts, w1 AS temp FROM panel")
def proj_temp_alias(spark, sf):
    return panel(spark, sf).select("series", "ts", F.col(STATIONS[0]).alias("temp"))


@query("proj_feature_cols", f"WITH {PANEL_SQL} SELECT {W5} FROM panel")
def proj_feature_cols(spark, sf):
    df = panel(spark, sf).withColumnRenamed("series", "ZONEID")
    return df.select(*features.feature_columns(df, "LOAD", "ts"))


def _cross(op: str, a: str, b: str):
    def run(spark, sf):
        rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", a, b)
        out = features.generate_cross_features(rows, a, b, op)
        return rounded(out, out.columns[-1], digits=4)

    return run


for _id, _op, _a, _b, _word, _sql in (
    ("cross_add", "add", "l_quantity", "l_tax", "plus", "l_quantity + l_tax"),
    ("cross_subtract", "diff", "l_quantity", "l_discount", "minus", "l_quantity - l_discount"),
    ("cross_multiply", "multiply", "l_quantity", "l_tax", "multiply", "l_quantity * l_tax"),
    (
        "cross_divide",
        "ratio",
        "l_extendedprice",
        "l_discount",
        "div",
        "CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END",
    ),
):
    query(
        _id,
        f"SELECT l_orderkey, l_partkey, {_a}, {_b}, {R(_sql, 4)} AS {_a}_{_word}_{_b} FROM lineitem",
    )(_cross(_op, _a, _b))


# ---- calendar ----------------------------------------------------------------------------

_CAL_SQL = {
    "year": "year(ts)",
    "month": "month(ts)",
    "day": "day(ts)",
    "dayofweek": "isodow(ts) - 1",
    "dayofyear": "dayofyear(ts)",
    "hour": "hour(ts)",
    "minute": "minute(ts)",
    "quarter": "quarter(ts)",
    "weekofyear": "weekofyear(ts)",
    "is_weekend": "isodow(ts) >= 6",
    "is_month_start": "day(ts) = 1",
    "is_month_end": "CAST(ts AS DATE) = last_day(ts)",
}


def _cal(names) -> str:
    return ", ".join(f"CAST({_CAL_SQL[n]} AS INTEGER) AS ts_{n}" for n in names)


def _event_times(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts")


def _dates(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_shipdate").alias("ts"))


@query("time_basic", f"SELECT event_id, ts, {_cal(calendar.BASIC)} FROM events")
def time_basic(spark, sf):
    return features.generate_time_features(_event_times(spark, sf), "ts", list(calendar.BASIC), cyclical=False)


@query(
    "time_flags",
    f"SELECT * FROM (SELECT l_orderkey, l_partkey, l_shipdate AS ts, {_cal(calendar.FLAGS).replace('(ts', '(l_shipdate')} FROM lineitem)".replace(
        "CAST(ts AS DATE)", "CAST(l_shipdate AS DATE)"
    ),
)
def time_flags(spark, sf):
    return features.generate_time_features(_dates(spark, sf), "ts", list(calendar.FLAGS), cyclical=False)


_CYC_SQL = ", ".join(
    f"{R(f'{fn}(2 * pi() * ({_CAL_SQL[n]}) / {p})')} AS ts_{n}_{fn}"
    for n, p in calendar.PERIODS.items()
    for fn in ("sin", "cos")
)


@query("time_cyclical", f"SELECT event_id, ts, {_CYC_SQL} FROM events")
def time_cyclical(spark, sf):
    out = features.generate_time_features(_event_times(spark, sf), "ts", [], cyclical=True)
    return rounded(out, *[c for c in out.columns if c.endswith(("_sin", "_cos"))])


_BASE_CAL_SQL = """CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
    CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend"""


@query("time_baseline", f"SELECT event_id, {_BASE_CAL_SQL} FROM events")
def time_baseline(spark, sf):
    cols = calendar.baseline_columns("ts")
    return _event_times(spark, sf).select("event_id", *[c.alias(n) for n, c in cols.items()])


# ---- lags and rolling frames ---------------------------------------------------------------


def _dense(spark, sf):
    """The user panel with ``load0``: an hour without events has load zero."""
    df = panel(spark, sf).select("series", "ts", "LOAD", "w1")
    return df.withColumn("load0", F.coalesce("LOAD", F.lit(0.0)))


_DENSE_SQL = PANEL_SQL + ", dense AS (SELECT series, ts, LOAD, w1, coalesce(LOAD, 0) AS load0 FROM panel)"
_OVER = "(PARTITION BY series ORDER BY ts)"


@query(
    "lag_features",
    f"WITH {_DENSE_SQL} SELECT series, ts, load0, "
    + ", ".join(f"lag(load0, {k}) OVER {_OVER} AS load0_lag_{k}" for k in (1, 2, 24, 168))
    + " FROM dense",
)
def lag_features(spark, sf):
    return features.generate_lag_features(_dense(spark, sf).select("series", "ts", "load0"), HOURLY, "load0", [1, 2, 24, 168])


@query(
    "lag_baseline",
    f"""WITH {_DENSE_SQL} SELECT series, ts, lag(LOAD, 1) OVER {_OVER} AS lag_1, lag(LOAD, 24) OVER {_OVER} AS lag_24,
        lag(LOAD, 168) OVER {_OVER} AS lag_168, lag(w1, 24) OVER {_OVER} AS temp_lag_24 FROM dense""",
)
def lag_baseline(spark, sf):
    df = features.build_baseline_features(panel(spark, sf), HOURLY, STATIONS)
    return df.select("series", "ts", "lag_1", "lag_24", "lag_168", "temp_lag_24")


_AGG_SQL = {
    "mean": "avg({c})",
    "sum": "sum({c})",
    "min": "min({c})",
    "max": "max({c})",
    "std": "stddev_samp({c})",
    "var": "var_samp({c})",
    "median": "quantile_cont({c}, 0.5)",
    "skew": "skewness({c})",
    "kurt": "kurtosis({c})",
}
_FLAT = {"skew": ("3", "0.0"), "kurt": ("4", "-3.0")}


def _frame_sql(stat: str, c: str, frame: str, need: int) -> str:
    over = f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {frame})"
    value = f"{_AGG_SQL[stat].format(c=c)} {over}"
    if stat in _FLAT:
        least, flat = _FLAT[stat]
        value = f"""CASE WHEN count({c}) {over} < {least} THEN NULL
            WHEN min({c}) {over} = max({c}) {over} THEN CAST({flat} AS DOUBLE) ELSE {value} END"""
    return R(f"CASE WHEN count({c}) {over} >= {need} THEN {value} END")


def _rolling_sql(stat: str) -> str:
    cols = [f"{_frame_sql(stat, 'load0', f'{w - 1} PRECEDING AND CURRENT ROW', w)} AS load0_rolling_{w}_{stat}" for w in (6, 24)]
    cols.append(f"{_frame_sql(stat, 'LOAD', '47 PRECEDING AND CURRENT ROW', 2)} AS LOAD_rolling_48_{stat}")
    return f"WITH {_DENSE_SQL} SELECT series, ts, {', '.join(cols)} FROM dense"


def _rolling(stat: str):
    def run(spark, sf):
        recipes = features.rolling_recipes("load0", [6, 24], [stat])
        recipes += features.rolling_recipes("LOAD", [48], [stat], min_periods=2)
        out = features.apply_recipes(_dense(spark, sf), HOURLY, recipes)
        new = [x.name for x in recipes]
        return rounded(out.select("series", "ts", *new), *new)

    return run


for _stat in _AGG_SQL:
    query(f"rolling_{_stat}", _rolling_sql(_stat))(_rolling(_stat))


@query(
    "rolling_centered",
    f"WITH {_DENSE_SQL} SELECT series, ts, {_frame_sql('mean', 'load0', '2 PRECEDING AND 2 FOLLOWING', 5)} AS load0_rolling_5_mean, "
    f"{_frame_sql('max', 'load0', '12 PRECEDING AND 11 FOLLOWING', 24)} AS load0_rolling_24_max FROM dense",
)
def rolling_centered(spark, sf):
    recipes = features.rolling_recipes("load0", [5], ["mean"], center=True)
    recipes += features.rolling_recipes("load0", [24], ["max"], center=True)
    out = features.apply_recipes(_dense(spark, sf).select("series", "ts", "load0"), HOURLY, recipes)
    return rounded(out.drop("load0"), "load0_rolling_5_mean", "load0_rolling_24_max")


def _o(frame: int) -> str:
    return f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW)"


ROLL_BASE_SQL = f"""{R(f"avg(LOAD) {_o(23)}")} AS rolling_mean_24_load, {R(f"stddev_samp(LOAD) {_o(23)}")} AS rolling_std_24_load,
    {R(f"avg(LOAD) {_o(167)}")} AS rolling_mean_168_load, {R(f"avg(temp_mean_raw) {_o(23)}")} AS rolling_mean_24_temp"""
ROLL_BASE = ("rolling_mean_24_load", "rolling_std_24_load", "rolling_mean_168_load", "rolling_mean_24_temp")


@query(
    "rolling_baseline",
    f"WITH {PANEL_SQL}, t AS (SELECT *, list_avg({_LIST}) AS temp_mean_raw FROM panel) SELECT series, ts, {ROLL_BASE_SQL} FROM t",
)
def rolling_baseline(spark, sf):
    df = features.build_baseline_features(panel(spark, sf), HOURLY, STATIONS)
    return rounded(df.select("series", "ts", *ROLL_BASE), *ROLL_BASE)


def baseline_sql(source: str) -> str:
    """The 17 features over a relation with series, ts, LOAD, w1..w5 (rounded)."""
    return f"""SELECT series, ts, LOAD, {_BASE_CAL_SQL}, lag(LOAD, 1) OVER {_OVER} AS lag_1, lag(LOAD, 24) OVER {_OVER} AS lag_24,
        lag(LOAD, 168) OVER {_OVER} AS lag_168, w1 AS temp, lag(w1, 24) OVER {_OVER} AS temp_lag_24, {_ACROSS_SQL}, {ROLL_BASE_SQL}
        FROM (SELECT *, list_avg({_LIST}) AS temp_mean_raw FROM {source})"""


ROUND_IN_BASE = ("temp_mean", "temp_std", *ROLL_BASE)


@query("baseline_features", f"WITH {PANEL_SQL} {baseline_sql('panel')}")
def baseline_features(spark, sf):
    df = features.build_baseline_features(panel(spark, sf), HOURLY, STATIONS)
    return rounded(df.drop(*STATIONS), *ROUND_IN_BASE)


# ---- fills -----------------------------------------------------------------------------------


@query(
    "fill_interpolate",
    f"WITH {PANEL_SQL}, {fill_sql('panel', 'filled', ('LOAD', *STATIONS))} SELECT series, ts, "
    + ", ".join(f"{R(c)} AS {c}" for c in ("LOAD", *STATIONS))
    + " FROM filled",
)
def fill_interpolate(spark, sf):
    out = clean.fill_interpolate(panel(spark, sf), HOURLY, ["LOAD", *STATIONS])
    return rounded(out, "LOAD", *STATIONS)


def _ff(c: str) -> str:
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts),
        first_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""


@query("fill_forward", f"WITH {PANEL_SQL} SELECT series, ts, {_ff('LOAD')}, {_ff('w1')} FROM panel")
def fill_forward(spark, sf):
    df = panel(spark, sf).select("series", "ts", "LOAD", "w1")
    return clean.fill_forward(df, HOURLY, ["LOAD", "w1"])


@query(
    "fill_drop",
    f"""WITH {PANEL_SQL}, kept AS (SELECT * FROM panel WHERE LOAD IS NOT NULL),
        {fill_sql('kept', 'filled', ('w1', 'w2'))}
        SELECT series, ts, LOAD, {R('w1')} AS w1, {R('w2')} AS w2 FROM filled WHERE w1 IS NOT NULL AND w2 IS NOT NULL""",
)
def fill_drop(spark, sf):
    df = panel(spark, sf).select("series", "ts", "LOAD", "w1", "w2")
    out = clean.fill_missing(df, HOURLY, "LOAD", ["w1", "w2"], load_method="drop")
    return rounded(out, "w1", "w2")


@query(
    "sort_time",
    f"""WITH {PANEL_SQL} SELECT series, ts, LOAD, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS row_index
        FROM panel WHERE LOAD IS NOT NULL ORDER BY series, ts""",
)
def sort_time(spark, sf):
    """Rows in time order with their exact index; the range sort writes ordered output."""
    df = panel(spark, sf).select("series", "ts", "LOAD").where(F.col("LOAD").isNotNull())
    loose = features.Series(keys=("series",), step=3600)
    return positions(df, loose, "row_index").orderBy("series", "ts")


# ---- all families ------------------------------------------------------------------------------

_ALL_SQL = ", ".join(
    [f"lag(load0, {k}) OVER {_OVER} AS load0_lag_{k}" for k in (1, 2, 24, 168)]
    + [
        f"{_frame_sql(s, 'load0', f'{w - 1} PRECEDING AND CURRENT ROW', w)} AS load0_rolling_{w}_{s}"
        for w in (6, 12, 24)
        for s in ("mean", "std", "max", "min")
    ]
    + [_cal(_CAL_SQL), _CYC_SQL, f"{R('load0 - lag(load0, 1) OVER ' + _OVER)} AS load0_minus_load0_lag_1"]
)


def all_features(spark, sf):
    df = _dense(spark, sf).select("series", "ts", "load0")
    return features.generate_all_features(
        df, HOURLY, "load0", "ts", cross_pairs=[("load0", "load0_lag_1", "subtract")]
    )


@query("generate_all", f"WITH {_DENSE_SQL} SELECT series, ts, load0, {_ALL_SQL} FROM dense")
def generate_all(spark, sf):
    out, _ = all_features(spark, sf)
    floats = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return rounded(out, *floats)


@query(
    "gen_report",
    f"""WITH {PANEL_SQL} SELECT count(*) AS n_rows, 3 AS n_original_cols, 35 AS n_new_cols, 38 AS n_total_cols,
        4 AS lag_count, 12 AS rolling_count, 18 AS time_count, 1 AS cross_count,
        CAST(sum(CASE WHEN p >= 168 THEN 1 ELSE 0 END) AS BIGINT) AS n_complete
        FROM (SELECT row_number() OVER {_OVER} - 1 AS p FROM panel)""",
)
def gen_report(spark, sf):
    """Counts per family, next to the rows of the generated table and its complete rows."""
    out, report = all_features(spark, sf)
    complete = F.count_if(F.col("load0_lag_168").isNotNull())
    counts = [F.lit(v).alias(k) for k, v in report.items() if k != "new_columns"]
    return out.agg(F.count(F.lit(1)).alias("n_rows"), *counts, complete.alias("n_complete"))

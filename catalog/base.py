"""Registry, table access and the series the queries work on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.grid import regularize
from tidegrid.operators.layout import Series
from tidegrid.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
STATIONS = tuple(f"w{i}" for i in range(1, len(EVENT_TYPES) + 1))
HOURLY = Series(keys=("series",), ts="ts", step=3600, complete=True)
DAILY = Series(keys=("series",), ts="ts", step=86400, complete=True)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Added before rounding on both sides: an exact half (frequent in sums of two-decimal values)
# would otherwise be rounded up or down by the last bit of the floating-point noise.
NUDGE = 1.3e-8


def r(expr: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    expr = F.col(expr) if isinstance(expr, str) else expr
    return F.round(expr + NUDGE, digits) + F.lit(0.0)


def R(expr: str, digits: int = 6) -> str:
    """SQL counterpart of :func:`r`."""
    return f"(round(({expr}) + {NUDGE}, {digits}) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _measures() -> dict[str, Column]:
    cents = F.col("cents")
    out = {"LOAD": F.sum(cents).cast("double") / 100}
    for name, kind in zip(STATIONS, EVENT_TYPES, strict=True):
        own = F.when(F.col("event_type") == kind, cents)
        out[name] = F.try_divide(F.sum(own).cast("double"), F.count(own).cast("double")) / 100
    return out


def _hourly(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        key.alias("series"), "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents")
    )
    return regularize(events, HOURLY, _measures(), ("event_type", "cents"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hourly series per user: LOAD = total value, w1..w5 = mean value per event type."""
    return _hourly(spark, sf_dir, F.col("user_id"))


def system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measures for all users together: one long series."""
    return _hourly(spark, sf_dir, F.lit(0).cast("long"))


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hourly series per event type, numbered from 1."""
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type"))
    return _hourly(spark, sf_dir, kind.cast("long"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series of order value per priority (1 to 5), 1995 to 2001."""
    orders = table(spark, sf_dir, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("long").alias("series"),
        F.col("o_orderdate").alias("ts"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    return regularize(orders, DAILY, {"LOAD": F.sum("cents").cast("double") / 100}, ("cents",))


def _w(name: str, kind: str) -> str:
    own = f"FILTER (WHERE event_type = '{kind}')"
    return f"CAST(sum(cents) {own} AS DOUBLE) / CAST(count(*) {own} AS DOUBLE) / 100 AS {name}"


def hourly_sql(key: str, name: str) -> str:
    """CTEs that end in ``name(series, ts, LOAD, w1..w5)`` on the full hourly grid."""
    stations = ", ".join(_w(n, k) for n, k in zip(STATIONS, EVENT_TYPES, strict=True))
    return f"""
    {name}_e AS (SELECT {key} AS series, date_trunc('hour', ts) AS ts, event_type,
                 CAST(round(value * 100) AS BIGINT) AS cents FROM events),
    {name}_g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
                 FROM {name}_e GROUP BY series),
    {name}_a AS (SELECT series, ts, CAST(sum(cents) AS DOUBLE) / 100 AS LOAD, {stations}
                 FROM {name}_e GROUP BY series, ts),
    {name} AS (SELECT g.series, g.ts, a.LOAD, {", ".join("a." + w for w in STATIONS)}
               FROM {name}_g g LEFT JOIN {name}_a a ON a.series = g.series AND a.ts = g.ts)"""


PANEL_SQL = hourly_sql("user_id", "panel")
SYSTEM_SQL = hourly_sql("CAST(0 AS BIGINT)", "sys")
TYPES_SQL = hourly_sql(
    "CAST(list_position([" + ", ".join(f"'{t}'" for t in EVENT_TYPES) + "], event_type) AS BIGINT)", "typed"
)
DAILY_SQL = """
    daily_e AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS series, o_orderdate AS ts,
                CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
    daily_g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
                FROM daily_e GROUP BY series),
    daily_a AS (SELECT series, ts, CAST(sum(cents) AS DOUBLE) / 100 AS LOAD FROM daily_e GROUP BY series, ts),
    daily AS (SELECT g.series, g.ts, a.LOAD FROM daily_g g
              LEFT JOIN daily_a a ON a.series = g.series AND a.ts = g.ts)"""


def fill_sql(source: str, name: str, cols: tuple[str, ...], limit: int = 24) -> str:
    """CTEs for bounded linear interpolation by row position, ending in ``name``."""
    near = ", ".join(
        f"""last_value({c} IGNORE NULLS) OVER p AS pv_{c},
            last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS pp_{c},
            first_value({c} IGNORE NULLS) OVER f AS nv_{c},
            first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS np_{c}"""
        for c in cols
    )
    filled = ", ".join(
        f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN pp_{c} IS NULL THEN nv_{c} WHEN np_{c} IS NULL THEN pv_{c}
            ELSE pv_{c} + (nv_{c} - pv_{c})
                 * (CASE WHEN rn - pp_{c} <= {limit} OR np_{c} - rn <= {limit} THEN rn - pp_{c} ELSE {limit} END)
                 / CAST(np_{c} - pp_{c} AS DOUBLE) END AS {c}"""
        for c in cols
    )
    return f"""
    {name}_n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM {source}),
    {name}_c AS (SELECT *, {near} FROM {name}_n
                 WINDOW p AS (PARTITION BY series ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        f AS (PARTITION BY series ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {name} AS (SELECT * REPLACE ({filled}) FROM {name}_c)"""


def split_sql(source: str, name: str, gap: int = 0) -> str:
    """CTEs for the sequential split by 0.7 / 0.15, ending in ``name`` with column ``split``."""
    return f"""
    {name}_i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS ri,
                 count(*) OVER (PARTITION BY series) AS cnt FROM {source}),
    {name}_b AS (SELECT *, CAST(floor(cnt * CAST(0.7 AS DOUBLE)) AS BIGINT) AS te,
                 CAST(floor(cnt * CAST(0.15 AS DOUBLE)) AS BIGINT) AS vn FROM {name}_i),
    {name} AS (SELECT *, CASE WHEN ri < te THEN 'train' WHEN ri >= te + {gap} AND ri < te + vn + {gap} THEN 'val'
               WHEN ri >= te + vn + {gap} THEN 'test' END AS split FROM {name}_b
               WHERE NOT (ri >= te AND ri < te + {gap}))"""

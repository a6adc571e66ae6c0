"""Recovery of ambiguous timestamps, on raw texts made from the order and event times."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import HOURLY, PANEL_SQL, panel, query, table
from tidegrid.functions.timestamps import add_candidates, greedy, parse_date_and_hour
from tidegrid.operators.layout import positions
from tidegrid.operators.recover import (
    parse_rowwise,
    resolve_blocks,
    split_unparsed,
    unambiguous_range,
)

# Text without separators or padding; the same expression in both dialects. Every seventh
# order gets a text that cannot be read.
ORDER_RAW = """concat(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END, CAST(month(o_orderdate) AS STRING),
    CAST(day(o_orderdate) AS STRING), CAST(year(o_orderdate) AS STRING), ' ', CAST(o_orderkey % 24 AS STRING), ':00')"""
HOUR_RAW = """concat(CAST(month(ts) AS STRING), CAST(day(ts) AS STRING), CAST(year(ts) AS STRING), ' ',
    CAST(hour(ts) AS STRING), ':00')"""


def candidates_sql(source: str, name: str) -> str:
    """CTEs that add ``c``, the list of readings of column ``raw``, ending in ``name``."""

    def reading(year_len: int, month_len: int) -> str:
        md = f"(L - {year_len})"
        day_len = f"({md} - {month_len})"
        year = f"try_cast(right(ds, {year_len}) AS INTEGER)" + (" + 2000" if year_len == 2 else "")
        month, day = f"try_cast(substr(ds, 1, {month_len}) AS INTEGER)", f"try_cast(substr(ds, {month_len + 1}, {day_len}) AS INTEGER)"
        legal = f"{md} BETWEEN 2 AND 4 AND {day_len} BETWEEN 1 AND 2 AND {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31"
        if year_len == 4:
            legal += f" AND L >= 5 AND {year} BETWEEN 2000 AND 2030"
        text = f"printf('%04d-%02d-%02d %02d:00:00', CAST({year} AS INTEGER), {month}, {day}, hh)"
        return f"CASE WHEN ok AND {legal} THEN try_cast({text} AS TIMESTAMP) END"

    every = ", ".join(reading(y, m) for y, m in ((4, 2), (4, 1), (2, 2), (2, 1)))
    return f"""
    {name}_p AS (SELECT *, string_split(trim(raw), ' ') AS p FROM {source}),
    {name}_d AS (SELECT *, p[1] AS ds, length(p[1]) AS L, try_cast(string_split(p[2], ':')[1] AS INTEGER) AS hh,
                 regexp_full_match(p[1], '\\d+') AS ok FROM {name}_p),
    {name} AS (SELECT *, [x for x in [{every}] if x IS NOT NULL] AS c FROM {name}_d)"""


_ORDERS_SQL = f"""raws AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS series, {ORDER_RAW} AS raw FROM orders),
    {candidates_sql('raws', 'cand')}"""


def _orders(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("series"), F.expr(ORDER_RAW).alias("raw")
    )
    return add_candidates(raw, "raw")


@query(
    "ts_candidates",
    f"""WITH {_ORDERS_SQL} SELECT o_orderkey, raw, CAST(unnest(range(1, len(c) + 1)) AS INTEGER) AS choice,
        unnest(c) AS ts FROM cand""",
)
def ts_candidates(spark, sf):
    found = _orders(spark, sf).select("o_orderkey", "raw", F.posexplode("cands").alias("choice", "ts"))
    return found.withColumn("choice", F.col("choice") + 1)


@query("ts_parse_greedy", f"WITH {_ORDERS_SQL} SELECT o_orderkey, c[1] AS ts FROM cand")
def ts_parse_greedy(spark, sf):
    return _orders(spark, sf).select("o_orderkey", greedy(F.col("cands")).alias("ts"))


_RANGE_SQL = """ranges AS (SELECT series, min(CASE WHEN len(c) = 1 THEN c[1] END) - INTERVAL 365 DAY AS range_start,
    max(CASE WHEN len(c) = 1 THEN c[1] END) + INTERVAL 365 DAY AS range_end, count(CASE WHEN len(c) = 1 THEN 1 END) AS n_certain,
    count(CASE WHEN len(c) > 1 THEN 1 END) AS n_ambiguous FROM cand GROUP BY series)"""


@query(
    "ts_parse_with_range",
    f"""WITH {_ORDERS_SQL}, {_RANGE_SQL}, e AS (SELECT k.o_orderkey, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x,
        range_start AS a, range_end AS b FROM cand k JOIN ranges g ON g.series = k.series),
        d AS (SELECT *, CASE WHEN x >= a AND x <= b THEN 0 ELSE 1 END AS outside,
        CASE WHEN x >= a AND x <= b THEN abs((epoch(x) - epoch(a)) * 2 - (epoch(b) - epoch(a))) / 2
             WHEN x < a THEN epoch(a) - epoch(x) ELSE epoch(x) - epoch(b) END AS gap FROM e),
        b AS (SELECT o_orderkey, x, row_number() OVER (PARTITION BY o_orderkey ORDER BY outside, gap, i) AS k FROM d)
        SELECT o.o_orderkey, b.x AS ts FROM cand o LEFT JOIN b ON b.o_orderkey = o.o_orderkey AND b.k = 1""",
)
def ts_parse_with_range(spark, sf):
    df = _orders(spark, sf)
    return parse_rowwise(df, unambiguous_range(df, ("series",)), HOURLY).select("o_orderkey", "ts")


@query("ts_unambiguous_range", f"WITH {_ORDERS_SQL}, {_RANGE_SQL} SELECT * FROM ranges")
def ts_unambiguous_range(spark, sf):
    return unambiguous_range(_orders(spark, sf), ("series",))


def resolve_sql(source: str, name: str) -> str:
    """CTEs of the block choice over ``source(series, rn, c)``, ending in ``name`` with ``ts``."""

    def gap(k: int) -> str:
        head = f"CASE WHEN lo IS NULL THEN 0 ELSE epoch(f[{k}]) - epoch(lo) END"
        tail = f"CASE WHEN hi IS NULL THEN 0 ELSE epoch(hi) - epoch(z[{k}]) END"
        return f"""CASE WHEN f[{k}] IS NULL THEN NULL WHEN ({head}) < 0 OR ({tail}) < 0 THEN CAST('infinity' AS DOUBLE)
            ELSE CAST(({head}) + ({tail}) AS DOUBLE) END"""

    gaps = ", ".join(f"{gap(k)} AS g{k}" for k in (1, 2, 3, 4))
    rest = [f"coalesce(g{k}, CAST('infinity' AS DOUBLE))" for k in (1, 2, 3, 4)]
    best = "CASE WHEN " + " AND ".join(f"{rest[0]} <= {x}" for x in rest[1:]) + " THEN 1"
    best += " WHEN " + " AND ".join(f"{rest[1]} <= {x}" for x in rest[2:]) + " THEN 2"
    best += f" WHEN {rest[2]} <= {rest[3]} THEN 3 ELSE 4 END"
    past = "(PARTITION BY series ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    future = "(PARTITION BY series ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""
    {name}_a AS (SELECT *, coalesce(len(lag(c) OVER w) <> len(c), true) AS starts,
                 coalesce(len(lead(c) OVER w) <> len(c), true) AS ends,
                 count(CASE WHEN len(c) = 1 THEN 1 END) OVER (PARTITION BY series) AS certain
                 FROM {source} WINDOW w AS (PARTITION BY series ORDER BY rn)),
    {name}_b AS (SELECT *, last_value(CASE WHEN len(c) > 1 AND starts THEN c END IGNORE NULLS) OVER {past} AS f,
                 first_value(CASE WHEN len(c) > 1 AND ends THEN c END IGNORE NULLS) OVER {future} AS z,
                 last_value(CASE WHEN len(c) = 1 THEN c[1] END IGNORE NULLS) OVER {past} AS lo,
                 first_value(CASE WHEN len(c) = 1 THEN c[1] END IGNORE NULLS) OVER {future} AS hi FROM {name}_a),
    {name}_g AS (SELECT *, {gaps} FROM {name}_b),
    {name} AS (SELECT * EXCLUDE (g1, g2, g3, g4), CASE WHEN len(c) = 0 THEN NULL WHEN len(c) = 1 THEN c[1]
               WHEN certain > 0 THEN c[{best}] ELSE c[1] END AS ts FROM {name}_g)"""


_BLOCKS_SQL = f"""{PANEL_SQL}, raws AS (SELECT series, ts AS true_ts, {HOUR_RAW} AS raw,
    row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM panel), {candidates_sql('raws', 'cand')},
    {resolve_sql('cand', 'solved')}"""


@query("ts_resolve_blocks", f"WITH {_BLOCKS_SQL} SELECT series, true_ts, raw, ts, ts = true_ts AS hit FROM solved")
def ts_resolve_blocks(spark, sf):
    """Hourly texts of every user, read back; ``hit`` tells whether the true hour was found."""
    rows = positions(panel(spark, sf).select("series", "ts"), HOURLY, "pos")
    raw = rows.select("series", "pos", F.col("ts").alias("true_ts"), F.expr(HOUR_RAW).alias("raw"))
    out = resolve_blocks(add_candidates(raw, "raw", seconds=True), HOURLY)
    return out.select("series", "true_ts", "raw", "ts", (F.col("ts") == F.col("true_ts")).alias("hit"))


@query(
    "ts_drop_unparsed",
    f"""WITH {_ORDERS_SQL} SELECT o_orderkey, raw, c[1] AS ts, c[1] IS NULL AS quarantined FROM cand""",
)
def ts_drop_unparsed(spark, sf):
    """Kept rows and quarantined rows, one table."""
    df = _orders(spark, sf).select("o_orderkey", "raw", greedy(F.col("cands")).alias("ts"))
    kept, failed = split_unparsed(df)
    return kept.withColumn("quarantined", F.lit(False)).unionByName(failed.withColumn("quarantined", F.lit(True)))


@query(
    "ts_parse_solution",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) END AS ts FROM orders",
)
def ts_parse_solution(spark, sf):
    date = F.expr(
        """concat(CASE WHEN o_orderkey % 11 = 0 THEN '31' ELSE CAST(month(o_orderdate) AS STRING) END, '/',
           CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))"""
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", parse_date_and_hour(date, F.col("o_orderkey") % 24).alias("ts")
    )

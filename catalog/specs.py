"""Feature proposals: JSON texts made from the events, checked, executed and proposed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.base import HOURLY, PANEL_SQL, R, STATIONS, TYPES_SQL, by_type, panel, query, rounded, table
from catalog.features import _frame_sql
from catalog.profiles import acf_sql
from tidegrid.functions.calendar import ALL as TIME_FEATURES
from tidegrid.operators import leakage, profile, specs
from tidegrid.operators.execute import execute_specs
from tidegrid.plans.context import propose_features

COLUMNS = ("LOAD", "ts", *STATIONS)

# One proposal per event; its defects follow from the keys. Same text in both dialects.
_T, _F = "event_id % 23", "event_id % 17"
_LAG = f"""concat('{{"name":"', CASE WHEN {_T} = 3 THEN '9bad' ELSE 'lag_f' END, '","type":"', CASE WHEN {_T} = 4 THEN 'shift' ELSE 'lag' END, '"',
    CASE WHEN {_T} = 5 THEN '' WHEN {_T} = 6 THEN ',"target_col":"nope"' ELSE ',"target_col":"LOAD"' END,
    CASE WHEN {_T} = 7 THEN '' WHEN {_T} = 8 THEN ',"params":[1]'
         ELSE concat(',"params":{{', CASE WHEN {_T} = 9 THEN '' ELSE concat('"lag":', CASE WHEN {_T} = 10 THEN '"24"' WHEN {_T} = 11 THEN '3.5'
              WHEN {_T} = 12 THEN 'true' ELSE CAST(user_id % 300 AS STRING) END) END,
              CASE WHEN {_T} = 13 THEN ',"extra":1' ELSE '' END, '}}') END, '}}')"""
_ROLL = f"""concat('{{"name":"roll_f","type":"rolling","target_col":"w1","params":{{"window":', CAST(event_id % 97 AS STRING),
    ',"stat":"', CASE WHEN {_F} = 2 THEN 'percentile' WHEN {_F} = 3 THEN 'skew' ELSE 'mean' END, '"}}}}')"""
_TIME = f"""concat('{{"name":"time_f","type":"time"', CASE WHEN {_F} = 4 THEN ',"time_col":"when"' ELSE ',"time_col":"ts"' END,
    ',"params":{{"features":["hour"', CASE WHEN {_F} = 5 THEN ',"century"' ELSE ',"month"' END, '],"cyclical":', CASE WHEN {_F} = 6 THEN '1' ELSE 'false' END, '}}}}')"""
_CROSS = f"""concat('{{"name":"cross_f","type":"cross","params":{{"col1":"', CASE WHEN {_F} = 7 THEN '' WHEN {_F} = 8 THEN 'w77' ELSE 'w2' END,
    '","col2":"w3","operation":"', CASE WHEN {_F} = 9 THEN 'ratio' ELSE 'divide' END, '"}}}}')"""
_ITEMS = f"""CASE WHEN {_T} = 14 THEN '{{}}' WHEN {_T} = 15 THEN concat('[', repeat(concat({_LAG}, ','), 10), {_LAG}, ']')
    WHEN {_T} = 16 THEN concat('[', {_LAG}, ',7]') WHEN {_T} = 17 THEN '[]'
    ELSE concat('[', {_LAG}, ',', {_ROLL}, ',', {_TIME}, ',', {_CROSS}, ']') END"""
_BODY = f"""concat('{{"iteration":', CASE WHEN {_F} = 10 THEN '-1' WHEN {_F} = 11 THEN '"two"' ELSE CAST(user_id AS STRING) END,
    CASE WHEN {_F} = 12 THEN '' WHEN {_F} = 13 THEN ',"analysis":"short"' ELSE concat(',"analysis":"the ', event_type, ' series has a daily cycle"') END,
    CASE WHEN {_T} = 18 THEN '' ELSE concat(',"new_features":', {_ITEMS}) END, CASE WHEN {_F} = 14 THEN ',"note":1' ELSE '' END, '}}')"""
RAW = f"""CASE WHEN {_T} = 19 THEN concat('Here you are:\n```json\n', {_BODY}, '\n```\nDone {{ok}}.')
    WHEN {_T} = 20 THEN concat('Proposal ', {_BODY}, ' end') WHEN {_T} = 21 THEN replace({_BODY}, '"', chr(39))
    WHEN {_T} = 22 THEN concat('no json ', event_type) WHEN {_F} = 15 THEN substr({_BODY}, 1, 60)
    WHEN {_F} = 16 THEN concat('[', CAST(event_id AS STRING), ']') ELSE {_BODY} END"""


def _texts(spark, sf):
    # chr() instead of a quoted quote keeps the text identical in both dialects.
    return table(spark, sf, "events").select(F.col("event_id").alias("proposal_id"), F.expr(RAW.replace("\n```", "\\n```").replace("```json\n", "```json\\n").replace("```\nDone", "```\\nDone")).alias("raw"))


def _docs(spark, sf):
    return specs.extract_json(_texts(spark, sf))


_SQL_RAW = RAW.replace("'Here you are:\n```json\n'", "'Here you are:' || chr(10) || '```json' || chr(10)").replace(
    "'\n```\nDone {ok}.'", "chr(10) || '```' || chr(10) || 'Done {ok}.'"
)
DOCS_SQL = f"""raws AS (SELECT event_id AS proposal_id, {_SQL_RAW} AS raw FROM events),
    fenced AS (SELECT *, CASE WHEN regexp_matches(raw, '```(?:json)?\\s*\\n?(.*?)\\n?```', 's')
               THEN trim(regexp_extract(raw, '```(?:json)?\\s*\\n?(.*?)\\n?```', 1, 's')) ELSE trim(raw) END AS body FROM raws),
    cuts AS (SELECT *, CASE WHEN instr(body, '{{') > 0 AND instr(body, '}}') > 0 AND length(body) - instr(reverse(body), '}}') + 1 > instr(body, '{{')
             THEN substr(body, instr(body, '{{'), length(body) - instr(reverse(body), '}}') + 2 - instr(body, '{{')) ELSE body END AS cut FROM fenced),
    docs AS (SELECT proposal_id, raw, CASE WHEN json_valid(cut) THEN CAST(cut AS JSON) WHEN json_valid(replace(cut, chr(39), '"'))
             THEN CAST(replace(cut, chr(39), '"') AS JSON) END AS doc, NOT json_valid(cut) AND json_valid(replace(cut, chr(39), '"')) AS repaired FROM cuts)"""


@query(
    "spec_extract_json",
    f"""WITH {DOCS_SQL} SELECT proposal_id, repaired, doc IS NOT NULL AS parsed, CASE WHEN doc IS NULL THEN substr(raw, 1, 300) END AS error,
        CASE WHEN json_type(doc) = 'OBJECT' AND json_type(doc, '$.iteration') IN ('UBIGINT', 'BIGINT') THEN CAST(doc ->> '$.iteration' AS BIGINT) ELSE -99 END AS iteration,
        CASE WHEN json_type(doc, '$.new_features') = 'ARRAY' THEN CAST(json_array_length(doc, '$.new_features') AS INTEGER) ELSE -1 END AS n_items FROM docs""",
)
def spec_extract_json(spark, sf):
    doc = F.col("doc")
    is_int = F.schema_of_variant(F.try_variant_get(doc, "$.iteration", "variant")) == "BIGINT"
    return _docs(spark, sf).select(
        "proposal_id",
        "repaired",
        doc.isNotNull().alias("parsed"),
        "error",
        F.coalesce(F.when(is_int, F.try_variant_get(doc, "$.iteration", "bigint")), F.lit(-99)).alias("iteration"),
        F.coalesce(F.size(F.try_variant_get(doc, "$.new_features", "array<variant>")), F.lit(-1)).alias("n_items"),
    )


_INT = "('UBIGINT', 'BIGINT')"
TOP_SQL = f"""tops AS (SELECT proposal_id, doc, CASE WHEN doc IS NULL THEN ['not_json'] WHEN json_type(doc) <> 'OBJECT' THEN ['not_an_object'] ELSE
    [x for x in [CASE WHEN json_type(doc, '$.iteration') IS NULL THEN 'missing:iteration' END,
     CASE WHEN json_type(doc, '$.analysis') IS NULL THEN 'missing:analysis' END,
     CASE WHEN json_type(doc, '$.new_features') IS NULL THEN 'missing:new_features' END,
     CASE WHEN json_type(doc, '$.new_features') <> 'ARRAY' THEN 'new_features_not_array' END,
     CASE WHEN json_type(doc, '$.new_features') = 'ARRAY' AND json_array_length(doc, '$.new_features') > 10 THEN 'too_many_features' END,
     CASE WHEN json_type(doc, '$.iteration') NOT IN {_INT} THEN 'iteration_not_integer' END,
     CASE WHEN json_type(doc, '$.iteration') IN {_INT} AND CAST(doc ->> '$.iteration' AS BIGINT) < 0 THEN 'iteration_negative' END,
     CASE WHEN json_type(doc, '$.analysis') = 'VARCHAR' AND length(doc ->> '$.analysis') NOT BETWEEN 10 AND 1000 THEN 'analysis_length' END,
     CASE WHEN len([k for k in json_keys(doc) if k NOT IN ('iteration', 'analysis', 'new_features')]) > 0 THEN 'unknown_top_field' END] if x IS NOT NULL] END AS errors FROM docs)"""


@query(
    "spec_validate_top",
    f"WITH {DOCS_SQL}, {TOP_SQL} SELECT proposal_id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS valid FROM tops",
)
def spec_validate_top(spark, sf):
    found = specs.add_top_errors(_docs(spark, sf).select("proposal_id", "doc"))
    return found.select("proposal_id", F.concat_ws(",", "errors").alias("errors"), (F.size("errors") == 0).alias("valid"))


ITEMS_SQL = f"""items AS (SELECT proposal_id, CAST(pos AS INTEGER) AS pos, doc -> ('$.new_features[' || pos || ']') AS item FROM (SELECT proposal_id, doc,
        unnest(range(0, CAST(json_array_length(doc, '$.new_features') AS BIGINT))) AS pos FROM docs WHERE json_type(doc, '$.new_features') = 'ARRAY')),
    flat AS (SELECT *, CASE WHEN json_type(item, '$.name') = 'VARCHAR' THEN item ->> '$.name' END AS name,
        CASE WHEN json_type(item, '$.type') = 'VARCHAR' THEN item ->> '$.type' END AS kind, item ->> '$.target_col' AS target_col, item ->> '$.time_col' AS time_col,
        item -> '$.params' AS params FROM items)"""
_COLS_SQL = "(" + ", ".join(f"'{c}'" for c in COLUMNS) + ")"
FEATURE_SQL = f"""checked AS (SELECT proposal_id, pos, name, kind, params, CASE WHEN json_type(item) <> 'OBJECT' THEN ['not_an_object'] ELSE [x for x in [
     CASE WHEN json_type(item, '$.name') IS NULL THEN 'missing:name' END, CASE WHEN json_type(item, '$.type') IS NULL THEN 'missing:type' END,
     CASE WHEN json_type(item, '$.params') IS NULL THEN 'missing:params' END,
     CASE WHEN kind NOT IN ('lag', 'rolling', 'time', 'cross') THEN 'unknown_type' END,
     CASE WHEN length(name) NOT BETWEEN 1 AND 120 THEN 'name_length' END,
     CASE WHEN NOT regexp_matches(name, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'name_pattern' END,
     CASE WHEN kind IN ('lag', 'rolling') AND coalesce(target_col, '') = '' THEN 'missing:target_col' END,
     CASE WHEN len([k for k in json_keys(item) if k NOT IN ('name', 'type', 'target_col', 'time_col', 'params')]) > 0 THEN 'unknown_field' END,
     CASE WHEN kind IN ('lag', 'rolling') AND coalesce(target_col, '') <> '' AND target_col NOT IN {_COLS_SQL} THEN 'unknown_column:target_col' END,
     CASE WHEN kind = 'time' AND coalesce(time_col, '') <> '' AND time_col NOT IN {_COLS_SQL} THEN 'unknown_column:time_col' END,
     CASE WHEN kind = 'cross' AND params ->> '$.col1' NOT IN {_COLS_SQL} THEN 'unknown_column:col1' END,
     CASE WHEN kind = 'cross' AND params ->> '$.col2' NOT IN {_COLS_SQL} THEN 'unknown_column:col2' END] if x IS NOT NULL] END AS errors FROM flat)"""


@query(
    "spec_validate_feature",
    f"WITH {DOCS_SQL}, {ITEMS_SQL}, {FEATURE_SQL} SELECT proposal_id, pos, array_to_string(errors, ',') AS errors FROM checked",
)
def spec_validate_feature(spark, sf):
    items = specs.explode_items(_docs(spark, sf), ["proposal_id"])
    return items.select("proposal_id", "pos", F.concat_ws(",", specs.feature_errors(COLUMNS)).alias("errors"))


_STATS_SQL = "('mean', 'std', 'var', 'max', 'min', 'median', 'sum', 'skew', 'kurt')"
_TIMES_SQL = "(" + ", ".join(f"'{f}'" for f in TIME_FEATURES) + ")"


def _param_sql(key: str, kinds: str, required: bool, extra: str = "") -> str:
    at = f"json_type(params, '$.{key}')"
    checks = [f"CASE WHEN {at} IS NULL THEN 'missing:{key}' END"] if required else []
    checks.append(f"CASE WHEN {at} NOT IN {kinds} THEN 'kind:{key}' END")
    return ", ".join(checks + ([extra] if extra else []))


def _kind_sql(kind: str, keys: tuple[str, ...], *checks: str) -> str:
    known = ", ".join(f"'{k}'" for k in keys)
    unknown = f"CASE WHEN len([k for k in json_keys(params) if k NOT IN ({known})]) > 0 THEN 'unknown_parameter' END"
    return f"WHEN kind = '{kind}' THEN [x for x in [{', '.join((unknown, *checks))}] if x IS NOT NULL]"


def _min_sql(key: str, low: int) -> str:
    return f"CASE WHEN json_type(params, '$.{key}') IN {_INT} AND CAST(params ->> '$.{key}' AS BIGINT) < {low} THEN 'minimum:{key}' END"


_STR = "('VARCHAR')"
PARAM_SQL = f"""params_checked AS (SELECT proposal_id, pos, CASE WHEN params IS NULL OR kind NOT IN ('lag', 'rolling', 'time', 'cross') OR kind IS NULL THEN NULL
    WHEN json_type(params) <> 'OBJECT' THEN ['params_not_an_object']
    {_kind_sql('lag', ('lag',), _param_sql('lag', _INT, True, _min_sql('lag', 1)))}
    {_kind_sql('rolling', ('window', 'stat'), _param_sql('window', _INT, True, _min_sql('window', 2)),
        _param_sql('stat', _STR, True, f"CASE WHEN params ->> '$.stat' NOT IN {_STATS_SQL} THEN 'enum:stat' END"))}
    {_kind_sql('time', ('features', 'cyclical'), _param_sql('features', "('ARRAY')", False,
        f"CASE WHEN json_type(params, '$.features') = 'ARRAY' AND len([f for f in CAST(params -> '$.features' AS VARCHAR[]) if f NOT IN {_TIMES_SQL}]) > 0 THEN 'enum:features' END"),
        _param_sql('cyclical', "('BOOLEAN')", False))}
    {_kind_sql('cross', ('col1', 'col2', 'operation'),
        _param_sql('col1', _STR, True, "CASE WHEN length(params ->> '$.col1') < 1 THEN 'length:col1' END"),
        _param_sql('col2', _STR, True, "CASE WHEN length(params ->> '$.col2') < 1 THEN 'length:col2' END"),
        _param_sql('operation', _STR, True, "CASE WHEN params ->> '$.operation' NOT IN ('add', 'subtract', 'multiply', 'divide') THEN 'enum:operation' END"))}
    END AS errors FROM flat)"""


@query(
    "spec_validate_params",
    f"WITH {DOCS_SQL}, {ITEMS_SQL}, {PARAM_SQL} SELECT proposal_id, pos, errors IS NULL AS skipped, coalesce(array_to_string(errors, ','), '') AS errors FROM params_checked",
)
def spec_validate_params(spark, sf):
    items = specs.explode_items(_docs(spark, sf), ["proposal_id"])
    found = items.select("proposal_id", "pos", specs.param_errors().alias("errors"))
    return found.select("proposal_id", "pos", F.col("errors").isNull().alias("skipped"), F.concat_ws(",", "errors").alias("errors"))


@query(
    "spec_filter_oversized",
    f"""WITH {DOCS_SQL}, {TOP_SQL}, {ITEMS_SQL}, {FEATURE_SQL}, {PARAM_SQL},
        judged AS (SELECT c.proposal_id, c.pos, c.name, c.kind, c.params, len(c.errors) + coalesce(len(p.errors), 0) AS bad FROM checked c
                   JOIN params_checked p ON p.proposal_id = c.proposal_id AND p.pos = c.pos JOIN tops t ON t.proposal_id = c.proposal_id AND len(t.errors) = 0),
        good AS (SELECT * FROM judged WHERE proposal_id NOT IN (SELECT proposal_id FROM judged WHERE bad > 0)),
        rows AS (SELECT greatest(1, CAST(floor(count(DISTINCT date_trunc('hour', ts)) * 0.15) AS BIGINT) - 40) AS cap FROM events)
        SELECT proposal_id, pos, name, kind AS type, coalesce(CASE WHEN kind = 'lag' THEN CAST(params ->> '$.lag' AS BIGINT) > cap
        WHEN kind = 'rolling' THEN CAST(params ->> '$.window' AS BIGINT) > cap END, false) AS removed FROM good, rows""",
)
def spec_filter_oversized(spark, sf):
    """Items of the proposals without any error, and whether a cap on the look-back removes them: 40 rows less than
    the validation rows of the hours of all events together, at 15 %."""
    valid = specs.validate(_docs(spark, sf), ["proposal_id"], COLUMNS)
    hours = table(spark, sf, "events").agg(F.count_distinct(F.date_trunc("hour", F.col("ts"))).alias("n"))
    cap = hours.select(specs.safe_cap(F.floor(F.col("n") * 0.15)).alias("cap"))
    removed = specs.oversized(F.col("cap"))
    return valid.crossJoin(F.broadcast(cap)).select(  # one row
        "proposal_id", "pos", "name", "type", removed.alias("removed"))


# ---- names and leakage: column names made from part and line numbers ----------------------------

NAME = """CASE l_partkey % 9 WHEN 0 THEN concat('LOAD_lag_', CAST(l_linenumber - 3 AS STRING)) WHEN 1 THEN concat('temp_lag_', CAST(l_linenumber AS STRING))
    WHEN 2 THEN concat('LOAD_rolling_', CAST(l_suppkey AS STRING), '_mean') WHEN 3 THEN 'temp_multiply_LOAD'
    WHEN 4 THEN concat('temp_lag_', CAST(l_suppkey AS STRING), '_rolling_24_mean') WHEN 5 THEN concat('w1_minus_w', CAST(l_linenumber AS STRING))
    WHEN 6 THEN concat('LOAD_div_temp_lag_', CAST(l_linenumber AS STRING)) WHEN 7 THEN 'temp_raw' ELSE concat('hour_', CAST(l_linenumber AS STRING)) END"""
_KNOWN = ("LOAD", "temp", "w1", "hour")


def _names(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.expr(NAME).alias("feature"))


_BASE_SQL = (
    "CASE "
    + " ".join(f"WHEN contains(feature, '{m}') THEN split_part(feature, '{m}', 1)" for m in leakage.MARKS)
    + " "
    + " ".join(
        f"WHEN starts_with(feature, '{c}') OR suffix(feature, '{c}') THEN '{c}'" for c in ("LOAD", "temp", "hour", "w1")
    )
    + " ELSE 'unknown' END"
)
_NAMES_SQL = f"names AS (SELECT l_orderkey, l_partkey, l_suppkey, {NAME} AS feature FROM lineitem)"


@query("feature_base_column", f"WITH {_NAMES_SQL} SELECT *, {_BASE_SQL} AS base FROM names")
def feature_base_column(spark, sf):
    return _names(spark, sf).withColumn("base", leakage.base_column("feature", _KNOWN))


_HAS_CROSS = " OR ".join(f"contains(feature, '{m}')" for m in leakage.CROSS_MARKS)


@query(
    "leakage_check",
    f"""WITH {_NAMES_SQL}, k AS (SELECT *, {_BASE_SQL} AS base, try_cast(nullif(regexp_extract(feature, '_lag_(-?\\d+)', 1), '') AS INTEGER) AS lag FROM names),
        f AS (SELECT *, [x for x in [CASE WHEN lag <= 0 THEN 'LEAK:lag_not_positive' END,
        CASE WHEN lag > 0 AND base = 'LOAD' AND lag < 3 THEN 'WARN:lag_below_horizon' END,
        CASE WHEN contains(feature, '_rolling_') AND base = 'LOAD' THEN 'INFO:rolling_on_target' END,
        CASE WHEN ({_HAS_CROSS}) AND (starts_with(feature, 'LOAD') OR contains(feature, '_LOAD')) THEN 'INFO:cross_with_target' END] if x IS NOT NULL] AS findings FROM k)
        SELECT l_orderkey, l_partkey, l_suppkey, feature, array_to_string(findings, ',') AS findings, NOT (lag IS NOT NULL AND lag <= 0) AS safe FROM f""",
)
def leakage_check(spark, sf):
    out = leakage.leakage_check(_names(spark, sf), "feature", "LOAD", horizon=3)
    return out.withColumn("findings", F.concat_ws(",", "findings"))


# ---- execution -----------------------------------------------------------------------------------

PROPOSAL = """{"iteration": 1, "analysis": "load of a day and a half ago, quiet hours, season", "new_features": [
 {"name": "older", "type": "lag", "target_col": "LOAD", "params": {"lag": 36}},
 {"name": "quiet", "type": "rolling", "target_col": "LOAD", "params": {"window": 18, "stat": "min"}},
 {"name": "spread", "type": "cross", "params": {"col1": "w1", "col2": "LOAD", "operation": "subtract"}},
 {"name": "season", "type": "time", "time_col": "ts", "params": {"features": ["month"], "cyclical": false}}]}"""


@query(
    "spec_execute",
    f"""WITH {PANEL_SQL}, d AS (SELECT series, ts, coalesce(LOAD, 0) AS LOAD, w1 FROM panel)
        SELECT series, ts, LOAD, w1, lag(LOAD, 36) OVER (PARTITION BY series ORDER BY ts) AS LOAD_lag_36,
        {_frame_sql('min', 'LOAD', '17 PRECEDING AND CURRENT ROW', 18)} AS LOAD_rolling_18_min, {R('w1 - LOAD', 4)} AS w1_minus_LOAD,
        CAST(month(ts) AS INTEGER) AS ts_month FROM d""",
)
def spec_execute(spark, sf):
    """A proposal is parsed and validated as a table, then run over the hours of every user."""
    df = panel(spark, sf).select("series", "ts", F.coalesce("LOAD", F.lit(0.0)).alias("LOAD"), "w1")
    text = spark.range(1).select(F.lit(0).alias("proposal_id"), F.lit(PROPOSAL).alias("raw"))
    valid = specs.validate(specs.extract_json(text), ["proposal_id"], df.columns)
    out, _, _ = execute_specs(df, HOURLY, specs.specs_to_rows(valid))
    return rounded(rounded(out, "LOAD_rolling_18_min"), "w1_minus_LOAD", digits=4)


_FEATURES = ("hour", "lag_1", "lag_24", "rolling_mean_24_load")
_RANK_SQL = """strong AS (SELECT series, event_type AS f, row_number() OVER (PARTITION BY series ORDER BY g DESC, event_type) AS k FROM
    (SELECT CAST(user_id % 5 + 1 AS BIGINT) AS series, event_type, sum(CAST(round(value * 100) AS BIGINT)) AS g FROM events GROUP BY 1, 2))"""


# Candidates per series as (series, prio, o, name, type, target_col, time_col, params).
_CANDIDATES_SQL = f"""{TYPES_SQL}, typed0 AS (SELECT series, ts, coalesce(LOAD, 0) AS LOAD FROM typed), {acf_sql('typed0', 'a', 'LOAD')},
        {_RANK_SQL},
        fam AS (SELECT DISTINCT series, 1 AS prio, CAST(0 AS DOUBLE) AS o, 'ts_cycles' AS name, 'time' AS type, NULL AS target_col, 'ts' AS time_col,
                '{{"features":["hour"],"cyclical":true}}' AS params FROM a),
        lags AS (SELECT series, 2, -acf, 'LOAD_lag_' || lag, 'lag', 'LOAD', NULL, '{{"lag":' || lag || '}}' FROM a WHERE acf > 0.5 AND lag NOT IN (0, 1, 2, 23, 24, 25)),
        rolls AS (SELECT series, 3, -acf, 'LOAD_rolling_' || lag || '_mean', 'rolling', 'LOAD', NULL, '{{"window":' || lag || ',"stat":"mean"}}' FROM a
                  WHERE acf > 0.5 AND lag >= 2 AND lag NOT IN (23, 24, 25)),
        diffs AS (SELECT series, 4, acf, 'lag_1_minus_lag_' || lag, 'cross', NULL, NULL, '{{"col1":"lag_1","col2":"lag_' || lag || '","operation":"subtract"}}'
                  FROM a WHERE acf < -0.3 AND lag = 24),
        prods AS (SELECT x.series, 5, CAST((y.k - 1) * (y.k - 2) // 2 + x.k AS DOUBLE), x.f || '_multiply_' || y.f, 'cross', NULL, NULL, '{{"col1":"' || x.f || '","col2":"' || y.f || '","operation":"multiply"}}'
                  FROM strong x JOIN strong y ON y.series = x.series AND x.k < y.k AND y.k <= 10),
        u AS (SELECT * FROM fam UNION ALL SELECT * FROM lags UNION ALL SELECT * FROM rolls UNION ALL SELECT * FROM diffs UNION ALL SELECT * FROM prods)"""


@query(
    "propose_features",
    f"""WITH {_CANDIDATES_SQL},
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY prio, o, name) - 1 AS INTEGER) AS pos FROM u)
        SELECT series, 2 AS iteration, pos, name, type, target_col, time_col, params FROM n WHERE pos < 5""",
)
def propose_features_(spark, sf):
    """Proposals per event type, from its own correlations; importance is the value per event type."""
    rows, strongest = _evidence(spark, sf)
    return propose_features(rows, strongest, _FEATURES, ["series"], "LOAD", "ts", iteration=2)


@query(
    "propose_features_next",
    f"""WITH {_CANDIDATES_SQL},
        told AS (SELECT series, k AS rank, CASE WHEN k % 2 = 0 THEN 'LOAD_rolling_' || (6 * k) || '_std' ELSE 'rolling_max_' || (11 * k + 1) || '_load' END AS feature,
                 CASE WHEN k % 2 = 0 THEN 6 * k ELSE 11 * k + 1 END AS w, CASE WHEN k % 2 = 0 THEN 'std' ELSE 'max' END AS stat FROM strong),
        wider AS (SELECT DISTINCT series, 6, rank + i / 2.0::DOUBLE, 'LOAD_rolling_' || size || '_' || stat, 'rolling', 'LOAD', NULL, '{{"window":' || size || ',"stat":"' || stat || '"}}'
                  FROM (SELECT series, rank, stat, unnest([0, 1]) AS i, unnest([2 * w, w // 2]) AS size FROM told WHERE rank <= 10) WHERE size >= 2 AND size NOT IN (23, 24, 25)),
        lately AS (SELECT series, CASE WHEN sum(g) % 2 = 0 THEN 0.002 ELSE 0.2 END AS gain FROM
                   (SELECT CAST(user_id % 5 + 1 AS BIGINT) AS series, CAST(round(value * 100) AS BIGINT) AS g FROM events) GROUP BY series),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY gain < 0.01 AND type IN ('lag', 'cross'), prio, o, name) - 1 AS INTEGER) AS pos
              FROM (SELECT * FROM u UNION ALL SELECT * FROM wider) JOIN lately USING (series))
        SELECT series, 3 AS iteration, pos, name, type, target_col, time_col, params FROM n WHERE pos < 5""",
)
def propose_features_next(spark, sf):
    """The same with a memory: rolling statistics among the weakest features get other windows, and where the round before
    (lags and crosses) gained little, other kinds of features come first. Gains follow from the values of the type."""
    rows, strongest = _evidence(spark, sf)
    k = F.col("rank")
    feature = F.when(k % 2 == 0, F.format_string("LOAD_rolling_%d_std", 6 * k)).otherwise(F.format_string("rolling_max_%d_load", 11 * k + 1))
    weakest = strongest.select("series", "rank", feature.alias("feature"))
    value = F.sum(F.round(F.col("value") * 100).cast("long"))
    last = table(spark, sf, "events").groupBy((F.col("user_id") % 5 + 1).alias("series")).agg(F.when(value % 2 == 0, 0.002).otherwise(0.2).alias("gain"))
    last = last.withColumn("kinds", F.array(F.lit("lag"), F.lit("cross")))
    return propose_features(rows, strongest, _FEATURES, ["series"], "LOAD", "ts", iteration=3, weakest=weakest, last=last)


def _evidence(spark, sf):
    """Correlations per event type, and the event types in order of their value as features."""
    df = by_type(spark, sf).select("series", "ts", F.coalesce("LOAD", F.lit(0.0)).alias("LOAD"))
    rows = profile.acf(profile.indexed_target(df, HOURLY, "LOAD"), HOURLY, "LOAD")
    value = F.sum(F.round(F.col("value") * 100).cast("long")).alias("g")
    per_type = table(spark, sf, "events").groupBy((F.col("user_id") % 5 + 1).alias("series"), "event_type").agg(value)
    rank = F.row_number().over(Window.partitionBy("series").orderBy(F.col("g").desc(), "event_type"))
    return rows, per_type.select("series", rank.alias("rank"), F.col("event_type").alias("feature"))

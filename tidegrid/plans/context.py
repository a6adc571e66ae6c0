"""Everything a proposer looks at, and the rule-based proposer."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.operators.layout import Series, join_by_series
from tidegrid.operators.profile import importance_bottom, importance_top, series_profile

# Thresholds of the proposal strategy (fixed), how many features one round adds at most, and how many of
# the most important ones are crossed with each other. These limits are part of the strategy.
HIGH_ACF, LOW_ACF = 0.5, -0.3
PER_ROUND = 5
TOP_FEATURES = 10
STOP_DELTA, STOP_FROM = 0.001, 3
LAST_FEATURES = 5
SMALL_GAIN = 0.01  # share of the RMSE below which a round counts as having gained little


def dataset_profile(
    df: DataFrame,
    s: Series,
    target: str,
    features: Sequence[str],
    importance: DataFrame | None = None,
    metrics: dict[str, float] | None = None,
    horizon: int = 1,
    name: str = "",
    history_window: int | None = None,
) -> DataFrame:
    """One row per series: size, frequency, target statistics, ACF map, trend, season, features,
    strongest and weakest features, current metrics."""
    out = series_profile(df, s, target)
    brief = "array<struct<feature:string,gain:double,norm_pct:double>>"
    parts = []
    for label, pick in (("top10_features", importance_top), ("bottom10_features", importance_bottom)):
        if importance is None:
            parts.append(F.array().cast(brief).alias(label))
            continue
        # Ten rows at most, from a report that has been cut to ten already.
        rows = [(r.feature, r.gain, r.norm_pct) for r in pick(importance).collect()]
        lit = [F.struct(F.lit(f).alias("feature"), F.lit(g).alias("gain"), F.lit(p).alias("norm_pct")) for f, g, p in rows]
        parts.append((F.array(*lit) if lit else F.array()).cast(brief).alias(label))
    scores = [F.lit(x) for kv in (metrics or {}).items() for x in (kv[0], float(kv[1]))]
    return out.select(
        "*",
        F.lit(name).alias("dataset_name"),
        F.lit(target).alias("target_col"),
        F.lit(s.ts).alias("time_col"),
        F.lit(horizon).alias("prediction_horizon"),
        F.lit(history_window).cast("int").alias("history_window"),
        F.lit(len(features)).alias("n_features"),
        F.array(*[F.lit(f) for f in features]).alias("current_features"),
        *parts,
        (F.create_map(*scores) if scores else F.create_map().cast("map<string,double>")).alias("val_metrics"),
    )


def _change(history: DataFrame, metric: str, w: WindowSpec) -> Column:
    """Change of a metric in a round: against ``<metric>_before`` where recorded, else the previous round."""
    before = F.lag(metric).over(w)
    if f"{metric}_before" in history.columns:
        before = F.coalesce(f"{metric}_before", before)
    return F.round(F.col(metric) - before, 4)


def iteration_context(history: DataFrame, run: Sequence[str], metrics: Sequence[str] = ("RMSE", "MAE")) -> DataFrame:
    """State before the next round, from one row per run and iteration
    (``iteration``, the metrics, ``added`` = array of column names; ``<metric>_before`` where recorded).

    ``<metric>_delta`` is the change in the round, ``previous_features`` the last five of all columns
    added before it. The advice to stop needs three rounds.
    """
    w = Window.partitionBy(*run).orderBy("iteration")
    # A run has a handful of rounds, so their columns fit in one row.
    so_far = F.flatten(F.collect_list("added").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    present = [m for m in metrics if m in history.columns]
    rows = history.select(
        *run,
        "iteration",
        *present,
        *[_change(history, m, w).alias(f"{m.lower()}_delta") for m in present],
        so_far.alias("__added"),
        F.row_number().over(w).alias("round"),
    )
    stop = (F.abs("rmse_delta") < STOP_DELTA) & (F.col("round") >= STOP_FROM)
    last = F.slice(F.col("__added"), F.greatest(F.size("__added") - (LAST_FEATURES - 1), F.lit(1)), LAST_FEATURES)
    return rows.select(
        *run,
        "iteration",
        "round",
        *present,
        *[f"{m.lower()}_delta" for m in present],
        F.coalesce(last, F.array().cast("array<string>")).alias("previous_features"),
        F.coalesce(stop, F.lit(False)).alias("stop"),
    )


def history_summary(history: DataFrame, run: Sequence[str], metrics: Sequence[str] = ("RMSE", "MAE")) -> DataFrame:
    """One line per round: counts, the changed metrics as text, the first five new columns.

    ``history``: run columns, ``iteration, proposed, skipped, added`` (array) and the metrics, with
    ``<metric>_before`` where recorded (then the first round has its change, too).
    """
    w = Window.partitionBy(*run).orderBy("iteration")
    changes = [F.when(_change(history, m, w).isNotNull(), F.format_string(f"{m}:%+.4f", _change(history, m, w))) for m in metrics]
    return history.select(
        *run,
        "iteration",
        "proposed",
        F.size("added").alias("added"),
        "skipped",
        F.concat_ws(", ", *changes).alias("metrics_delta"),
        F.concat_ws(", ", F.slice("added", 1, 5)).alias("added_cols"),
    )


def _existing(features: Sequence[str], pattern: str) -> list[int]:
    return sorted({int(m.group(1)) for f in features for m in [re.search(pattern, f)] if m})


def _other_windows(weakest: DataFrame, keys: Sequence[str], target: str, near: set[int], spec) -> DataFrame:
    """Rolling statistics of the target among weak features, over twice and half their window."""
    forms = (
        (rf"^{re.escape(target)}_rolling_(\d+)_([a-z]+)$", 1, 2),
        (rf"^rolling_([a-z]+)_(\d+)_{re.escape(target.lower())}$", 2, 1),
    )
    size = stat = F.lit("")
    for pattern, at_size, at_stat in forms:
        hit = F.col("feature").rlike(pattern)
        size = F.when(hit, F.regexp_extract("feature", pattern, at_size)).otherwise(size)
        stat = F.when(hit, F.regexp_extract("feature", pattern, at_stat)).otherwise(stat)
    rows = weakest.where(F.col("rank") <= TOP_FEATURES).select(*keys, "rank", size.try_cast("int").alias("size"), stat.alias("stat"))
    rows = rows.where("size IS NOT NULL").select(*keys, "rank", "stat", F.posexplode(F.array(F.col("size") * 2, F.floor(F.col("size") / 2).cast("int"))).alias("i", "size"))
    rows = rows.where((F.col("size") >= 2) & (~F.col("size").isin(*near) if near else F.lit(True)))
    text = F.col("size").cast("string")
    name = F.concat(F.lit(f"{target}_rolling_"), text, F.lit("_"), F.col("stat"))
    params = F.concat(F.lit('{"window":'), text, F.lit(',"stat":"'), F.col("stat"), F.lit('"}'))
    return rows.select(*keys, spec(6, F.col("rank") + F.col("i") / 2, name, "rolling", True, params).alias("p")).dropDuplicates()


def propose_features(
    acf_rows: DataFrame,
    strongest: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    target: str = "LOAD",
    time_col: str = "ts",
    iteration: int = 1,
    excluded: Sequence[str] = (),
    weakest: DataFrame | None = None,
    last: DataFrame | None = None,
) -> DataFrame:
    """Rule-based proposals, at most five per series and round.

    In this order: a missing family (lag, rolling, calendar); a lag and a rolling mean at every
    lag with a high correlation, the difference to that lag where it is strongly negative;
    products of the ten most important features, the strongest pairs first; and the rolling statistics of the target among
    the ten least important features over twice and half their window. Where the round before gained little, its kinds of
    features (lag, rolling, cross, time) come after all others, whatever the rule. Lags and windows next to existing ones and
    columns that exist already are left out.

    ``acf_rows``: ``keys, lag, acf``; ``strongest`` and ``weakest``: ``keys, rank, feature`` for ranks 1 to 10; ``last``: ``keys,
    gain`` (share by which the RMSE fell) and ``kinds`` (array) of the round before, at most one row per series.
    """
    near = {k + d for k in _existing(features, rf"^(?:{re.escape(target)}_)?lag_(\d+)$") for d in (-1, 0, 1)}
    near_roll = {
        k + d
        for pattern in (rf"^{re.escape(target)}_rolling_(\d+)_", rf"^rolling_[a-z]+_(\d+)_{re.escape(target.lower())}$")
        for k in _existing(features, pattern)
        for d in (-1, 0, 1)
    }
    existing = list(features) + list(excluded)
    no_lag = not any("lag_" in f for f in features)
    no_roll = not any("rolling_" in f for f in features)
    no_time = not any(f.endswith(("_sin", "_cos")) for f in features)

    def spec(prio, order, name, kind, col, params):
        return F.struct(
            F.lit(prio).alias("prio"),
            order.cast("double").alias("order"),
            name.alias("name"),
            F.lit(kind).alias("type"),
            (F.lit(target) if col else F.lit(None).cast("string")).alias("target_col"),
            (F.lit(time_col) if kind == "time" else F.lit(None).cast("string")).alias("time_col"),
            params.alias("params"),
        )

    zero = F.lit(0.0)
    families = []
    if no_lag:
        families.append(spec(1, zero, F.lit(f"{target}_lag_24"), "lag", True, F.lit('{"lag":24}')))
    if no_roll:
        families.append(
            spec(1, zero, F.lit(f"{target}_rolling_24_mean"), "rolling", True, F.lit('{"window":24,"stat":"mean"}'))
        )
    if no_time:
        families.append(
            spec(1, zero, F.lit(f"{time_col}_cycles"), "time", False, F.lit('{"features":["hour"],"cyclical":true}'))
        )
    lag, r = F.col("lag"), F.col("acf")
    k = lag.cast("string")
    by_lag = F.array(
        F.when(
            (r > HIGH_ACF) & ~lag.isin(*near) if near else r > HIGH_ACF,
            spec(2, -r, F.concat(F.lit(f"{target}_lag_"), k), "lag", True, F.concat(F.lit('{"lag":'), k, F.lit("}"))),
        ),
        F.when(
            (r > HIGH_ACF) & (lag >= 2) & (~lag.isin(*near_roll) if near_roll else F.lit(True)),
            spec(
                3,
                -r,
                F.concat(F.lit(f"{target}_rolling_"), k, F.lit("_mean")),
                "rolling",
                True,
                F.concat(F.lit('{"window":'), k, F.lit(',"stat":"mean"}')),
            ),
        ),
        F.when(
            (r < LOW_ACF) & F.concat(F.lit("lag_"), k).isin(*existing) & F.lit("lag_1" in existing) & (lag > 1),
            spec(
                4,
                r,
                F.concat(F.lit("lag_1_minus_lag_"), k),
                "cross",
                False,
                F.concat(F.lit('{"col1":"lag_1","col2":"lag_'), k, F.lit('","operation":"subtract"}')),
            ),
        ),
    )
    parts = [acf_rows.select(*keys, F.explode(F.array_compact(by_lag)).alias("p"))]
    if families:
        parts.append(acf_rows.select(*keys).distinct().select(*keys, F.explode(F.array(*families)).alias("p")))
    ranks = range(1, TOP_FEATURES + 1)
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("feature")))
    top = strongest.groupBy(*keys).agg(*[at(i).alias(f"f{i}") for i in ranks])
    product = lambda i, a, b: spec(
        5,
        F.lit(float(i)),
        F.concat(F.col(a), F.lit("_multiply_"), F.col(b)),
        "cross",
        False,
        F.concat(F.lit('{"col1":"'), F.col(a), F.lit('","col2":"'), F.col(b), F.lit('","operation":"multiply"}')),
    )
    ordered = [(a, b) for b in ranks for a in range(1, b)]
    pairs = F.array(*[product(i, f"f{a}", f"f{b}") for i, (a, b) in enumerate(ordered, 1)])
    parts.append(top.select(*keys, F.explode(pairs).alias("p")).where(F.col("p.name").isNotNull()))
    if weakest is not None:
        parts.append(_other_windows(weakest, keys, target, near_roll, spec))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Candidates per series are bounded by the lag list, so this window stays tiny.
    w = Window.partitionBy(*keys).orderBy("stale", "prio", "order", "name")
    fresh = every.select(*keys, "p.*").where(~F.col("name").isin(*existing) if existing else F.lit(True))
    stale = F.lit(False)
    if last is not None:
        fresh = join_by_series(fresh, last.select(*keys, "gain", "kinds"), list(keys))
        stale = F.coalesce((F.col("gain") < SMALL_GAIN) & F.array_contains("kinds", F.col("type")), F.lit(False))
    fresh = fresh.withColumn("stale", stale)
    return (
        fresh.withColumn("pos", F.row_number().over(w) - 1)
        .where(F.col("pos") < PER_ROUND)
        .select(*keys, F.lit(iteration).alias("iteration"), "pos", "name", "type", "target_col", "time_col", "params")
    )

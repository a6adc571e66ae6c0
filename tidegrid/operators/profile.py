"""What is known about a series before features are chosen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tidegrid.functions.epoch import epoch_seconds
from tidegrid.operators.layout import POS, Series, index_rows, join_by_series, windowed
from tidegrid.operators.quantiles import exact_quantiles
from tidegrid.session import materialize

# Lags that are looked at unless told otherwise, and the least number of points (fixed).
ACF_LAGS = (1, 2, 3, 6, 12, 24, 48, 72, 168, 336)
MIN_POINTS = 10


def sampling_frequency(df: DataFrame, s: Series) -> DataFrame:
    """Median step between successive rows, in seconds and as a label."""
    out = exact_quantiles(_stepped(df.select(*s.keys, s.ts, *s.ties), s), s.keys, "__step", {"step_seconds": 0.5})
    return out.select(*s.keys, F.col("n").alias("n_steps"), "step_seconds", _frequency(F.col("step_seconds")).alias("frequency"))


def _stepped(df: DataFrame, s: Series) -> DataFrame:
    """Add ``__step``, the seconds since the row before."""
    step = lambda w: (epoch_seconds(s.ts) - epoch_seconds(F.lag(s.ts).over(w))).cast("double")
    return windowed(df, s, lambda w: {"__step": step(w)}, before=1)


def _frequency(sec: Column) -> Column:
    def label(unit: str, size: int) -> Column:
        return F.concat((sec / size).cast("long").cast("string"), F.lit(f" {unit}"))

    return (
        F.when(sec <= 60, label("seconds", 1))
        .when(sec <= 3600, label("minutes", 60))
        .when(sec <= 86400, label("hours", 3600))
        .when(sec.isNotNull(), label("days", 86400))
    )


def target_stats(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Moments, range and 5 % / 95 % quantiles of the non-missing values."""
    moments = df.groupBy(*keys).agg(*_moments(target))
    tails = exact_quantiles(df, keys, target, {"target_q05": 0.05, "target_q95": 0.95})
    return join_by_series(moments, tails, list(keys)).withColumn("target_cv", _variation())


def _moments(target: str) -> list[Column]:
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return [f(target).alias(f"target_{n}") for n, f in kinds.items()]


def _variation() -> Column:
    cv = F.when(F.col("target_mean") != 0, F.col("target_std") / F.col("target_mean")).otherwise(0.0)
    return F.round(cv, 4)


def indexed_target(df: DataFrame, s: Series, target: str) -> DataFrame:
    """The non-missing values with their row number ``__pos`` and the series length ``n``."""
    rows = df.where(F.col(target).isNotNull()).select(*s.keys, s.ts, *s.ties, target)
    return index_rows(rows, s, POS, "n")


def acf(indexed: DataFrame, s: Series, target: str, lags: Sequence[int] | None = None) -> DataFrame:
    """Correlation of a series with itself ``lag`` rows back: ``keys, lag, acf``.

    All lags share one window; the pair sums are combined per task before they are moved.
    Without explicit lags those above a quarter of the series are left out; an undefined
    correlation is 0. Series of fewer than ten points keep a row, with NULL.
    """
    chosen = [k for k in (ACF_LAGS if lags is None else lags) if k >= 1]
    wide = _lagged(indexed, s, target, chosen).groupBy(*s.keys).agg(F.max("n").alias("n"), *_correlations(target, chosen))
    pairs = _lag_pairs(chosen)
    limit = F.floor(F.col("n") / 4) if lags is None else F.col("n") - 1
    return (
        wide.select(*s.keys, "n", F.explode(pairs).alias("__p"))
        .where(F.col("__p.lag") <= F.greatest(limit, F.lit(min(chosen))))
        .select(*s.keys, "__p.lag", F.when(F.col("n") >= MIN_POINTS, F.col("__p.acf")).alias("acf"))
    )


def _lagged(indexed: DataFrame, s: Series, target: str, lags: Sequence[int]) -> DataFrame:
    return windowed(indexed, s, lambda w: {f"__lag_{k}": F.lag(target, k).over(w) for k in lags}, before=max(lags), pos=POS)


def _correlations(target: str, lags: Sequence[int]) -> list[Column]:
    """Aggregates ``__acf_<lag>`` over the columns of ``_lagged``."""

    def corr(k: int) -> Column:
        b = F.col(f"__lag_{k}")
        a = F.when(b.isNotNull(), F.col(target))
        scale = F.sqrt(F.var_pop(a) * F.var_pop(b))
        return F.round(F.coalesce(F.try_divide(F.covar_pop(a, b), scale), F.lit(0.0)), 4)

    return [corr(k).alias(f"__acf_{k}") for k in lags]


def _lag_pairs(lags: Sequence[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__acf_{k}").alias("acf")) for k in lags])


def trend(indexed: DataFrame, s: Series, target: str) -> DataFrame:
    """Least-squares slope over the row number and how strong it is relative to the mean."""
    fit = indexed.groupBy(*s.keys).agg(F.max("n").alias("n"), F.avg(target).alias("__mean"), _slope(target))
    return fit.select(*s.keys, *_trend("__mean"))


def _slope(target: str) -> Column:
    x = F.col(POS).cast("double")
    return F.try_divide(F.covar_pop(x, F.col(target)), F.var_pop(x)).alias("__slope")


def _trend(mean: str) -> list[Column]:
    """Trend columns from ``n``, ``__slope`` and the mean of a series."""
    slope = F.when(F.col("n") >= MIN_POINTS, F.col("__slope")).otherwise(0.0)
    relative = F.when((F.col("n") >= MIN_POINTS) & (F.col(mean) != 0), slope * F.col("n") / F.col(mean)).otherwise(0.0)
    direction = F.when(slope > 0, F.lit("up")).otherwise(F.lit("down"))
    strength = (
        F.when(F.abs(relative) > 0.3, F.concat(F.lit("strong "), direction))
        .when(F.abs(relative) > 0.1, F.concat(F.lit("weak "), direction))
        .otherwise(F.lit("none"))
    )
    return [
        F.round(slope, 6).alias("trend_slope"),
        F.round(relative, 6).alias("relative_change"),
        strength.alias("trend_strength"),
    ]


def seasonality(acf_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily and weekly season from the correlations at 24 and 168 rows (0 where absent)."""
    at = {k: F.coalesce(F.max(F.when(F.col("lag") == k, F.col("acf"))), F.lit(0.0)) for k in (24, 168)}
    both = acf_table.groupBy(*keys).agg(at[24].alias("acf_24"), at[168].alias("acf_168"))
    return both.select("*", *_season())


def _season() -> list[Column]:
    top = F.greatest("acf_24", "acf_168")
    strength = F.when(top > 0.7, F.lit("strong")).when(top > 0.3, F.lit("medium")).when(top > 0.1, F.lit("weak")).otherwise(F.lit("none"))
    return [(F.col("acf_24") > 0.3).alias("has_daily"), (F.col("acf_168") > 0.3).alias("has_weekly"), strength.alias("seasonality_strength")]


def series_profile(df: DataFrame, s: Series, target: str) -> DataFrame:
    """One row per series (NULL is one): ``n_samples``, step and frequency, target statistics, ``acf_summary`` (map), trend, season.

    Times, values and steps are written once (``scratch_scope`` removes them). One aggregate over the lagged values gives moments, trend and all
    correlations, one radix selection the median step and the tails of the target. A series without any value has
    NULL for all but ``n_samples``, its step and ``target_cv`` (0).
    """
    keys, lags = list(s.keys), list(ACF_LAGS)
    rows = materialize(_stepped(df.select(*keys, s.ts, *[c for c in s.ties if c != target], target), s), "steps")
    wide = _lagged(indexed_target(rows, s, target), s, target, lags).groupBy(*keys)
    wide = wide.agg(F.max("n").alias("n"), *_moments(target), _slope(target), *_correlations(target, lags))
    near = F.filter(_lag_pairs(lags), lambda p: p["lag"] <= F.greatest(F.floor(F.col("n") / 4), F.lit(min(lags))))
    known = F.map_from_entries(F.transform(near, lambda p: F.struct(p["lag"], F.when(F.col("n") >= MIN_POINTS, p["acf"]))))
    stats = [f"target_{n}" for n in ("mean", "std", "min", "max")]
    told = wide.select(*keys, *stats, *_trend("target_mean"), known.alias("acf_summary"))
    told = told.drop("relative_change").select("*", *[F.coalesce(F.try_element_at("acf_summary", F.lit(k)), F.lit(0.0)).alias(f"acf_{k}") for k in (24, 168)])
    values = F.inline(F.array(*[F.struct(F.lit(n).alias("__of"), F.col(c).cast("double").alias("__value")) for n, c in (("step", "__step"), ("target", target))]))
    cuts = exact_quantiles(rows.select(*keys, values), [*keys, "__of"], "__value", {"low": 0.05, "middle": 0.5, "high": 0.95})
    wanted = {"step_seconds": ("step", "middle"), "target_q05": ("target", "low"), "target_q95": ("target", "high")}
    tails = cuts.groupBy(*keys).agg(*[F.max(F.when(F.col("__of") == of, F.col(q))).alias(n) for n, (of, q) in wanted.items()])
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    out = join_by_series(join_by_series(counts, tails, keys), told.select("*", *_season()), keys)
    return out.select("*", _frequency(F.col("step_seconds")).alias("frequency"), _variation().alias("target_cv"))


def missing_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Missing count and percentage per column, as rows."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"__m_{c}") for c in cols]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__m_{c}").alias("missing")) for c in cols])
    return counts.select(*keys, "n_rows", F.explode(pairs).alias("__p")).select(
        *keys,
        "__p.column",
        "n_rows",
        "__p.missing",
        F.round(F.col("__p.missing") * 100.0 / F.col("n_rows"), 4).alias("missing_pct"),
    )


def task_profile(df: DataFrame, key: str, ts: str, target: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count_if(F.col(target).isNull()).alias("missing_target"),
    )


def describe_new_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of statistics per added column; columns that hold no numbers have counts only. A message
    row if nothing was added."""
    types = {f.name: f.dataType.simpleString() for f in after.schema.fields}
    new = [c for c in after.columns if c not in before.columns]
    if not new:
        return before.sparkSession.sql("select 'no new columns' as message")
    numbers = {f.name for f in after.schema.fields if isinstance(f.dataType, (NumericType, BooleanType))}
    value = {c: F.col(c).cast("double") if c in numbers else F.lit(None).cast("double") for c in new}
    wide = after.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[(F.count(c) if k == "count" else f(value[c])).alias(f"__{k}_{c}") for c in new for k, f in _BASIC.items()],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(types[c]).alias("dtype"),
                *[F.col(f"__{k}_{c}").alias(k) for k in _BASIC],
            )
            for c in new
        ]
    )
    basic = wide.select("__rows", F.explode(entries).alias("__e")).select("__rows", "__e.*")
    long = after.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value[c].alias("__x")) for c in new])).alias("__e")
    ).select("__e.*")
    quartiles = exact_quantiles(long, ["column"], "__x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles.drop("n"), "column", "left").select(
        "column",
        "dtype",
        F.col("count").alias("non_null"),
        F.round(1 - F.try_divide(F.col("count"), F.col("__rows")), 4).alias("null_ratio"),
        "count",
        "mean",
        "std",
        "min",
        "q25",
        "q50",
        "q75",
        "max",
    )


_BASIC = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _attach_single(table: DataFrame, single: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row (an equi-join on a constant, broadcast)."""
    one = single.withColumn("__one", F.lit(1))
    return table.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def importance_share(table: DataFrame) -> DataFrame:
    """Share of the total gain in percent (0 if there is no gain at all)."""
    joined = _attach_single(table, table.agg(F.sum("importance_gain").alias("__total")))
    share = F.when(F.col("__total") > 0, F.col("importance_gain") / F.col("__total") * 100).otherwise(0.0)
    return joined.select(*table.columns, share.alias("importance_gain_norm"))


def _brief(df: DataFrame) -> DataFrame:
    return df.select(
        "feature",
        F.round("importance_gain", 1).alias("gain"),
        F.round("importance_gain_norm", 2).alias("norm_pct"),
    )


def importance_top(table: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest gains (a top-k report), equal gains by name."""
    best = importance_share(table).orderBy(F.col("importance_gain").desc(), F.col("feature")).limit(k)
    return _brief(best)


def importance_bottom(table: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` smallest positive gains; with fewer than ``k`` of those, the ``k`` smallest of all."""
    order = [F.col("importance_gain").asc(), F.col("feature").desc()]
    shared = importance_share(table)
    enough = table.agg((F.count_if(F.col("importance_gain") > 0) >= k).alias("__enough"))
    pool = _attach_single(shared, enough).where(~F.col("__enough") | (F.col("importance_gain") > 0))
    return _brief(pool.orderBy(*order).limit(k))


def best_iteration(deltas: DataFrame, run: Sequence[str]) -> DataFrame:
    """Iteration with the lowest RMSE change, the first one on ties."""
    return (
        deltas.where((F.col("metric") == "RMSE") & F.col("delta").isNotNull())
        .groupBy(*run)
        .agg(
            F.min_by("iteration", F.struct("delta", "iteration")).alias("best_iteration"),
            F.min("delta").alias("best_delta"),
        )
    )

"""Splits, samples, scaling and the prepared table."""

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
    daily_orders,
    fill_sql,
    panel,
    query,
    r,
    rounded,
    split_sql,
)
from catalog.features import ROUND_IN_BASE, baseline_sql
from tidegrid.functions import arrays, batches
from tidegrid.operators.clean import fill_interpolate
from tidegrid.operators.features import BASELINE_FEATURES
from tidegrid.operators.layout import without_holes
from tidegrid.operators.profile import sampling_frequency
from tidegrid.operators.samples import sliding_windows
from tidegrid.operators.scale import fit_scaler
from tidegrid.operators.split import split_profile, split_timeseries
from tidegrid.plans.prepare import Prepared, preprocess
from tidegrid.session import materialize

LOOSE = replace(HOURLY, complete=False)


def _observed(spark, sf):
    return panel(spark, sf).select("series", "ts", "LOAD", "w1").where(F.col("LOAD").isNotNull())


_OBSERVED_SQL = PANEL_SQL + ", observed AS (SELECT series, ts, LOAD, w1 FROM panel WHERE LOAD IS NOT NULL)"


@query(
    "split_sequential",
    f"WITH {_OBSERVED_SQL}, {split_sql('observed', 'parts', 3)} SELECT series, ts, LOAD, split FROM parts",
)
def split_sequential(spark, sf):
    return split_timeseries(_observed(spark, sf), LOOSE, gap=3).select("series", "ts", "LOAD", "split")


@query(
    "split_yearly",
    f"""WITH {DAILY_SQL}, y AS (SELECT series, year(ts) AS y, dense_rank() OVER (PARTITION BY series ORDER BY year(ts) DESC) AS k
        FROM daily GROUP BY series, year(ts)), n AS (SELECT series, count(*) AS years FROM y GROUP BY series),
        {split_sql('daily', 'parts')}
        SELECT d.series, d.ts, d.LOAD, CASE WHEN n.years < 3 THEN p.split WHEN y.k = 1 THEN 'test' WHEN y.k = 2 THEN 'val'
        ELSE 'train' END AS split FROM daily d JOIN y ON y.series = d.series AND y.y = year(d.ts)
        JOIN n ON n.series = d.series JOIN parts p ON p.series = d.series AND p.ts = d.ts""",
)
def split_yearly(spark, sf):
    return split_timeseries(daily_orders(spark, sf), replace(DAILY, complete=False), method="yearly")


@query(
    "split_profile",
    f"""WITH {_OBSERVED_SQL}, {split_sql('observed', 'parts')} SELECT series, split, count(*) AS n_rows, min(ts) AS first_ts,
        max(ts) AS last_ts FROM parts GROUP BY series, split""",
)
def split_profile_(spark, sf):
    return split_profile(split_timeseries(_observed(spark, sf), LOOSE), ("series",), "ts")


@query(
    "sampling_frequency",
    f"""WITH {_OBSERVED_SQL}, steps AS (SELECT series, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS s
        FROM observed), m AS (SELECT series, count(s) AS n_steps, quantile_cont(CAST(s AS DOUBLE), 0.5) AS step_seconds FROM steps GROUP BY series)
        SELECT series, n_steps, step_seconds, CASE WHEN step_seconds <= 60 THEN CAST(CAST(trunc(step_seconds) AS BIGINT) AS VARCHAR) || ' seconds'
        WHEN step_seconds <= 3600 THEN CAST(CAST(trunc(step_seconds / 60) AS BIGINT) AS VARCHAR) || ' minutes'
        WHEN step_seconds <= 86400 THEN CAST(CAST(trunc(step_seconds / 3600) AS BIGINT) AS VARCHAR) || ' hours'
        ELSE CAST(CAST(trunc(step_seconds / 86400) AS BIGINT) AS VARCHAR) || ' days' END AS frequency FROM m WHERE n_steps > 0""",
)
def sampling_frequency_(spark, sf):
    return sampling_frequency(_observed(spark, sf), LOOSE)


# ---- samples -----------------------------------------------------------------------------------

_TWO_SQL = PANEL_SQL + ", " + fill_sql("panel", "filled", ("LOAD", "w1")) + (
    ", two AS (SELECT series, ts, LOAD, w1 FROM filled WHERE LOAD IS NOT NULL AND w1 IS NOT NULL)"
)


def _two(spark, sf):
    """LOAD and w1 of every user without gaps, written once: the split and the scaler read it twice."""
    df = panel(spark, sf).select("series", "ts", "LOAD", "w1")
    return materialize(fill_interpolate(df, HOURLY, ["LOAD", "w1"], drop_empty=True), "two")


def _condensed(samples, sums):
    """Each channel of every sample as its position-weighted sum (``sums``: name -> channel), and the two targets."""

    import numpy as np

    def build(batch, x):
        same = {c: batch.column(c) for c in ("series", "split", "ts", "y1", "y2")}
        n, steps, channels = x.shape
        return same | {"steps": np.full(n, steps, "int32"), "channels": np.full(n, channels, "int32")} | {c: batches.weighted_sum(batches.channel(x, j)) for c, j in sums.items()}

    kept = samples.select("series", "split", "ts", "x", F.col("y")[0].alias("y1"), F.col("y")[1].alias("y2"))
    schema = "series long, split string, ts timestamp_ntz, y1 double, y2 double, steps int, channels int, "
    out = batches.of_samples(kept, build, schema + ", ".join(f"{c} double" for c in sums))
    return out.select("series", "split", "ts", "steps", "channels", *[r(c, 4).alias(c) for c in sums], r("y1").alias("y1"), r("y2").alias("y2"))


@query(
    "sliding_windows",
    f"""WITH {_TWO_SQL}, {split_sql('two', 'parts')}, w AS (SELECT series, split, ts, list(LOAD) OVER o AS a, list(w1) OVER o AS b
        FROM parts WINDOW o AS (PARTITION BY series, split ORDER BY ts ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING))
        SELECT series, split, ts, 24 AS steps, {R('list_sum([a[i] * i for i in range(1, 25)])', 4)} AS load_sum,
        {R('list_sum([b[i] * i for i in range(1, 25)])', 4)} AS w1_sum, {R('a[25]')} AS y1, {R('a[26]')} AS y2
        FROM w WHERE len(a) = 26""",
)
def sliding_windows_(spark, sf):
    """Every sample of 24 steps and 2 targets; its channels are condensed to position-weighted sums."""
    parts = split_timeseries(_two(spark, sf), LOOSE)
    samples = sliding_windows(parts, LOOSE.with_keys("split"), ["w1"], "LOAD", seq_len=24, pred_len=2)
    return _condensed(samples, {"load_sum": 0, "w1_sum": 1}).drop("channels")


_WIDE_SQL = _TWO_SQL + """, w24 AS (SELECT series, ts, list(LOAD) OVER o AS a, list(w1) OVER o AS b FROM two
       WINDOW o AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
       full24 AS (SELECT series, ts, unnest([0, 1]) AS channel, unnest([a, b]) AS a FROM w24 WHERE len(a) = 24)"""
_WEIGHTS, _BIASES = (1.5, 0.5), (0.25, -0.5)  # an affine of its own for either channel


_CHANNEL_ROWS = "series long, ts timestamp_ntz, channel int"


def _by_channel(batch, channels):
    """Keys of a batch once for each channel."""
    import numpy as np
    import pyarrow as pa

    n = batch.num_rows
    twice = {c: pa.concat_arrays([batch.column(c)] * channels) for c in ("series", "ts")}
    return twice | {"channel": np.repeat(np.arange(channels, dtype="int32"), n)}


def _wide_samples(spark, sf):
    """24 steps of [LOAD, w1] from every hour of every user."""
    return sliding_windows(_two(spark, sf), HOURLY, ["w1"], "LOAD", seq_len=24, pred_len=0)


@query(
    "patches",
    f"""WITH {_WIDE_SQL}, padded AS (SELECT series, ts, channel, list_concat(a, [0.0::DOUBLE, 0.0::DOUBLE]) AS a FROM full24)
        SELECT series, ts, CAST(channel AS INTEGER) AS channel, 12 AS n_patches, {R('list_sum([a[(i // 4) * 2 + i % 4 + 1] * (i + 1) for i in range(0, 48)])', 4)} AS weighted FROM padded""",
)
def patches(spark, sf):
    """The patches of every sample of every user, channel by channel, condensed to a position-weighted sum."""
    import numpy as np

    cfg = arrays.default_patch_config(24)

    def build(batch, x):
        n, _, channels = x.shape
        pieces = [batches.patches(batches.channel(x, j), 24, cfg["patch_len"], cfg["stride"]) for j in range(channels)]
        return _by_channel(batch, channels) | {
            "n_patches": np.repeat(np.array([p.shape[1] for p in pieces], "int32"), n),
            "weighted": np.concatenate([batches.weighted_sum(p.reshape(n, -1)) for p in pieces]),
        }

    out = batches.of_samples(_wide_samples(spark, sf).drop("y"), build, f"{_CHANNEL_ROWS}, n_patches int, weighted double")
    return rounded(out, "weighted", digits=4)


@query(
    "patch_config",
    f"""WITH {PANEL_SQL}, n AS (SELECT series, count(LOAD) AS seq_len FROM panel GROUP BY series)
        SELECT series, seq_len, CASE WHEN seq_len <= 48 THEN 4 WHEN seq_len <= 168 THEN 8 ELSE 16 END AS patch_len,
        CASE WHEN seq_len <= 48 THEN 2 WHEN seq_len <= 168 THEN 4 ELSE 8 END AS stride FROM n""",
)
def patch_config(spark, sf):
    sizes = panel(spark, sf).groupBy("series").agg(F.count("LOAD").alias("seq_len"))
    return sizes.withColumn("c", arrays.patch_config(F.col("seq_len"))).select("series", "seq_len", "c.patch_len", "c.stride")


@query(
    "instance_norm",
    f"""WITH {_WIDE_SQL}, st AS (SELECT *, list_avg(a) AS m, sqrt(list_var_pop(a) + 1e-5) AS sd, a[24] AS z,
            CASE channel WHEN 0 THEN {_WEIGHTS[0]}::DOUBLE ELSE {_WEIGHTS[1]}::DOUBLE END AS w, CASE channel WHEN 0 THEN {_BIASES[0]}::DOUBLE ELSE {_BIASES[1]}::DOUBLE END AS b FROM full24)
        SELECT series, ts, CAST(channel AS INTEGER) AS channel, {R('list_sum([((a[i] - m) / sd * w + b) * i for i in range(1, 25)])', 4)} AS by_mean,
        {R('list_sum([((a[i] - z) / sd * w + b) * i for i in range(1, 25)])', 4)} AS by_last, {R('list_sum([((((a[i] - m) / sd * w + b) - b) / (w + 1e-10) * sd + m) * i for i in range(1, 25)])', 4)} AS restored FROM st""",
)
def instance_norm(spark, sf):
    """Both normalisations of every sample of every user, and the way back, as position-weighted sums per channel."""
    import numpy as np

    def build(batch, x):
        by_mean, by_last, restored = [], [], []
        for j, (w, b) in enumerate(zip(_WEIGHTS, _BIASES, strict=True)):
            seq = batches.channel(x, j)
            mean, last = batches.instance_stats(seq), batches.instance_stats(seq, subtract_last=True)
            normal = batches.normalize(seq, mean, w, b)
            by_mean.append(batches.weighted_sum(normal))
            by_last.append(batches.weighted_sum(batches.normalize(seq, last, w, b)))
            restored.append(batches.weighted_sum(batches.denormalize(normal, mean, w, b)))
        sums = {"by_mean": by_mean, "by_last": by_last, "restored": restored}
        return _by_channel(batch, len(by_mean)) | {c: np.concatenate(v) for c, v in sums.items()}

    out = batches.of_samples(_wide_samples(spark, sf).drop("y"), build, f"{_CHANNEL_ROWS}, by_mean double, by_last double, restored double")
    return rounded(out, "by_mean", "by_last", "restored", digits=4)


# ---- scalers -----------------------------------------------------------------------------------


def _scale_sql(centre: str, width: str) -> str:
    def one(c: str) -> str:
        return R(f"({c} - c_{c}) / s_{c}") + f" AS {c}_scaled"

    stats = ", ".join(
        f"""{centre.format(c=c)} FILTER (WHERE split = 'train') OVER q AS c_{c},
            CASE WHEN {width.format(c=c, f="FILTER (WHERE split = 'train') OVER q")} = 0 THEN 1
            ELSE {width.format(c=c, f="FILTER (WHERE split = 'train') OVER q")} END AS s_{c}"""
        for c in ("LOAD", "w1")
    )
    return f"""WITH {_TWO_SQL}, {split_sql('two', 'parts')}, st AS (SELECT *, {stats} FROM parts WINDOW q AS (PARTITION BY series))
        SELECT series, ts, split, {one('LOAD')}, {one('w1')}, {R('LOAD', 4)} AS LOAD_back FROM st"""


def _scale(kind: str):
    def run(spark, sf):
        parts = split_timeseries(_two(spark, sf), LOOSE)
        scaler = fit_scaler(parts, ["series"], ["LOAD", "w1"], kind)
        scaled = scaler.transform(scaler.attach(parts), "_scaled")  # one join for both directions
        back = scaler.inverse(scaled.withColumn("LOAD_back", F.col("LOAD_scaled")), col="LOAD_back", like="LOAD")
        return back.select(
            "series", "ts", "split", r("LOAD_scaled").alias("LOAD_scaled"), r("w1_scaled").alias("w1_scaled"), r("LOAD_back", 4).alias("LOAD_back")
        )

    return run


query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c}) {f}"))(_scale("standard"))
query("scale_minmax", _scale_sql("min({c})", "(max({c}) {f} - min({c}) {f})"))(_scale("minmax"))


# ---- the prepared table --------------------------------------------------------------------------

_ALL_COLS = ("LOAD", *STATIONS)
_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in _ALL_COLS)
_NEEDED = " AND ".join(
    f"{c} IS NOT NULL" for c in ("lag_1", "lag_24", "lag_168", "temp_lag_24", "temp_std", "rolling_std_24_load")
)
PREPARED_SQL = f"""{PANEL_SQL}, {fill_sql('panel', 'filled', _ALL_COLS)},
    complete AS (SELECT series, ts, LOAD, {", ".join(STATIONS)} FROM filled WHERE {_NOT_NULL}),
    featured AS (SELECT * FROM ({baseline_sql('complete')}) WHERE {_NEEDED}), {split_sql('featured', 'prepared')}"""


def prepared(spark, sf) -> Prepared:
    return preprocess(panel(spark, sf), HOURLY, STATIONS)


@query("preprocess", f"WITH {PREPARED_SQL} SELECT * EXCLUDE (ri, cnt, te, vn) REPLACE ({R('LOAD')} AS LOAD, {R('lag_1')} AS lag_1, {R('lag_24')} AS lag_24, {R('lag_168')} AS lag_168, {R('temp')} AS temp, {R('temp_lag_24')} AS temp_lag_24, {R('temp_min')} AS temp_min, {R('temp_max')} AS temp_max) FROM prepared")
def preprocess_(spark, sf):
    """Flagship: readings to a filled, featurised and split table for every user."""
    out = prepared(spark, sf).data.drop(*STATIONS)
    plain = ("LOAD", "lag_1", "lag_24", "lag_168", "temp", "temp_lag_24", "temp_min", "temp_max")
    return rounded(out, *ROUND_IN_BASE, *plain)


_CHANNELS = ("LOAD", *BASELINE_FEATURES)


@query(
    "sliding_windows_all",
    f"""WITH {PREPARED_SQL}, w AS (SELECT series, split, ts, {", ".join(f"list(CAST({c} AS DOUBLE)) OVER o AS {c}" for c in _CHANNELS)}
        FROM prepared WINDOW o AS (PARTITION BY series, split ORDER BY ts ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING))
        SELECT series, split, ts, 24 AS steps, {len(_CHANNELS)} AS channels,
        {", ".join(f"{R(f'list_sum([{c}[i] * i for i in range(1, 25)])', 4)} AS {c}_sum" for c in _CHANNELS)},
        {R('LOAD[25]')} AS y1, {R('LOAD[26]')} AS y2 FROM w WHERE len(LOAD) = 26""",
)
def sliding_windows_all(spark, sf):
    """Samples of the prepared table, with the target and all of its features as channels, as ``sliding_windows`` condenses them."""
    p = prepared(spark, sf)
    data = rounded(p.data, *ROUND_IN_BASE)
    parts = p.series.with_keys("split")
    if p.once:  # where no step is absent either, times number the rows, which then move once
        parts = without_holes(p.data, parts)
    samples = sliding_windows(data, parts, p.features, p.target, seq_len=24, pred_len=2)
    return _condensed(samples, {f"{c}_sum": j for j, c in enumerate((p.target, *p.features))})

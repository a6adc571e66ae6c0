"""Exact quantiles by radix selection: a few passes of histograms, for all groups and ranks at once.

The built-in exact percentile keeps all distinct values of a group in one buffer, and ordering a group by a window puts it
into one task. Here every pass counts values by one more digit, keeps for each wanted rank the digit it falls into, and
goes on with the values of that digit only. Counts are combined before they move, so a group of any size
costs each task one histogram, and no values are ever ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.layout import join_by_series
from tidegrid.session import materialize

PER_OCTAVE = 32  # first digits for values up to twice as large
DIGITS = 4096  # digits of each later pass


def _first_digit(v: Column) -> Column:
    """Sign and logarithm of a value as a number that never falls where the value grows. Logarithms lie within +-35,000."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.rint(F.log2(F.abs(v)) * PER_OCTAVE) + 100_000))


def _next_digit(v: Column, lo: Column, hi: Column) -> Column:
    """Place of a value in equal parts of its range; the upper end has a digit of its own, so each pass gets ahead."""
    return F.when(v >= hi, float(DIGITS)).otherwise(F.floor((v - lo) / (hi - lo) * DIGITS).cast("double"))


def _chosen(hist: DataFrame, by: Sequence[str], rank: Column, below: Column) -> DataFrame:
    """Of each histogram (``digit, count, lo, hi`` per ``by``) the row whose values hold ``rank``, with the number of values below it."""
    upto = F.sum("count").over(Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    rows = hist.withColumn("__upto", below + upto)
    return rows.withColumn("below", F.col("__upto") - F.col("count")).where((F.col("below") <= rank) & (rank < F.col("__upto"))).drop("__upto", "digit", "count")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per group with values: ``keys``, ``n`` and one column per entry of ``quantiles``, linearly interpolated.

    NULL keys are a group. The values are written once (``scratch_scope`` removes them) and read by every pass: one for
    sign and logarithm and at most five for the rest of a double, but no more than the values need to be told apart.
    """
    names, qs = list(quantiles), list(quantiles.values())
    rows = materialize(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")), "values")
    v = F.col("__v")
    counted = [F.count(F.lit(1)).alias("count"), F.min(v).alias("lo"), F.max(v).alias("hi")]
    hist = rows.groupBy(*keys, _first_digit(v).alias("digit")).agg(*counted)
    hist = hist.withColumn("n", F.sum("count").over(Window.partitionBy(*keys)))
    h = [(F.col("n") - 1) * F.lit(q) for q in qs]
    ranks = F.array(*[F.struct(F.lit(i).alias("at"), r.cast("long").alias("rank")) for i, r in enumerate(f(x) for x in h for f in (F.floor, F.ceil))])
    targets = hist.select(*keys, "n", "digit", "count", "lo", "hi", F.inline(ranks))
    targets = materialize(_chosen(targets, [*keys, "at"], F.col("rank"), F.lit(0)), "ranks")
    while True:
        open_ = targets.where("lo < hi")
        if open_.isEmpty():
            break
        # targets in the same values share a histogram
        fields = ("at", "rank")
        shared = open_.groupBy(*keys, "n", "lo", "hi", "below").agg(F.collect_list(F.struct(*fields)).alias("__at"))
        ranges = shared.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("__ranges"))
        inside = join_by_series(rows, ranges, list(keys)).select(*keys, "__v", F.explode("__ranges").alias("__r"))
        inside = inside.where((v >= F.col("__r.lo")) & (v <= F.col("__r.hi"))).select(*keys, "__v", F.col("__r.lo").alias("from"), F.col("__r.hi").alias("to"))
        hist = inside.groupBy(*keys, "from", "to", _next_digit(v, F.col("from"), F.col("to")).alias("digit")).agg(*counted)
        wanted = shared.select(*keys, "n", F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("below").alias("before"), F.inline("__at"))
        hist = _attach(hist, wanted, [*keys, "from", "to"])
        found = _chosen(hist, [*keys, "at"], F.col("rank"), F.col("before")).select(*targets.columns)
        targets = materialize(targets.where("lo = hi").unionByName(found), "ranks")
    at = [F.max(F.when(F.col("at") == i, F.col("lo"))) for i in range(2 * len(qs))]
    return targets.groupBy(*keys, "n").agg(*[(at[2 * i] + (at[2 * i + 1] - at[2 * i]) * (x - F.floor(x))).alias(names[i]) for i, x in enumerate(h)])


def _attach(hist: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``hist`` for each rank that is ``wanted`` of them; NULL keys match NULL keys."""
    right = wanted.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return hist.join(right, same).drop(*[f"__{k}" for k in keys])

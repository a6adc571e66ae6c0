"""Recover true timestamps of rows whose raw text has several readings.

Input rows carry a consecutive position ``pos`` (file order) inside their series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.timestamps import best_in_range
from tidegrid.functions.epoch import from_epoch
from tidegrid.operators.layout import CHUNK, KEY, Series, join_by_series, placed

MARGIN_DAYS = 365  # how far the range of certain rows is widened on either side
READINGS = 4  # a text is cut before a year of four or two digits and after a month of one or two
BROKEN = (1 << 63) - 1  # the gap of a reading that breaks the order


def unambiguous_range(df: DataFrame, keys: tuple[str, ...], cands: str = "cands") -> DataFrame:
    """Per series: time range of the rows with exactly one reading, widened, and row counts."""
    only = F.when(F.size(cands) == 1, F.col(cands)[0])
    margin = F.expr(f"interval {MARGIN_DAYS} days")
    return df.groupBy(*keys).agg(
        (F.min(only) - margin).alias("range_start"),
        (F.max(only) + margin).alias("range_end"),
        F.count(only).alias("n_certain"),
        F.count_if(F.size(cands) > 1).alias("n_ambiguous"),
    )


def resolve_blocks(df: DataFrame, s: Series, pos: str = "pos", cands: str = "cands", most: int = READINGS) -> DataFrame:
    """Add ``ts``: one reading per row, chosen for whole blocks of ambiguous rows.

    ``cands`` holds the readings in seconds, at most ``most`` of them (more end the job). A block is a run of
    neighbouring rows with the same number (> 1) of readings. The readings of its first and last row and the certain
    rows around it are looked up inside the row's chunk and, where they lie outside, in one summary row per chunk, so each
    row computes the choice of its block on its own: no group holds a block, which may be arbitrarily long. Rows are
    shuffled once. Readings travel as single numbers, not as arrays: those are combined by hashing and need no sort.
    Rows without a position have no neighbours and take their first reading.
    """
    size, group = F.size(cands), [KEY, CHUNK]
    n, at, readings = F.col("__n"), F.col(pos), range(most)
    too_many = F.raise_error(F.lit(f"more than {most} readings")).cast("int")
    home = placed(at, df, s.chunk)
    # The chunk is named behind the shuffle: so rows and summary read the same columns of it, and it is written once.
    dealt = df.withColumn(KEY, F.struct(*s.keys)).repartition(F.col(KEY), home).withColumn(CHUNK, home)
    counted = dealt.withColumn("__n", F.when(size > most, too_many).otherwise(F.coalesce(size, F.lit(0))))
    chunk = Window.partitionBy(*group)
    marked = counted.select(
        "*", F.lag("__n", 1).over(chunk.orderBy(at)).alias("__prev_n"), F.lead("__n", 1).over(chunk.orderBy(at)).alias("__next_n")
    )
    # Where the number of readings changes inside the chunk; the runs at its two ends may go on outside.
    starts, ends = F.col("__prev_n") != n, F.col("__next_n") != n
    reading = [F.get(F.col(cands), F.lit(i)) for i in readings]
    certain = F.when(n == 1, reading[0])
    up = chunk.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    down = chunk.orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select(
        *df.columns,
        *group,
        n,
        F.last(certain, ignorenulls=True).over(up).alias("__low"),
        *[F.last(F.when(starts, x), ignorenulls=True).over(up).alias(f"__first_{i}") for i, x in enumerate(reading)],
        F.last(certain, ignorenulls=True).over(down).alias("__high"),
        *[F.last(F.when(ends, x), ignorenulls=True).over(down).alias(f"__last_{i}") for i, x in enumerate(reading)],
    )
    joined = local.join(_borders(marked.where(at.isNotNull()), n, at, reading, starts, ends), group, "left")
    # Rows of a block have as many readings as its ends, so what older blocks left behind an end's last reading isn't looked at.
    # Without any certain row in a series there is no range, and rows take their first reading:
    # no anchor is found on either side, every gap is 0, and the first reading wins.
    low, high = F.coalesce("__low", "__before.certain").alias("__low"), F.coalesce("__high", "__after.certain").alias("__high")
    firsts = [F.coalesce(f"__first_{i}", f"__before.r{i}").alias(f"__first_{i}") for i in readings]
    lasts = [F.coalesce(f"__last_{i}", f"__after.r{i}").alias(f"__last_{i}") for i in readings]
    # In steps, as what one expression names twice is computed twice, and long generated code isn't compiled.
    near = joined.select(*df.columns, n, low, high, *firsts, *lasts)
    heads = [F.coalesce(F.col(f"__first_{i}") - F.col("__low"), F.lit(0)).alias(f"__head_{i}") for i in readings]
    tails = [F.coalesce(F.col("__high") - F.col(f"__last_{i}"), F.lit(0)).alias(f"__tail_{i}") for i in readings]
    gaps = [F.when(n > i, _gap(F.col(f"__head_{i}"), F.col(f"__tail_{i}"))).alias(f"__gap_{i}") for i in readings]
    weighed = near.select(*df.columns, n, *heads, *tails).select(*df.columns, n, *gaps)
    # The first of the smallest; a row has as many gaps as readings.
    gap = [F.coalesce(F.col(f"__gap_{i}"), F.lit(BROKEN)) for i in readings]
    best = F.array_position(F.array(*gap), F.least(*gap, F.lit(BROKEN))).cast("int") - 1
    chosen = F.when((n == 1) | at.isNull(), reading[0]).when(n > 1, F.get(F.col(cands), best))
    return weighed.select(*df.columns, chosen.alias("__seconds")).select(
        *df.columns, from_epoch(F.col("__seconds")).alias(s.ts)
    )


def _borders(rows: DataFrame, n: Column, at: Column, reading: list[Column], starts: Column, ends: Column) -> DataFrame:
    """Per chunk what lies outside: ``__before`` and ``__after``.

    ``certain`` is the nearest certain reading before or after the chunk, ``r0``... are the readings where the run of the chunk's
    first row starts and where that of its last row ends, in this chunk or another.
    """

    def far_end(name: str, edge: Column, by: Callable, change: Column) -> list[Column]:
        """The row at one end of the chunk, and the other end of the run at the opposite end if the chunk holds it."""
        seen = [F.max(F.when(edge, x)).alias(f"__{name}_{i}") for i, x in enumerate(reading)]
        return [
            F.max(F.when(edge, n)).alias(f"__{name}_n"),
            F.max(F.when(change, F.lit(True))).alias(f"__{name}_cut"),
            by(reading[0], F.when(n == 1, at)).alias(f"__{name}_certain"),
            *seen,
            *[by(x, F.when(change, at)).alias(f"__{name}_far_{i}") for i, x in enumerate(reading)],
        ]

    summary = rows.groupBy(KEY, CHUNK).agg(
        *far_end("head", F.col("__prev_n").isNull(), F.max_by, starts), *far_end("tail", F.col("__next_n").isNull(), F.min_by, ends)
    )
    series = Window.partitionBy(KEY)

    def outside(df: DataFrame, name: str, opposite: str, order: Column, into: str) -> DataFrame:
        past = series.orderBy(order)
        own, far = ([F.col(f"__{name}{kind}_{i}").alias(f"r{i}") for i in range(len(reading))] for kind in ("", "_far"))
        goes_on = F.coalesce(F.lag(f"__{opposite}_n", 1).over(past) == F.col(f"__{name}_n"), F.lit(False))
        # The start of the run that leaves the chunk: its last change, its own first row, or that of a chunk before.
        begun = F.when(F.col(f"__{name}_cut"), F.struct(*far)).when(~F.col("__on"), F.struct(*own))
        last = F.last("__begun", ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, -1))
        anchor = F.last(f"__{name}_certain", ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, -1))
        known = df.withColumn("__on", goes_on).withColumn("__begun", begun).withColumn("__run", last).withColumn("__anchor", anchor)
        run = F.when(F.col("__on"), F.col("__run")).otherwise(F.struct(*own))
        fields = [run[f"r{i}"].alias(f"r{i}") for i in range(len(reading))]
        return known.withColumn(into, F.struct(F.col("__anchor").alias("certain"), *fields)).drop("__on", "__begun", "__run", "__anchor")

    both = outside(summary, "head", "tail", F.col(CHUNK), "__before")
    return outside(both, "tail", "head", F.col(CHUNK).desc(), "__after").select(KEY, CHUNK, "__before", "__after")


def _gap(head: Column, tail: Column) -> Column:
    """How well a reading of a block fits between the certain rows before and after; the smallest fits best."""
    # All readings that break the order are equally bad; the earlier one wins.
    return F.when((head < 0) | (tail < 0), F.lit(BROKEN)).otherwise(head + tail)


def parse_rowwise(df: DataFrame, ranges: DataFrame, s: Series, cands: str = "cands") -> DataFrame:
    """Row-by-row choice by the range of the series, without looking at neighbours."""
    joined = join_by_series(df, ranges, s.keys)
    ts = best_in_range(F.col(cands), F.col("range_start"), F.col("range_end"))
    return joined.select(*df.columns, ts.alias(s.ts))


def split_unparsed(df: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the quarantined rest."""
    return df.where(F.col(ts).isNotNull()), df.where(F.col(ts).isNull())

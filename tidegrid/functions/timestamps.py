"""Readings of timestamps written as month, day and year digits without separators.

``"112001 1:00"`` may be 2001-01-01 or 2001-11-20. Every helper is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.epoch import epoch_seconds

# Fixed values of the format: the years a four-digit year may take, the century of a
# two-digit year, and the bounds that stand in for an unknown side of a range.
FIRST_YEAR, LAST_YEAR = 2000, 2030
CENTURY = 2000
FAR_PAST, FAR_FUTURE = "1990-01-01 00:00:00", "2040-01-01 00:00:00"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds; both sides carry whole seconds in this format."""
    return epoch_seconds(later) - epoch_seconds(earlier)


def add_candidates(df: DataFrame, raw: str, into: str = "cands", seconds: bool = False) -> DataFrame:
    """Add all legal readings in order: four-digit year first, then two-digit month first.

    Readings are timestamps, or with ``seconds`` whole seconds since 1970 (what the block
    recovery works on).

    The text is cut once; the readings are integer arithmetic on the digits, so no reading is
    attempted that could fail.
    """
    text = F.btrim(F.col(raw), F.lit(" \t\n\r\f\v"))
    rest = F.substring_index(F.substring_index(text, " ", 2), " ", -1)
    cut = df.select(
        "*",
        F.substring_index(text, " ", 1).alias("__digits"),
        F.when(F.instr(text, " ") > 0, F.substring_index(rest, ":", 1).try_cast("int")).alias("__hour"),
    )
    digits = F.col("__digits")
    plain = (F.translate(digits, "0123456789", "") == "") & F.length(digits).between(4, 8)
    numbers = cut.select(
        *df.columns, "__hour", F.length(digits).alias("__size"), F.when(plain, digits.try_cast("int")).alias("__number")
    )
    # Steps of their own: inside one expression Spark would write out, and compute, a month or a day anew wherever it is used,
    # and generated code of that length would not be compiled.
    split = numbers.select(*df.columns, "__hour", "__size", *_split("a", FULL_YEAR), *_split("b", FULL_YEAR + 1))
    dated = split.select(*df.columns, "__hour", "__size", *_dated("a", F.col("__size") == 8), *_dated("b", F.lit(True)))
    kind = "bigint" if seconds else "timestamp_ntz"
    every = F.array(_reading("a", seconds), F.when(F.col("__size").between(5, 7), _reading("b", seconds)))
    # Absent readings go without a lambda, which would be interpreted with all that is inside. The two readings of a text
    # differ: in the month, or in a day of one digit and one of two.
    return dated.select(*df.columns, F.array_except(every, F.array(F.lit(None).cast(kind))).alias(into))


# A text of 4 to 8 digits has at most two readings, ``a`` and ``b`` in their order. Digits of year, month and day:
# 4: a 2 1 1; 5: a 2 2 1, b 2 1 2; 6: a 4 1 1, b 2 2 2; 7: a 4 2 1, b 4 1 2; 8: a 4 2 2.
FULL_YEAR = 6  # from this length on ``a`` has a year of four digits, ``b`` from the next


def _div(number: Column, base: int) -> Column:
    return F.call_function("div", number, F.lit(base)).cast("int")


def _split(name: str, full: int) -> list[Column]:
    """The year, NULL if it is not legal, and the digits before it."""
    number, long = F.col("__number"), F.col("__size") >= full
    whole = number % 10000
    year = F.when(long, F.when(whole.between(FIRST_YEAR, LAST_YEAR), whole)).otherwise(number % 100 + CENTURY)
    return [year.alias(f"__year_{name}"), F.when(long, _div(number, 10000)).otherwise(_div(number, 100)).alias(f"__front_{name}")]


def _dated(name: str, two: Column) -> list[Column]:
    """Year, month and day, which has ``two`` digits or one."""
    front, year = F.col(f"__front_{name}"), F.col(f"__year_{name}")
    month = F.when(two, _div(front, 100)).otherwise(_div(front, 10))
    return [year, month.alias(f"__month_{name}"), F.when(two, front % 100).otherwise(front % 10).alias(f"__day_{name}")]


def _reading(name: str, seconds: bool) -> Column:
    """The reading, NULL if it is not legal."""
    year, month, day, hour = (F.col(c) for c in (f"__year_{name}", f"__month_{name}", f"__day_{name}", "__hour"))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last_day = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    legal = month.between(1, 12) & (day >= 1) & (day <= last_day) & hour.between(0, 23)
    if seconds:
        date = F.make_date(year, month, day)
        return F.when(legal, F.unix_date(date).cast("long") * 86400 + hour * 3600)
    zero = F.lit(0)
    return F.when(legal, F.try_make_timestamp_ntz(year, month, day, hour, zero, zero.cast("decimal(8,6)")))


def greedy(cands: Column) -> Column:
    """The first reading, NULL if there is none."""
    return F.try_element_at(cands, F.lit(1))


def best_in_range(cands: Column, low: Column, high: Column) -> Column:
    """Choose a reading by a known time range (either side may be NULL).

    Inside the range the one nearest to its centre wins, otherwise the one nearest to an edge;
    the earlier reading wins ties. Without any range the first reading is taken.
    """
    a = F.coalesce(low, _ntz(FAR_PAST))
    b = F.coalesce(high, _ntz(FAR_FUTURE))
    span = F.greatest(seconds_between(b, a), F.lit(0))
    span = F.when(span > 0, span).otherwise(F.lit(3600))

    def rank(c: Column, i: Column) -> Column:
        inside = (c >= a) & (c <= b)
        centre = F.abs(seconds_between(c, a) * 2 - seconds_between(b, a)) / 2
        edge = F.when(c < a, seconds_between(a, c)).otherwise(seconds_between(c, b))
        gap = F.when(inside, centre).otherwise(edge) / span
        return F.struct(
            F.when(inside, 0).otherwise(1).alias("outside"), gap.alias("gap"), i.alias("i"), c.alias("c")
        )

    chosen = F.array_min(F.transform(cands, rank))["c"]
    return F.when(low.isNull() & high.isNull(), greedy(cands)).otherwise(chosen)


def parse_date_and_hour(date: Column | str, hour: Column | str) -> Column:
    """``M/D/YYYY`` plus an hour column."""
    date = F.col(date) if isinstance(date, str) else date
    hour = (F.col(hour) if isinstance(hour, str) else hour).try_cast("int")
    part = F.split(date, "/")
    month, day, year = [F.try_element_at(part, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, hour, zero, zero.cast("decimal(8,6)"))

"""Zone-less timestamps to seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a zone-less timestamp, independent of the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def from_epoch(seconds: Column) -> Column:
    """Inverse of :func:`epoch_seconds`."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    return origin + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))

"""Skewness and kurtosis of trailing frames, for Arrow batches of rows in time order.

As window aggregates they update four moments for every row of every frame, without generated code for the whole; here a
frame's deviations from its own mean are summed by numpy, so nothing cancels and no frame depends on the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

STATS = ("skew", "kurt")
VALUES = 1 << 18  # of all frames that are held at a time


def of_frame(x, known, stat: str, need: int):
    """``stat`` of each row of ``x`` over the places marked in ``known``; NaN and False where there is no result."""
    import numpy as np

    n = known.sum(axis=1).astype(float)
    zero = np.where(known, x, 0.0)
    with np.errstate(all="ignore"):
        mean = zero.sum(axis=1) / n
        d = np.where(known, x - mean[:, None], 0.0)
        square = d * d
        m2 = square.sum(axis=1)
        if stat == "skew":
            out = np.sqrt(n) * (square * d).sum(axis=1) / (m2 * np.sqrt(m2)) * np.sqrt(n * (n - 1)) / (n - 2)
            least, flat = 3, 0.0
        else:
            out = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * (square * square).sum(axis=1) / (m2 * m2) - 3) + 6)
            least, flat = 4, -3.0
    nan = np.isnan(x) & known  # NaN is a value, and equal to itself
    same = np.where(known, x, np.inf).min(axis=1) == np.where(known, x, -np.inf).max(axis=1)
    same |= nan.sum(axis=1) == n
    return np.where(same, flat, out), (n >= max(need, least)) & (same | (m2 != 0))


def trailing(df: DataFrame, group: str, frames: dict[str, tuple[str, str, int, int, int]]) -> DataFrame:
    """Add a column per frame (name -> statistic, column, first and last row from the current one, rows needed).

    ``df`` is in order within each partition; ``group`` is a number that changes from one group of rows to the next. A task holds one
    batch and the rows before it that a frame reaches.
    """
    back = max(-f[2] for f in frames.values())
    columns: Sequence[str] = sorted({f[1] for f in frames.values()})

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tail = {c: (np.zeros(back), np.zeros(back, bool)) for c in columns}
        groups = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(group).to_numpy(zero_copy_only=False)
            groups = own if groups is None else np.concatenate([groups, own])
            at = np.arange(len(groups))
            changed = np.concatenate([[True], groups[1:] != groups[:-1]])
            pad = back - (len(groups) - len(own))  # places before the first row of the partition
            begin = np.maximum.accumulate(np.where(changed, at, 0))[-len(own) :] + pad
            held = {}
            for c in columns:
                column = batch.column(c)
                held[c] = (
                    np.concatenate([tail[c][0], column.fill_null(0.0).to_numpy(zero_copy_only=False)]),
                    np.concatenate([tail[c][1], column.is_valid().to_numpy(zero_copy_only=False)]),
                )
            made = [_column(held[c], begin, back, stat, first, last, need) for stat, c, first, last, need in frames.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *frames])
            tail = {c: (x[len(x) - back :], k[len(k) - back :]) for c, (x, k) in held.items()}
            groups = groups[max(len(groups) - back, 0) :]

    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in frames]])
    return df.mapInArrow(run, schema)


def _column(held, begin, back: int, stat: str, first: int, last: int, need: int):
    import numpy as np
    import pyarrow as pa

    size, rows = last - first + 1, len(begin)
    x, known = (np.lib.stride_tricks.sliding_window_view(a, size) for a in held)
    values, valid = np.zeros(rows), np.zeros(rows, bool)
    step = max(1, VALUES // size)
    for i in range(0, rows, step):
        j = min(i + step, rows)
        start = np.arange(i, j) + back + first  # of the frame, among the held rows
        inside = known[start[0] : start[-1] + 1] & (start[:, None] + np.arange(size) >= begin[i:j, None])
        values[i:j], valid[i:j] = of_frame(x[start[0] : start[-1] + 1], inside, stat, need)
    return pa.array(values, mask=~valid)

"""How a set of time series is laid out over the cluster.

A window partitioned by the series key alone puts a whole series into one task, so a
single long series (or one that holds a third of all rows) never runs in parallel. Here
every ordered operator works on ``(series, chunk)`` groups instead, where a chunk is a
fixed number of consecutive positions:

* bounded look-back or look-ahead (lags, rolling frames, samples): each chunk receives
  copies of the few neighbouring rows it has to see (``windowed``);
* unbounded look-back (forward fill and relatives): one summary row per chunk carries the
  nearest value over the chunk border (``carry``);
* exact row numbers: rows are numbered inside their chunk and shifted by the row counts of
  the chunks before (``index_rows``).

A series has at most one row per time step (plus a few duplicates), therefore a chunk never
holds more than about ``chunk`` rows, however the rows are spread over series. ``step`` has to
fit the data: readings much denser than the step make chunks that much larger, unless ``fitted`` makes it finer.

No row is lost: rows whose key is NULL are a series of their own (keys are joined as one struct,
in which NULL equals NULL), and rows without a time have no position, get NULL for everything
that depends on order, and lie in spare chunks, spread by a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.epoch import epoch_seconds

CHUNK = "__chunk"
POS = "__pos"
SLOT = "__slot"
HOME = "__home"
KEY = "__key"
SPARE = 1024  # chunks for the rows without a position


@dataclass(frozen=True)
class Series:
    """Names and granularity of a collection of series.

    ``step`` is the time step in seconds, ``chunk`` the number of positions per task group.
    ``complete`` states that no step is absent, so the time slot itself numbers the rows.
    ``ties`` orders rows of equal time.
    """

    keys: tuple[str, ...] = ("series",)
    ts: str = "ts"
    step: float = 3600
    chunk: int = 65536
    complete: bool = False
    ties: tuple[str, ...] = ()

    def with_keys(self, *extra: str) -> Series:
        return replace(self, keys=self.keys + extra)


def slot_of(s: Series) -> Column:
    return F.floor(epoch_seconds(s.ts) / F.lit(s.step))


def fitted(df: DataFrame, s: Series) -> Series:
    """``s`` with a step so fine that no chunk of ``df`` holds more than twice ``chunk`` rows, whatever their density.

    Each look is one aggregate of keys and times. Rows of one instant can't be told apart by time; where only such rows
    are left in the fullest chunk, the step stays. The result numbers rows and cuts windows; its grid isn't complete.
    """
    while True:
        chunks = df.where(F.col(s.ts).isNotNull()).groupBy(*s.keys, chunk_of(slot_of(s), s.chunk).alias(CHUNK))
        size = chunks.agg(F.count(F.lit(1)).alias("n"), (F.max(s.ts) > F.min(s.ts)).alias("wide"))
        fullest = size.agg(F.max(F.struct("n", "wide")).alias("x")).select("x.*").first()
        if fullest.n is None or fullest.n <= 2 * s.chunk or not fullest.wide or s.step * s.chunk <= 1:
            return s
        s = replace(s, step=s.step * s.chunk / fullest.n, complete=False)


def without_holes(df: DataFrame, s: Series) -> Series:
    """``s`` as a complete series, if each series of ``df`` has a row at every step from its first to its last; else ``s``.

    Holds where no two rows of a series lie in one step. A row without a time counts as a hole. Costs one aggregate of keys and times.
    """
    steps = F.max(slot_of(s)) - F.min(slot_of(s)) + 1
    whole = (F.count(F.lit(1)) == F.count(s.ts)) & (F.count(s.ts) == F.coalesce(steps, F.lit(0)))
    broken = df.groupBy(*s.keys).agg(whole.alias("whole")).agg(F.count_if(~F.col("whole"))).first()[0]
    return replace(s, complete=not broken)


def chunk_of(pos: Column | str, size: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size))


def placed(pos: Column, df: DataFrame, size: int) -> Column:
    """The chunk of a position; rows without one are spread over spare chunks far below all others."""
    hashed = [F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return F.when(pos.isNotNull(), F.floor(pos / F.lit(size))).otherwise(-(1 << 40) - F.pmod(F.xxhash64(*hashed), F.lit(SPARE)))


def index_rows(df: DataFrame, s: Series, into: str = POS, total: str | None = None) -> DataFrame:
    """Exact 0-based row number of each row within its series, in time order.

    Costs one counting pass (partially aggregated to one row per chunk) and one shuffle by
    ``(series, chunk)``. ``total`` additionally names a column for the row count of the series.
    Rows without a time get no number and don't count.
    """
    slot = slot_of(s)
    keyed = df.withColumn(KEY, F.struct(*s.keys)).withColumn(CHUNK, placed(slot, df, s.chunk))
    group = [KEY, CHUNK]
    timed = F.col(s.ts).isNotNull()
    counts = keyed.where(timed).groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(KEY)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    columns = [*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")]
    if total:
        columns.append(F.sum("__n").over(whole).alias(total))
    inside = Window.partitionBy(*group).orderBy(s.ts, *s.ties)
    number = F.col("__before") + F.row_number().over(inside) - 1
    return keyed.join(counts.select(*columns), group, "left").withColumn(into, F.when(timed, number)).drop(KEY, CHUNK, "__before")


def positions(df: DataFrame, s: Series, into: str = POS) -> DataFrame:
    """Consecutive row positions; free of charge when the grid has no holes."""
    if s.complete:
        return df.withColumn(into, slot_of(s))
    return index_rows(df, s, into)


def _spread(df: DataFrame, s: Series, before: int, after: int, pos: str | None) -> tuple[DataFrame, DataFrame, str]:
    """``df`` with positions, its rows in the chunk they belong to (``HOME``) and in those that look at them (``CHUNK``), and the position's name."""
    if pos is None:
        pos = POS
        df = positions(df, s, pos)
    size = max(s.chunk, before, after, 1)
    home = placed(F.col(pos), df, size)
    offset = F.col(pos) - home * size
    targets = [home]
    if before:
        targets.append(F.when(offset >= size - before, home + 1))
    if after:
        targets.append(F.when(offset < after, home - 1))
    if len(targets) > 1:
        # Most rows have one target only; dropping the NULLs afterwards stays in generated code.
        spread = df.withColumn(HOME, home).withColumn(CHUNK, F.explode(F.array(*targets)))
        spread = spread.where(F.col(CHUNK).isNotNull())
    else:
        spread = df.withColumn(HOME, home).withColumn(CHUNK, F.col(HOME))
    return df, spread, pos


def windowed(
    df: DataFrame,
    s: Series,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    before: int = 0,
    after: int = 0,
    pos: str | None = None,
    then: Callable[[WindowSpec], Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Append window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``build`` receives the ordered window and returns the new columns by name. The window is
    cut into chunks; rows near a border are copied to the neighbour chunk and dropped afterwards.
    Rows without a position get NULL. ``then`` builds from these columns, over the same window and without
    another shuffle, the columns that are returned in their place; both steps together look ``before`` rows back.
    """
    own = pos is None
    columns = df.columns
    df, spread, pos = _spread(df, s, before, after, pos)
    window = Window.partitionBy(*s.keys, CHUNK).orderBy(pos)
    added = build(window)
    if then is not None:
        spread, added = spread.select("*", *[c.alias(n) for n, c in added.items()]), then(window)
    kept = [c for c in columns if c not in added and not (own and c == POS)]
    return (
        spread.select(*kept, HOME, CHUNK, *[F.when(F.col(pos).isNotNull(), c).alias(n) for n, c in added.items()])
        .where(F.col(HOME) == F.col(CHUNK))
        .drop(HOME, CHUNK)
    )


def ordered(df: DataFrame, s: Series, add: Callable[[DataFrame, str], DataFrame], before: int, pos: str | None = None) -> DataFrame:
    """Append columns that ``add(rows, group)`` makes from rows in time order, with at most ``before`` rows looked back.

    The counterpart of :func:`windowed` for Arrow batches: rows come sorted by series, chunk and position, and ``group``
    names a number that differs from one chunk to the next. Rows without a position get NULL.
    """
    own = pos is None
    columns = df.columns
    df, spread, pos = _spread(df, s, before, 0, pos)
    flags = [c for k in s.keys for c in (F.col(k).isNull(), F.col(k))]
    marked = spread.withColumn(KEY, F.xxhash64(*flags, F.col(CHUNK)))
    made = add(marked.repartition(*s.keys, CHUNK).sortWithinPartitions(*s.keys, CHUNK, pos), KEY)
    added = [c for c in made.columns if c not in marked.columns]
    kept = [c for c in columns if not (own and c == POS)]
    whole = made.where(F.col(HOME) == F.col(CHUNK))
    return whole.select(*kept, *[F.when(F.col(pos).isNotNull(), F.col(c)).alias(c) for c in added])


def carry(
    df: DataFrame,
    s: Series,
    pos: str,
    forward: Mapping[str, Column] | None = None,
    backward: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Nearest non-null value at or before (``forward``) / at or after (``backward``) each row.

    The summary (one row per chunk) is scanned in order per series; the rows themselves are
    only ever ordered inside their chunk. Look-ahead uses a descending window: a frame ending
    at unbounded following would be recomputed from scratch for every row. Rows without a position
    keep their own value and give none to others.
    """
    forward, backward = dict(forward or {}), dict(backward or {})
    group = [KEY, CHUNK]
    at = F.col(pos)
    data = df.withColumn(KEY, F.struct(*s.keys)).withColumn(CHUNK, placed(at, df, s.chunk))
    summary = data.where(at.isNotNull()).groupBy(*group).agg(
        *[F.max_by(e, F.when(e.isNotNull(), at)).alias(f"__l_{n}") for n, e in forward.items()],
        *[F.min_by(e, F.when(e.isNotNull(), at)).alias(f"__r_{n}") for n, e in backward.items()],
    )
    series = Window.partitionBy(KEY)
    past = series.orderBy(F.col(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    future = series.orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    borders = summary.select(
        *group,
        *[F.last(f"__l_{n}", ignorenulls=True).over(past).alias(f"__l_{n}") for n in forward],
        *[F.last(f"__r_{n}", ignorenulls=True).over(future).alias(f"__r_{n}") for n in backward],
    )
    chunk = Window.partitionBy(*group)
    up = chunk.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    down = chunk.orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, 0)
    # The borders join after the windows, so their columns are not dragged through the sorts.
    timed = at.isNotNull()
    local = data.select(
        *df.columns,
        *group,
        *[F.when(timed, F.last(e, ignorenulls=True).over(up)).otherwise(e).alias(f"__f_{n}") for n, e in forward.items()],
        *[F.when(timed, F.last(e, ignorenulls=True).over(down)).otherwise(e).alias(f"__b_{n}") for n, e in backward.items()],
    )
    return local.join(borders, group, "left").select(
        *df.columns,
        *[F.coalesce(f"__f_{n}", f"__l_{n}").alias(n) for n in forward],
        *[F.coalesce(f"__b_{n}", f"__r_{n}").alias(n) for n in backward],
    )


def join_by_series(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per series to all rows of that series; rows of series without one get NULL.

    NULL keys match NULL keys. Spark broadcasts ``stats`` where its measured size allows it; beyond
    that the rows of a hot series are split over tasks by the skew handling of adaptive execution,
    which copies only that series' row of ``stats``.
    """
    right = stats.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(right, same, "left").drop(*[f"__{k}" for k in keys])

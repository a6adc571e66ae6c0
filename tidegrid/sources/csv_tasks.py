"""Load and weather files: one training file per task, and a truth file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.timestamps import add_candidates, parse_date_and_hour
from tidegrid.operators.clean import to_numeric
from tidegrid.operators.layout import Series
from tidegrid.operators.recover import resolve_blocks, split_unparsed
from tidegrid.session import materialize

STATIONS = tuple(f"w{i}" for i in range(1, 26))
# "Task 7/...", "Task%207/..." and "task_id=7/..." all name task 7; other paths are task 0.
TASK_PATTERN = r"[Tt]ask(?:_id)?(?:%20|[ _=])*(\d+)"


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LINE = ("__file", "__block", "__id")  # where a line comes from: file, start of the split in it, increasing id


def read_lines(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """All-text CSV rows with ``task_id`` and the columns of ``LINE``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    task = F.coalesce(F.regexp_extract("_metadata.file_path", TASK_PATTERN, 1).try_cast("int"), F.lit(0))
    return (
        spark.read.schema(_text_schema(names))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .csv(paths)
        .select(
            task.alias("task_id"),
            *names,
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__id"),
        )
    )


def number_lines(lines: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """``task_id``, ``names``, ``__id`` and ``pos``, the exact line number within the task, of the rows of ``read_lines``.

    A split of a file is read by one task from front to back, so the line number is the position inside the split plus
    the row counts of the splits before. The summary has one row per split; where it is too large to be broadcast, the
    columns named here are what moves, so name only those that the order is needed for.
    """
    # The parts of a file written as a folder follow each other by name.
    splits = lines.groupBy("task_id", "__file", "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first")
    )
    earlier = (
        Window.partitionBy("task_id").orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = splits.select(
        "__file", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    thin = lines.select("task_id", *names, *LINE)
    return thin.join(starts, ["__file", "__block"]).select(
        "task_id", *names, "__id", (F.col("__before") + F.col("__id") - F.col("__first")).alias("pos")
    )


def read_in_file_order(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """All-text CSV rows with ``task_id`` and ``pos``, the exact line number within the task."""
    return number_lines(read_lines(spark, paths, names), names).drop("__id")


def scan_train_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    stations: Sequence[str] = STATIONS,
    chunk: int = 65536,
) -> DataFrame:
    """Training rows: true ``ts``, ``ZONEID``, numeric ``LOAD`` and stations, ``task_id``.

    Rows whose timestamp has no legal reading are left out (see ``scan_quarantine``).
    """
    return split_unparsed(_resolved(spark, paths, stations, chunk))[0].drop("TIMESTAMP")


def scan_quarantine(
    spark: SparkSession, paths: str | Sequence[str], stations: Sequence[str] = STATIONS, chunk: int = 65536
) -> DataFrame:
    """The rows ``scan_train_csv`` leaves out, with their raw timestamp."""
    return split_unparsed(_resolved(spark, paths, stations, chunk))[1].drop("ts")


def _resolved(spark, paths, stations, chunk) -> DataFrame:
    names = ["ZONEID", "TIMESTAMP", "LOAD", *stations]
    # The text is parsed once. Numbering and recovery read the timestamps only; the other columns move once, by line,
    # when every line has its time.
    lines = materialize(read_lines(spark, paths, names), "lines")
    dated = add_candidates(number_lines(lines, ["TIMESTAMP"]), "TIMESTAMP", seconds=True)
    times = resolve_blocks(dated, Series(keys=("task_id",), chunk=chunk)).select("__id", "ts")
    timed = lines.join(times, "__id")
    return timed.select(
        "task_id",
        "ts",
        F.col("ZONEID").try_cast("int").alias("ZONEID"),
        *[to_numeric(c).alias(c) for c in ("LOAD", *stations)],
        "TIMESTAMP",
    )


def scan_all_tasks(
    spark: SparkSession, data_dir: str, stations: Sequence[str] = STATIONS, chunk: int = 65536
) -> DataFrame:
    """Every ``Task n/Ln-train.csv`` below a folder in one scan; absent tasks are simply absent."""
    return scan_train_csv(spark, f"{data_dir.rstrip('/')}/Task */L*-train.csv", stations, chunk)


def scan_solution(spark: SparkSession, path: str, stations: Sequence[str] = STATIONS) -> DataFrame:
    """Truth rows: ``ts`` from ``date`` (M/D/YYYY) and ``hour``, numeric measures."""
    names = ["date", "hour", "LOAD", *stations]
    rows = spark.read.schema(_text_schema(names)).option("header", True).csv(path)
    return rows.select(
        parse_date_and_hour("date", "hour").alias("ts"),
        *[to_numeric(c).alias(c) for c in ("LOAD", *stations)],
    )

"""Result tables. Every writer is a plain distributed write; small reports may be one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.metrics import with_errors
from tidegrid.operators.profile import importance_share


def write_predictions(df: DataFrame, path: str, keys: Sequence[str], y: str, p: str, fmt: str = "parquet") -> None:
    """Actual, prediction, error (actual - prediction) and absolute error."""
    out = with_errors(df.select(*keys, F.col(y).alias("actual"), F.col(p).alias("prediction")), "actual", "prediction")
    out.write.mode("errorifexists").format(fmt).option("header", True).save(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One JSON record per row of ``metrics``."""
    metrics.write.mode("errorifexists").json(path)


def write_importance(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """Feature gains with their share, largest first."""
    ordered = importance_share(table).orderBy(F.col("importance_gain").desc(), F.col("feature"))
    ordered.write.mode("errorifexists").format(fmt).option("header", True).save(path)


def append_history(rows: DataFrame, path: str, run: Sequence[str] = (), iteration: str = "iteration") -> None:
    """Add rounds to a history. Each (run, iteration) is a folder that its rows replace, so a round that is appended again,
    by a retry or a rerun, is there once; other rounds stay as they are."""
    keys = [*run, iteration]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def best_features_lines(best: DataFrame) -> DataFrame:
    """Text lines of the best-feature report: a header of comment lines, then one name per line.

    ``best``: ``iteration, rmse, pos, feature``.
    """
    head = best.groupBy("iteration", "rmse").agg(F.count(F.lit(1)).alias("n"))
    lines = head.select(
        F.posexplode(
            F.array(
                F.format_string("# best feature set (iteration %d)", "iteration"),
                F.concat(F.lit("# val RMSE: "), F.col("rmse").cast("string")),
                F.format_string("# number of features: %d", "n"),
                F.lit(""),
            )
        ).alias("i", "value")
    ).select((F.col("i") - 4).cast("long").alias("line"), "value")
    return lines.unionByName(best.select(F.col("pos").cast("long").alias("line"), F.col("feature").alias("value")))


def write_best_features(best: DataFrame, path: str) -> None:
    """Text parts in line order (the parts follow each other by name)."""
    best_features_lines(best).orderBy("line").select("value").write.text(path)

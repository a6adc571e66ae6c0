"""Irregular readings -> one row per series and time step."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.epoch import epoch_seconds, from_epoch
from tidegrid.operators.layout import CHUNK, Series, chunk_of


def regularize(
    readings: DataFrame, s: Series, measures: Mapping[str, Column], inputs: tuple[str, ...]
) -> DataFrame:
    """Aggregate readings per step and add the absent steps with NULL measures.

    ``measures`` are aggregate expressions over the ``inputs`` columns; they must yield NULL for
    no input. Only steps with readings and the ends of each series' chunks move: rows of a hot series are combined
    before, and the absent steps are made behind the last shuffle, each chunk's from the distance to its next step.
    """
    slot = F.floor(epoch_seconds(s.ts) / F.lit(s.step))
    rows = readings.select(*s.keys, slot.alias("__slot"), *inputs)
    span = rows.groupBy(*s.keys).agg(F.min("__slot").alias("lo"), F.max("__slot").alias("hi"))
    size = s.chunk
    pieces = span.select(
        *s.keys,
        "lo",
        "hi",
        F.explode(
            F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))
        ).alias("piece"),
    )
    ends = F.array(F.greatest("lo", F.col("piece") * size), F.least("hi", F.col("piece") * size + (size - 1)))
    known = (
        rows.unionByName(pieces.select(*s.keys, F.explode(ends).alias("__slot")), allowMissingColumns=True)
        .groupBy(*s.keys, "__slot")
        .agg(*[expr.alias(name) for name, expr in measures.items()])
    )
    # A fixed number of tasks: adaptive execution would size them by the few bytes before the absent steps are made.
    tasks = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = known.withColumn(CHUNK, chunk_of("__slot", size)).repartition(tasks, *s.keys, CHUNK)
    following = F.lead("__slot").over(Window.partitionBy(*s.keys, CHUNK).orderBy("__slot"))
    last = F.coalesce(following - 1, "__slot")
    steps = F.when(F.col("__slot").isNotNull(), F.sequence("__slot", last)).otherwise(F.array(F.lit(None).cast("long")))
    every = placed.withColumn("__steps", steps).select(*s.keys, "__slot", *measures, F.explode("__steps").alias("__at"))
    first = F.col("__at").eqNullSafe(F.col("__slot"))
    return every.select(*s.keys, from_epoch(F.col("__at") * s.step).alias(s.ts), *[F.when(first, F.col(m)).alias(m) for m in measures])

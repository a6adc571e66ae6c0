"""Text and storage helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import scratch_path

# The white space and the letters that the text rules name.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``A-Z`` in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased runs without white space; NULL and empty text have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BLANK + "+"), lambda w: w != "")


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


class Scratch:
    """Tables an operator writes to the folder all executors share, so that a lost executor costs no lineage.

    ``keep`` writes and reads back; ``drop`` removes tables that no later plan reads. The rest goes when the
    ``scratch_scope`` ends in which the object was made, or stays for its results to be read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """``parts``: columns by whose values the files are laid out."""
        path = self.path(name)
        (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.drop_path(df._scratch)

    def drop_path(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the query ``name`` and, where SQL can say the same, its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register

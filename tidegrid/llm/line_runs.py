"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import BLANKS, Scratch, ascii_lower


def lines_of(text: Column) -> Column:
    """Split at line feeds; NULL and empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends and A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """How many documents hold each line, as levels of sorted runs of (h1, h2, n), 128 bits of hash each.

    Every batch is merge-anti-joined with the keys already settled (known to be in ``min_docs`` documents), and what is
    left is added as a sorted run of level 0. ``fanout`` runs of a level are compacted into one of the next level; keys
    that reach ``min_docs`` on the way are settled and leave the runs, so settled tables and runs share no key. Runs live in
    the shared folder, compacted ones are removed, and all counts are sums, so batches may come in any number and order
    as long as a document is in one batch only.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, scratch: Scratch | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.scratch = scratch or Scratch(spark, "line-runs")
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []
        self.compactions = 0

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2, doc) rows, ``doc`` identifying the document; repeated rows count once."""
        counts = batch.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"))
        if self.settled:
            counts = counts.join(self._union(self.settled).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._run(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level, level + 1)
            level += 1

    def repeated(self) -> DataFrame:
        """(h1, h2) of all lines in at least ``min_docs`` documents."""
        for level in range(len(self.levels) - 1):  # what is left of every level goes up
            self._compact(level, level + 1)
        if len(self.levels[-1]) > 1:
            self._compact(len(self.levels) - 1, len(self.levels))
        last = [run.filter(F.col("n") >= self.min_docs).select("h1", "h2") for run in self.levels[-1]]
        return self._union([*last, *self.settled])

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    def _run(self, counts: DataFrame) -> DataFrame:
        return self.scratch.keep(counts.sortWithinPartitions("h1", "h2"), "run")

    def _compact(self, level: int, to: int) -> None:
        """The runs of a level as one run of the next. A run by itself just moves."""
        if len(self.levels) == to:
            self.levels.append([])
        runs, self.levels[level] = self.levels[level], []
        if len(runs) < 2:
            self.levels[to] += runs
            return
        self.compactions += 1
        summed = self._run(self._union(runs).groupBy("h1", "h2").agg(F.sum("n").alias("n")))
        ready = self.scratch.keep(summed.filter(F.col("n") >= self.min_docs).select("h1", "h2").sortWithinPartitions("h1", "h2"), "settled")
        if ready.isEmpty():
            self.scratch.drop(ready)
        else:
            self.settled.append(ready)
        rest = summed.filter(F.col("n") < self.min_docs)
        rest._scratch = summed._scratch
        self.levels[to].append(rest)
        self.scratch.drop(*runs)


def batches_for(rows: int) -> int:
    """Batches for a table of so many documents: five, and one more at each doubling beyond 16,384."""
    return 5 + max(0, (rows >> 14).bit_length())


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 2, scratch: Scratch | None = None, counts: bool = True
) -> DataFrame:
    """``docs`` with a new ``text`` without the lines whose key is in at least ``min_docs`` documents.

    Adds n_lines and n_dropped unless ``counts`` is false, in place of columns of these names; all other columns stay as
    they are, whatever their names. Keys shorter than ``min_chars`` code points are never dropped. A document is a
    ``doc_id``; rows with the same id count once, rows without an id count by their text. A text that loses all lines is
    empty, and so is a NULL text. An empty table stays empty.

    Documents are dealt to ``batches`` by a hash (their number grows with the table, see ``batches_for``), which
    ``LineRuns`` takes in one after the other. The texts move once: what to drop is found on (id, text hash, position,
    line hash) rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    batches = batches or batches_for(docs.count())
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    doc = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), tag)).otherwise(F.xxhash64(F.lit("id"), F.col("doc_id")))
    base = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), tag.alias("tag"))  # the caller's columns apart
    keys = F.transform(lines_of(F.col("row.text")), line_key)
    spread = base.select("doc", "tag", F.posexplode(keys).alias("pos", "key")).filter(F.char_length("key") >= min_chars)
    lines = spread.select("doc", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), F.pmod("doc", F.lit(batches)).cast("int").alias("batch"))
    lines = scratch.keep(lines, "hashes", "batch")
    runs = LineRuns(spark, min_docs, fanout, scratch)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("h1", "h2", "doc"))
    drop = lines.join(runs.repeated(), ["h1", "h2"], "left_semi").groupBy("doc", "tag").agg(F.collect_set("pos").alias("drop"))
    none = F.array().cast("array<int>")
    rows = base.join(drop, ["doc", "tag"], "left").select("row", F.coalesce("drop", none).alias("drop"), lines_of(F.col("row.text")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.size("drop") == 0, F.coalesce("row.text", F.lit(""))).otherwise(kept)
    told = ("n_lines", "n_dropped") if counts else ()
    out = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in told]
    if counts:
        out += [F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped")]
    return rows.select(*out)

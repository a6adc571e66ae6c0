"""Documents to packed training sequences: toxicity, lines, near duplicates, benchmark passages, packing.

Every stage gets the rows its predecessor kept, with the columns of ``documents``, and the last returns where each
document goes. Rows without a doc_id and texts without words pass all filters; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, fold, table
from tidegrid.llm.decontaminate import without_leaks
from tidegrid.llm.line_runs import drop_repeated_lines
from tidegrid.llm.ngram_join import without_near_copies
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.toxicity import fit_toxicity, without_toxic
from tidegrid.session import scratch_scope


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, learned from four fifths of the labels, doesn't call toxic."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), use=fold(F.col("doc_id"), 5) != 0)
    return without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that are in ten or more documents; a document that loses all of them stays, empty."""
    out = drop_repeated_lines(docs, min_docs=10, counts=False)
    if "n_chars" not in docs.columns:
        return out
    chars = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
    return out.withColumn("n_chars", chars)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles, one row stays: the least by doc_id, hash of
    the text, other columns. Repeated rows are one document; texts that share a doc_id are judged each by its own."""
    return without_near_copies(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark text, not even one with a few edits."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence, slot and offset of every piece of every document left."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained classifier and edit distances; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next.

    What a stage leaves in that folder goes as soon as its rows are written. A stage that is called alone may be
    planned lazily and chained: its tables stay until the ``scratch_scope`` around the call ends.
    """
    scratch = Scratch(spark, "corpus")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs

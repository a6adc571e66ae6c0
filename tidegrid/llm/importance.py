"""Importance resampling towards a target corpus: hashed n-gram features, bit-sliced weights, Gumbel draws."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch

BUCKETS = 10_000
PIECE = 1 << 20  # bytes of a text whose words are in memory at once
SLICE = 64  # documents whose bucket counts are in memory at once
# A-Z in lower case, 0-9, a-z and all bytes of characters beyond ASCII stay; everything else parts words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def bucket_counts(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a UTF-8 text, and how many of its words and word pairs fall into each bucket."""
    flat, at, n, last = text.translate(_WORD), 0, 0, None
    counts = np.zeros(buckets, np.int64)
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)  # pieces end between words
        end = len(flat) if end < 0 else end
        words = flat[at:end].split()
        ones = [crc32(w) for w in words]
        # the checksum of a pair goes on from that of its first word
        heads, tails = (ones[:-1], words[1:]) if last is None else ([last, *ones[:-1]], words)
        pairs = [crc32(b" " + w, c) for w, c in zip(tails, heads, strict=True)] if words else []
        counts += np.bincount(np.array(ones + pairs, np.int64) % buckets, minlength=buckets)
        n, at, last = n + len(words), end, ones[-1] if ones else last
    return n, counts


def planes(counts: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of rows of numbers: result[k, row] holds bit k of each number of the row, 64 numbers a word."""
    rows, n = counts.shape
    out = np.zeros((bits, rows, -(-n // 64) * 8), np.uint8)
    for k in range(bits):
        out[k, :, : -(-n // 8)] = np.packbits(((counts >> k) & 1).astype(np.uint8), axis=1)
    return out.view(np.uint64)


class SlicedGains:
    """Gains per bucket as bit planes in two's complement: the last plane holds the signs and weighs -2^k."""

    def __init__(self, gains: list[int]):
        whole = np.array(gains, np.int64)
        self.bits = int(np.abs(whole).max(initial=0)).bit_length() + 1
        self.planes = planes(whole[None, :], self.bits)[:, 0]
        self.scale = [-(1 << k) if k == self.bits - 1 else 1 << k for k in range(self.bits)]

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Per row of counts the sum of count times gain, exact: AND of every pair of planes, their bits counted and shifted."""
        total = np.zeros(len(counts), np.int64)
        for j, count_plane in enumerate(planes(counts, int(counts.max(initial=0)).bit_length())):
            rows = np.flatnonzero(count_plane.any(axis=1))  # few documents have large counts
            for gain_plane, scale in zip(self.planes, self.scale, strict=True):
                total[rows] += (scale << j) * np.bitwise_count(count_plane[rows] & gain_plane).sum(axis=1, dtype=np.int64)
        return total


def feature_totals(docs: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts per bucket. Every task adds up its texts before the shuffle, which sees ``buckets`` rows of it at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (raw := text.as_py()) is not None:
                    total += bucket_counts(raw, buckets)[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(count, "bucket int, n long")
    out = [0] * buckets
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[row.bucket] = row.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares of each bucket in the target and in the corpus."""
    n, all_s, all_t = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus, target, strict=True)]


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel value made from a hash of seed and id (a NULL id counts as empty)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text).

    Features are the words and word pairs of a text, hashed into ``buckets``; the weight of a document is the mean gain of
    its features, floored, where the gain of a bucket says how much more frequent it is in ``target`` (text) than in
    ``docs``. Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn without replacement:
    those with the highest weight plus Gumbel noise, ranked 1, 2, 3... ; others have a NULL rank.

    NULL and empty texts have no features and weight 0. Equal scores go by doc_id (NULL last), then by row, so repeated
    rows get ranks of their own. An empty ``docs`` gives no rows; an empty ``target`` makes what is rare in ``docs``
    weigh more. Only doc_id and text of ``docs`` are read.

    Texts are read twice and never move. The bucket totals, ``buckets`` numbers each, pass through the driver. Ranks
    come from a range partitioning of thin rows and one number per partition, so no task sees all of them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "importance")
    sliced = SlicedGains(gains(feature_totals(docs, buckets), feature_totals(target, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), SLICE):
                batch = whole.slice(start, SLICE)
                found = [bucket_counts(x.as_py() or b"", buckets) for x in batch.column("text")]
                counts = np.stack([c for _, c in found])
                sums, n = sliced.sums(counts), counts.sum(axis=1)
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                numbers = [pa.array(x, pa.int64()) for x in ([k for k, _ in found], n, weight)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    weighed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = scratch.keep(scored, "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    draws = percent * able.count() // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "rank", scratch)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("row")


def numbered(rows: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with their place in ``order`` from 1 on. ``order`` should leave no ties.

    Rows are dealt by range and sorted, each range is counted, and a row's place is that of its range plus its own
    inside. Ranges are written first, so a lost executor doesn't deal them anew.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    dealt = scratch.keep(dealt, "dealt").withColumn("_range", F.shiftright("_place", 33))
    before, starts = 0, []
    for part, n in sorted(dealt.groupBy("_range").count().collect()):  # one row a partition
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "_range long, _before long")
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + inside + 1).drop("_range", "_place", "_before")

"""Best-fit packing of documents into training sequences, under conflicts of source and duplicate cluster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, words

SHARD = 8192  # documents that one task packs together


class Bins:
    """Open bins of one shard by residual capacity, each with a bitmap of full sources and one of duplicate clusters.

    ``levels`` is a bitmap of the residuals that have bins, so the next larger residual is one bit operation away.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.levels, self.at = 0, {}  # residual -> bins, oldest first
        self.residual: list[int] = []
        self.full: list[int] = []  # sources that have their share of the bin
        self.clusters: list[int] = []
        self.count: list[dict[int, int]] = []
        self.slots: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest bin that has room and no conflict, else of a new one.

        ``source`` and ``cluster`` are bit positions; a cluster of -1 has no other member in the shard.
        """
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        rest = self.levels >> size
        level = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            level += step
            rest >>= step
            for b in self.at[level]:
                if not self.full[b] & s and not self.clusters[b] & c:
                    return b, self._add(b, size, source, c)
            rest >>= 1
            level += 1
        b = len(self.residual)
        self.residual.append(self.capacity)
        self.full.append(0)
        self.clusters.append(0)
        self.count.append({})
        self.slots.append(0)
        self._link(b)
        return b, self._add(b, size, source, c)

    def _link(self, b: int) -> None:
        self.at.setdefault(self.residual[b], []).append(b)
        self.levels |= 1 << self.residual[b]

    def _add(self, b: int, size: int, source: int, cluster_bit: int) -> int:
        offset = self.capacity - self.residual[b]
        same = self.at[self.residual[b]]
        same.remove(b)
        if not same:
            self.levels &= ~(1 << self.residual[b])
        self.residual[b] -= size
        self.clusters[b] |= cluster_bit
        n = self.count[b][source] = self.count[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full[b] |= 1 << source
        self.slots[b] += 1
        if self.residual[b]:
            self._link(b)
        return offset


def _pack(capacity: int, per_source: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(rest=shard["n"] % capacity).sort_values(["rest", "row"], ascending=[False, True], kind="stable")
        sources = {s: i for i, s in enumerate(sorted(shard["source"].unique()))}
        counts = shard["cluster"].value_counts()
        clusters = {c: i for i, c in enumerate(sorted(counts.index[counts > 1]))}
        bins, out = Bins(capacity, per_source), []
        for row, n, rest, source, cluster in shard[["row", "n", "rest", "source", "cluster"]].itertuples(index=False):
            if rest:
                b, offset = bins.place(rest, sources[source], clusters.get(cluster, -1))
                out.append((row, n // capacity, n - rest, rest, b, bins.slots[b] - 1, offset))
        more = len(bins.residual)
        for row, n in shard.loc[shard["n"] >= capacity, ["row", "n"]].itertuples(index=False):
            for k in range(n // capacity):  # pieces that fill a bin of their own
                out.append((row, k, k * capacity, capacity, more, 0, 0))
                more += 1
        out = pd.DataFrame(out, columns=["row", "piece", "word_start", "n_words", "bin", "slot", "bin_offset"])
        named = shard[["row", "doc_id", "source", "cluster", "shard"]]
        return out.merge(named, on="row")[["doc_id", "source", "cluster", "piece", "word_start", "n_words", "shard", "bin", "slot", "bin_offset"]]

    return run


def pack_documents(docs: DataFrame, capacity: int = 4096, per_source: int = 4, shard: int = SHARD, scratch: Scratch | None = None) -> DataFrame:
    """Where every piece of every document (doc_id, text, source; optionally cluster) goes.

    Returns doc_id, source, cluster, piece, word_start, n_words, bin_id, slot, bin_offset: words word_start ..
    word_start + n_words of the document are at bin_offset of sequence bin_id. A text is a list of words here; one longer
    than ``capacity`` is cut into full pieces, each a sequence of its own, and a rest. Rests are packed largest first
    into the tightest sequence with room that has no text of the same duplicate cluster and fewer than ``per_source``
    of the same source. Without a ``cluster`` column, texts with the same words are a cluster; NULL clusters conflict
    with nothing and NULL sources are the source ''. Texts without words come back with bin_id NULL.

    Only (id, size, source, cluster) rows are shuffled. A task packs one shard of about ``shard`` documents drawn by
    hash, whatever their source or cluster, so a hot source or a large cluster is spread over all shards.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    w = words(F.col("text"))
    own = F.when(F.size(w) > 0, F.xxhash64(w)) if "cluster" not in docs.columns else F.xxhash64("cluster")
    if "cluster" in docs.columns:
        own = F.when(F.col("cluster").isNotNull(), own)
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    sizes = docs.select("doc_id", source.alias("source"), own.alias("cluster"), F.size(w).cast("long").alias("n"))
    sizes = scratch.keep(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    shards = max(1, -(-sizes.filter("n > 0").count() // shard))
    spread = sizes.filter("n > 0").withColumn("cluster", F.coalesce("cluster", F.xxhash64("row"))).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, cluster long, piece long, word_start long, n_words long, shard long, bin long, slot long, bin_offset long"
    packed = spread.groupBy("shard").applyInPandas(_pack(capacity, per_source), schema)
    bin_id = F.shiftleft("shard", 32) + F.col("bin")
    rows = packed.select("doc_id", "source", "cluster", "piece", "word_start", "n_words", bin_id.alias("bin_id"), "slot", "bin_offset")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    empty = sizes.filter("n = 0").select("doc_id", "source", "cluster", zero.alias("piece"), zero.alias("word_start"), zero.alias("n_words"), none.alias("bin_id"), none.alias("slot"), none.alias("bin_offset"))
    return rows.unionByName(empty)

"""Lempel-Ziv phrase fingerprints: parse into dictionary phrases, hash the phrase set, keep minimum hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 128
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class Parser:
    """Dictionary parse of a text that can be continued: each phrase is a known phrase and one more character."""

    def __init__(self) -> None:
        self.known: dict[str, None] = {}  # the phrases in the order of the text
        self.open, self.at = "", 0  # what has been read of an unfinished phrase, and the position

    def feed(self, text: str) -> Parser:
        known, cur = self.known, self.open
        for ch in text:
            cur += ch
            if cur not in known:
                known[cur] = None
                cur = ""
        self.open, self.at = cur, self.at + len(text)
        return self

    def fork(self) -> Parser:
        out = Parser()
        out.known, out.open, out.at = self.known.copy(), self.open, self.at
        return out

    def branch(self, text: str) -> np.ndarray:
        """Ends of the phrases that ``text`` would add, an unfinished one at its end included. The parser stays as it is."""
        known, cur = self.known, self.open
        added: dict[str, None] = {}
        for ch in text:
            cur += ch
            if cur not in known and cur not in added:
                added[cur] = None
                cur = ""
        return self.at - len(self.open) + _ends(added, cur)

    @property
    def ends(self) -> np.ndarray:
        """Ends of the finished phrases."""
        return _ends(self.known, "")

    def phrases(self) -> np.ndarray:
        """Ends of all phrases; an unfinished one at the end of the text counts."""
        return _ends(self.known, self.open)


def _ends(phrases: dict[str, None], unfinished: str) -> np.ndarray:
    lengths = [*map(len, phrases)]
    if unfinished:
        lengths.append(len(unfinished))
    return np.cumsum(np.array(lengths, np.int64))


def fingerprint(text: str, ends: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the text's phrases, 16 bits each; all zero for an empty text."""
    return _folded(_minima(text, ends)) if len(ends) else np.zeros(HASHES, np.uint16)


PART = 256  # phrases whose hashes are held at a time: they stay in the processor's cache
_products = np.empty((PART, HASHES), np.uint64)


def _minima(text: str, ends: np.ndarray, start: int = 0) -> np.ndarray:
    """Minimum of each hash function over the phrases with these ends, the first of which begins at ``start``."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    if not len(ends):
        return low
    codes = np.frombuffer(text[start : ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = ends - start
    powers, back = _powers(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    starts = np.concatenate([[0], ends[:-1]])
    h = (sums[ends] - sums[starts]) * back[starts]  # the polynomial of the phrase, wherever it stands
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    for i in range(0, len(h), PART):
        some = h[i : i + PART, None]
        part = _products[: len(some)]
        np.multiply(some, FACTORS, out=part)
        part += SHIFTS
        np.minimum(low, part.min(0), out=low)
    return low


def _folded(low: np.ndarray) -> np.ndarray:
    return ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)


_cache: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache[0]) < n + 1:
        size = max(n + 1, 2 * len(_cache[0]))
        for i, base in enumerate((BASE, INVERSE)):
            _cache[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
    return _cache[0][:n], _cache[1][: n + 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima, less what 16 bits agree on by chance; 1 for equal texts."""
    share = float((a == b).mean())
    return max(0.0, (share - 1 / 65536) / (1 - 1 / 65536))


def text_fingerprint(text: str) -> np.ndarray:
    return fingerprint(text, Parser().feed(text).phrases())


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``other``, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds ``fingerprint``, the hex digits of the signature, to ``docs``; NULL texts count as empty."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t).astype(">u2").tobytes().hex() for t in texts.fillna("")])

    return docs.drop("fingerprint").withColumn("fingerprint", made(F.col("text")))


def _range_of(cuts: list, doc_id: Column) -> Column:
    """Position of ``doc_id`` among the cuts, in descending order: 0 for the largest ids; NULL ids come last."""
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > doc_id)) if cuts else F.lit(0)
    return F.when(doc_id.isNull(), len(cuts) + 1).otherwise(above)


def neighbour_likeness(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edited form, and how like it is to that and to the next document.

    The next document is the one with the next smaller doc_id; after the last comes the first. Rows with equal ids are
    in the order of their texts, rows without an id come last, NULL texts are empty, and a table of one row is its own
    neighbour. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, into ranges of ids, and each range is read in order by one task. The first row of a range
    is also sent to the range before it, to follow its last row. Cuts between ranges come from an approximate quantile;
    they only decide how even the tasks are, not which rows are neighbours.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, ranges or 4 * tasks)  # a few ranges a task, as they are dealt by hash
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quantiles = F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)
    cuts = sorted(set(rows.agg(quantiles).first()[0] or []))
    rows = rows.withColumn("range", _range_of(cuts, F.col("doc_id")).cast("int"))
    tops = [(r.range, r.top) for r in rows.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()]  # one per range
    if not tops:
        return rows.mapInPandas(_chain, SCHEMA % dict(docs.dtypes)["doc_id"])
    before = dict(zip([r for r, _ in tops], [tops[-1][0], *(r for r, _ in tops[:-1])], strict=True))
    ids = [F.lit(t) for _, t in tops if t is not None]
    is_top = (F.col("doc_id").isin(*ids) if ids else F.lit(False)) | F.col("doc_id").isNull()
    heads = rows.filter(is_top).groupBy("range", "doc_id").agg(F.min("text").alias("text"))  # one row per range
    place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    heads = heads.select("doc_id", "text", F.element_at(place, F.col("range")).alias("range"), F.lit(True).alias("border"))
    spread = rows.withColumn("border", F.lit(False)).unionByName(heads).withColumn("key", F.col("range"))
    parts = spread.repartition(tasks, "range").sortWithinPartitions("range", "border", F.desc_nulls_last("doc_id"), "text")
    return parts.mapInPandas(_chain, SCHEMA % dict(docs.dtypes)["doc_id"])


SCHEMA = "doc_id %s, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Stem:
    """What an edit leaves of a text, parsed and hashed once for both: only what follows is parsed for each."""

    def __init__(self, text: str) -> None:
        self.parser = Parser().feed(text[: len(text) - len(text) // 3])
        ends = self.parser.ends
        self.start = int(ends[-1]) if len(ends) else 0  # of the phrase that is open
        self.low = _minima(text, ends)

    def fingerprint(self, text: str) -> np.ndarray:
        """That of a whole text which begins with the stem."""
        ends = self.parser.branch(text[self.parser.at :])
        if not text:
            return np.zeros(HASHES, np.uint16)
        return _folded(np.minimum(self.low, _minima(text, ends, self.start)))


def _chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order within each range, its border row last: each is compared with the row after it."""
    last = None  # (doc_id, text, what an edit leaves, fingerprint)
    for frame in frames:
        out = []
        for doc_id, text, border in zip(frame["doc_id"], frame["text"], frame["border"], strict=True):
            stem = Stem(text)
            own = stem.fingerprint(text)
            if last is not None:
                out.append(_compared(last, text, own))
            last = None if border else (doc_id, text, stem, own)
        yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _compared(row: tuple, other: str, next_print: np.ndarray) -> tuple:
    doc_id, text, stem, own = row
    changed = edited(text, other)
    new = stem.fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own.astype(">u2").tobytes().hex(), new.astype(">u2").tobytes().hex(), likeness(own, new), likeness(own, next_print)

"""Benchmark decontamination: exact pieces find candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import BLANK, Scratch

BLANKS = re.compile(BLANK + "+")
LONGER = "\u0130"  # capital I with a dot
SHARD_CHARS = 4_000_000  # benchmark text that one automaton holds; larger benchmarks take several passes

PLACE = ("item_id", "start", "end", "distance")


def lower(text: str) -> str:
    """Lower case, character by character: the one capital whose small form is two characters stays as it is."""
    return LONGER.join(part.lower() for part in text.split(LONGER))


def normalise(text: str) -> str:
    """Lower case, runs of blanks as one space, trimmed."""
    return BLANKS.sub(" ", lower(text)).strip(" ")


def _offsets(text: str) -> list[int]:
    """Position in ``text`` of each character of its normalised form, and of the end."""
    at: list[int] = []
    i = 0
    for m in BLANKS.finditer(text):
        at += range(i, m.start())
        if m.start() and m.end() < len(text):
            at.append(m.start())
        i = m.end()
    at += range(i, len(text))
    return [*at, at[-1] + 1 if at else 0]


def myers(pattern: str, text: str) -> list[int]:
    """Least edit distance between ``pattern`` and any part of ``text`` that ends at each of its characters."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(xh | up)), up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(xv | plus)) & full
        down = plus & xv & full
        out.append(score)
    return out


class Matcher:
    """All approximate occurrences of a list of (item_id, text) in a text, with at most ``rate`` edits per character.

    Items below ``min_chars`` characters have no edits and have to begin and end where words do.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int, min_piece: int = 8):
        self.items: list[tuple[int, str, int, bool]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            short = len(text) < min_chars
            budget = 0 if short else max(0, min(int(len(text) * rate), len(text) // min_piece - 1))
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(text[a:b], []).append((len(self.items), b))
            self.items.append((item_id, text, budget, short))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def hits(self, raw: str) -> list[dict]:
        if not self.items or not raw:
            return []
        text = normalise(raw)
        starts: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for item, to in places:
                starts.setdefault(item, set()).add(end + 1 - to)
        found = []
        for item, at in starts.items():
            item_id, pattern, budget, short = self.items[item]
            if short:
                found += [(item_id, a, a + len(pattern), 0) for a in at if _whole_words(text, a, a + len(pattern))]
                continue
            for a, b in _windows(sorted(at), len(pattern), budget, len(text)):
                found += [(item_id, *x) for x in self._verify(pattern, budget, text, a, b)]
        if not found:
            return []
        back = _offsets(raw)
        return [{"item_id": i, "start": back[a], "end": back[b - 1] + 1, "distance": d} for i, a, b, d in sorted(set(found))]

    @staticmethod
    def _verify(pattern: str, budget: int, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, end, distance) of the best place of every run of ends within the budget."""
        if text.startswith(pattern, a + budget) and b - a <= len(pattern) + 2 * budget:
            return [(a + budget, a + budget + len(pattern), 0)]
        out, best = [], None
        for i, d in enumerate([*myers(pattern, text[a:b]), budget + 1]):
            if d <= budget and (best is None or d < best[1]):
                best = (a + i + 1, d)
            elif d > budget and best is not None:
                end, d = best
                low = max(a, end - len(pattern) - budget)
                back = myers(pattern[::-1], text[low:end][::-1])
                out.append((end - 1 - back.index(min(back)), end, d))
                best = None
        return out


def _whole_words(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] doesn't begin or end inside a word."""
    inside = a > 0 and text[a - 1].isalnum() and text[a].isalnum()
    return not inside and not (b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


def _windows(starts: list[int], size: int, budget: int, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold the pattern if it begins near one of ``starts``."""
    a = b = None
    for s in starts:
        if a is not None and s <= b + budget:
            b = s
            continue
        if a is not None:
            yield max(0, a - budget), min(limit, b + size + budget)
        a = b = s
    if a is not None:
        yield max(0, a - budget), min(limit, b + size + budget)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_chars: int = 24, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, distance): each place of a ``text`` of ``docs`` that holds a text of ``benchmark`` (item_id, text).

    Both sides are compared in lower case with runs of blanks as one space. An item of m characters is found with up to
    ``k = rate * m`` edits: it is cut into k + 1 pieces, of which one must occur unchanged (pigeonhole), an automaton
    finds all pieces in one walk of the text, and Myers' algorithm measures the text around each piece. Items shorter
    than ``min_chars`` are found unchanged, between word borders. Spans are code points of the text as written. NULL and
    blank items or texts match nothing; repeated items and rows each report. Other columns of ``docs`` are not read.

    Documents don't move. The benchmark is cut into shards of about ``shard_chars`` characters. A shard is a pass over the
    texts by tasks of its own, so no task holds more than one, and the driver hands them on one by one.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, min_chars)
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column("text")):
                    hits = matcher.hits(text.as_py() or "")
                    at += [i] * len(hits)
                    found += hits
                places = [pa.array([h[c] for h in found], pa.int64()) for c in PLACE]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), *places], ["doc_id", *PLACE])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in PLACE))

    return reduce(DataFrame.unionByName, map(scan, _shards(docs.sparkSession, benchmark, shard_chars)))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_chars: int = 24, shard_chars: int = SHARD_CHARS, scratch: Scratch | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which ``find_leaks`` finds nothing.

    Only the texts go through Python. Where the benchmark has several shards, what a shard leaves is written before the
    next one looks at it, so that no task holds two.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontamination")
    shards = _shards(spark, benchmark, shard_chars)
    now = next(shards)
    while now is not None:
        later = next(shards, None)
        left = docs.filter(~_holds(now, rate, min_chars)(F.col("text")))
        docs = left if later is None else scratch.keep(left, "left")
        if later is not None:
            now.unpersist()
        now = later
    return docs


def _holds(shared, rate: float, min_chars: int):
    """Whether a text holds any item of the shard."""

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, rate, min_chars)
        for texts in batches:
            yield pa.array([bool(matcher.hits(t.as_py() or "")) for t in texts], pa.bool_())

    return holds


def _shards(spark: SparkSession, benchmark: DataFrame, shard_chars: int) -> Iterator:
    """The items in broadcasts of about ``shard_chars`` characters each; one at least."""
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    for k in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        yield spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])  # of shard_chars on average

"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch

# General English insults that vote without any labelled row.
SEEDS = (
    "bastard", "clown", "coward", "creep", "cretin", "degenerate", "despicable", "disgusting", "dumb", "dumbass", "filth",
    "freak", "garbage", "idiot", "imbecile", "jerk", "loser", "maggot", "moron", "parasite", "pathetic", "retard", "scum",
    "stupid", "subhuman", "trash", "vermin", "worthless",
)
# The pattern voters, as (name, expression on the text as written).
PATTERNS = (
    ("shouting", r"(?:\b[A-ZÀ-Þ]{3,}\b\W+){4}"),
    ("exclamations", r"!{2,}"),
    ("second_person", r"(?i)\byou(?:'re| are| were)? (?:a |an |such |so |all )"),
    ("starred", r"\b\w[*#@$]{2,}\w*\b"),
)
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8, 9)
LEVELS = (1, 2, 3, 5)  # voters on the number of lexicon hits
DENSITIES = (0.2, 0.5, 1.0)  # voters on two or more hits and so many per 1,000 characters


@dataclass
class ToxicityModel:
    """Lexicon events and the weights of the linear classifier.

    An event is (least count, term); a term is a word prefix or, with a leading ``=``, a whole word.
    """

    events: list[tuple[int, str]]
    weights: np.ndarray  # events, patterns, hit levels, densities, log of hits, bias
    voters: dict[str, tuple[float, float]] = field(default_factory=dict)  # P(fires | toxic), P(fires | clean)

    def score(self, texts: list[str]) -> np.ndarray:
        return np.array([self.score_text(t) for t in texts], float)

    def score_text(self, text: str) -> float:
        """A sum over the few voters that fire; no row of all votes is made."""
        fired, hits = self.fired(text)
        return float(_sigmoid(self.weights[fired].sum() + self.weights[-2] * hits + self.weights[-1]))

    def fired(self, text: str) -> tuple[list[int], float]:
        """The voters (events, patterns, hit levels, densities) that fire, by number, and the log of the lexicon hits."""
        counts, total = self._hits(text)
        if self.__dict__.get("_places") is None:
            self._places: dict[str, list[tuple[int, int]]] = {}
            for i, (least, term) in enumerate(self.events):
                self._places.setdefault(term, []).append((least, i))
        out, at = [i for term, n in counts.items() for least, i in self._places[term] if n >= least], len(self.events)
        out += [i for i, (_, p) in enumerate(_PATTERNS, at) if p.search(text) is not None]
        at += len(_PATTERNS)
        out += [i for i, level in enumerate(LEVELS, at) if total >= level]
        out += [i for i, d in enumerate(DENSITIES, at + len(LEVELS)) if total >= 2 and 1000 * total >= d * len(text)]
        return out, float(np.log1p(total))

    def _hits(self, text: str) -> tuple[Counter, int]:
        """Occurrences of each term, and the number of words that any term matches."""
        found: Counter = Counter()
        if not self.events:
            return found, 0
        if self.__dict__.get("_automaton") is None:
            self._automaton = ahocorasick.Automaton()
            forms: dict[str, list[str]] = {}
            for term in {t for _, t in self.events}:
                forms.setdefault(term.lstrip("="), []).append(term)
            for form, terms in forms.items():
                self._automaton.add_word(form, (len(form), terms))
            self._automaton.make_automaton()
        text, starts = text.lower(), set()
        for end, (size, terms) in self._automaton.iter(text):
            a, b = end - size, end + 1
            if a >= 0 and text[a].isalpha():
                continue
            for term in terms:
                if term[0] != "=" or b == len(text) or not text[b].isalpha():
                    found[term] += 1
                    starts.add(a)
        return found, len(starts)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_automaton", "_places")}


_PATTERNS = [(name, re.compile(p)) for name, p in PATTERNS]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def events_of(text: str) -> set[tuple[int, str]]:
    """The word prefixes and whole words of a text in lower case, each as seen once and, where so, as seen twice."""
    prefixes: Counter = Counter()
    for w, n in Counter(LETTERS.findall(text.lower())).items():
        prefixes["=" + w] += n
        for k in PREFIXES:
            if len(w) < k:
                break
            prefixes[w[:k]] += n
    return {(1, t) for t in prefixes} | {(2, t) for t, n in prefixes.items() if n > 1}


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column | None = None, toxic: int = 4000, clean: int = 8000) -> ToxicityModel:
    """Learn from ``labels`` (doc_id, toxic) of the rows where ``use`` (on doc_id) holds, and the texts of ``docs``.

    At most about ``toxic`` and ``clean`` labelled rows are looked at (drawn by a hash of the id, equal texts once). All
    events of their texts are counted (a word or word prefix, seen once or twice); those in five toxic texts or more that are
    significantly more frequent there than in clean texts (three times, log-likelihood ratio over 30) become lexicon
    voters as long as each covers three toxic texts, less two for each clean one, that the voters before it don't. Labels
    that are NULL, ids that are NULL and texts that are NULL are not learned from. Without labelled rows the seed words
    vote with default accuracies.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = (known if use is None else known.filter(use)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {1: min(1.0, toxic / max(counts.get(1, 0), 1)), 0: min(1.0, clean / max(counts.get(0, 0), 1))}
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    drawn = known.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")  # bounded by toxic + clean
    sample = scratch.keep(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    strong = _strong_events(sample)
    where = {e: i for i, e in enumerate(strong)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(where[e] for e in events_of(text.as_py()) if e in where) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    rows = sample.select("text", "toxic").mapInArrow(present, "toxic int, found array<int>").collect()  # bounded by toxic + clean
    has = np.zeros((len(rows), len(strong)), bool)
    for i, r in enumerate(rows):
        has[i, r.found] = True
    model = ToxicityModel([strong[i] for i in _lexicon(has, np.array([r.toxic for r in rows]), strong)], np.zeros(0))
    shared = spark.sparkContext.broadcast(model)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [shared.value.fired(text.as_py()) for text in batch.column("text")]
            arrays = [batch.column("toxic"), pa.array([v for v, _ in votes], pa.list_(pa.int32())), pa.array([h for _, h in votes], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "fired", "hits"])

    rows = sample.select("text", "toxic").mapInArrow(voted, "toxic int, fired array<int>, hits double").collect()
    votes = np.zeros((len(rows), len(model.events) + len(PATTERNS) + len(LEVELS) + len(DENSITIES)))
    for i, r in enumerate(rows):
        votes[i, r.fired] = 1
    posterior, voters = label_model(votes, np.array([r.toxic for r in rows], float))
    hits = np.array([r.hits for r in rows]).reshape(len(rows), 1)
    model.weights = _logistic(np.hstack([votes, hits, np.ones((len(rows), 1))]), posterior, len(model.events))
    names = [*(f"{t} x{k}" for k, t in model.events), *(n for n, _ in PATTERNS), *(f"hits {k}" for k in LEVELS), *(f"density {d}" for d in DENSITIES)]
    model.voters = dict(zip(names, voters, strict=True))
    scratch.drop(sample)
    return model


def _strong_events(sample: DataFrame, flush: int = 50_000) -> list[tuple[int, str]]:
    """The events of ``sample`` (text, toxic) that tell toxic from clean texts, and the seed words. Counted in one pass; a
    task hands on what it has counted whenever that is ``flush`` events."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [[k for k, _ in seen], [t for _, t in seen], [n[1] for n in seen.values()], [n[0] for n in seen.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["least", "term", "pos", "neg"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                for event in events_of(text.as_py()):
                    seen.setdefault(event, [0, 0])[int(toxic == 1)] += 1
                if len(seen) >= flush:
                    yield out()
                    seen = {}
        yield out()

    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = float(size.get(1, 0)), float(sum(n for t, n in size.items() if t != 1))
    seeds = {(1, "=" + w) for w in SEEDS}
    if not n1 or not n0:
        return sorted(seeds)
    counted = sample.select("text", "toxic").mapInArrow(count, "least int, term string, pos long, neg long")
    counted = counted.groupBy("least", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 5")
    p = (F.col("pos") + F.col("neg")) / (n1 + n0)

    def side(k: Column, n: float) -> Column:
        return sum(F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0) for x, e in ((k, p * n), (n - k, (1 - p) * n)))

    ratio = 2 * (side(F.col("pos"), n1) + side(F.col("neg"), n0))  # log-likelihood ratio against one share for both
    found = counted.filter((F.col("pos") / n1 > 3 * F.col("neg") / n0) & (ratio > 30)).select("least", "term").collect()
    return sorted({(r.least, r.term) for r in found} | seeds)


def _lexicon(has: np.ndarray, gold: np.ndarray, events: list[tuple[int, str]]) -> list[int]:
    """Events in order of the toxic texts that only they cover so far, less two for each clean text; then the seeds."""
    left, clean, out = gold == 1, gold == 0, []
    cost = 2.0 * has[clean].sum(0)
    while True:
        gain = has[left].sum(0) - cost
        gain[out] = -np.inf
        best = max(range(len(events)), key=lambda i: (gain[i], -len(events[i][1]), events[i]))
        if gain[best] < 3:
            break
        out.append(best)
        left &= ~has[:, best]
    known = tuple(events[i][1] for i in out)
    return out + [i for i, (_, t) in enumerate(events) if t[1:] in SEEDS and t[0] == "=" and not t[1:].startswith(known) and t not in known]


def label_model(votes: np.ndarray, gold: np.ndarray | None = None, rounds: int = 10, anchor: float = 20.0) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Posterior of each row's label, and (P(fires | toxic), P(fires | clean)) of each voter.

    A two-class mixture of Bernoulli voters fitted by expectation-maximisation. ``gold`` labels start it and stay as
    ``anchor`` pseudo-rows; without them a voter starts at (0.3, 0.01). Voters that still fire together among the rows
    of the toxic class share their weight: each is divided by one plus the sum of its correlations above 0.2.
    """
    n, v = votes.shape
    hit, miss, rate = np.full(v, 0.3), np.full(v, 0.01), 0.1
    if gold is not None and n and 0 < gold.sum() < n:
        hit = (votes[gold == 1].sum(0) + 0.5) / (gold.sum() + 1)
        miss = (votes[gold == 0].sum(0) + 0.5) / ((1 - gold).sum() + 1)
        rate = gold.mean()
    hit0, miss0, q = hit, miss, np.full(n, rate)

    def posterior(share: np.ndarray) -> np.ndarray:
        on, off = np.log(hit / miss), np.log((1 - hit) / (1 - miss))
        return _sigmoid(np.log(rate / (1 - rate)) + votes @ (on * share) + (1 - votes) @ (off * share))

    for _ in range(rounds if n else 0):
        q = posterior(np.ones(v))
        hit = np.clip((q @ votes + anchor * hit0) / (q.sum() + anchor), 1e-4, 1 - 1e-4)
        miss = np.clip(((1 - q) @ votes + anchor * miss0) / ((1 - q).sum() + anchor), 1e-5, 1 - 1e-4)
        rate = float(np.clip(q.mean(), 1e-3, 0.9))
    apart = (votes - hit) * np.sqrt(q)[:, None]
    cov = apart.T @ apart / max(q.sum(), 1)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    return posterior(1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))), list(zip(hit.tolist(), miss.tolist(), strict=True))


def _logistic(x: np.ndarray, target: np.ndarray, terms: int, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression on soft targets by Newton steps; the bias is not penalised."""
    if not len(x):
        out = np.zeros(x.shape[1])
        out[:terms], out[-1] = 3.0, -2.0  # no row to learn from: one seed word is enough
        return out
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - target) + ridge * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_of(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """The score (0 to 1) of each whole text; NULL counts as empty. Texts are read one by one."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score_text(t.as_py() or "") for t in texts], pa.float64())

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text, in place of columns of these names."""
    out = docs.drop("score", "predicted").withColumn("score", toxicity_of(docs.sparkSession, model, F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below 0.5."""
    return docs.filter(toxicity_of(docs.sparkSession, model, F.col("text")) < 0.5)

"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDECIDED = "und"
ORDERS = (1, 2, 3)  # characters of an n-gram


def ngram_features(text: str, size: int) -> np.ndarray | None:
    """Hashed character n-gram shares of a whole text, each order on its own scale; None if it has no letter.

    Case is folded and every run of characters that are no letters is one space, so n-grams know word ends.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds], bool)[at] if len(kinds) else np.zeros(0, bool)
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays as the space after a word
    codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint64)
    out = np.zeros(size, np.float32)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS and len(h):
            mixed = h ^ (h >> np.uint64(29))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            counts = np.bincount((mixed >> np.uint64(33)).astype(np.int64) % size, minlength=size)
            out += np.sqrt(counts / len(h)).astype(np.float32)
    return out


def codewords(classes: int, bits: int) -> np.ndarray:
    """One row of +1 / -1 per class, chosen one after the other for the largest least distance to those before.

    Candidates come from a fixed generator. For few classes all distinct two-way splits come before any repetition (the
    exhaustive code); repeated splits get classifiers of their own, see ``feature_shares``.
    """
    if classes <= 1:
        return np.ones((classes, bits), np.int8)
    if 2 ** (classes - 1) - 1 <= bits:
        splits = [[1, *((1 if s >> i & 1 else -1) for i in range(classes - 1))] for s in range(2 ** (classes - 1) - 1)]
        return np.array([splits[i % len(splits)] for i in range(bits)], np.int8).T
    rng = np.random.default_rng(7)
    out = [np.ones(bits, np.int8)]
    while len(out) < classes:
        tries = rng.integers(0, 2, (512, bits)).astype(np.int8) * 2 - 1
        apart = np.min([(tries != w).sum(1) for w in out], axis=0)
        out.append(tries[int(apart.argmax())])
    return np.array(out)


def feature_shares(code: np.ndarray, features: int) -> np.ndarray:
    """(features + 1, bits): the features each bit may use, and the bias. Bits that ask the same question (equal columns,
    or opposite ones) share the features out among them, so that their classifiers err for different reasons."""
    groups: dict[bytes, list[int]] = {}
    for j, column in enumerate(code.T):
        groups.setdefault((column * column[0]).tobytes() if len(column) else b"", []).append(j)
    out = np.ones((features + 1, code.shape[1]), np.float32)
    for same in groups.values():
        for k, j in enumerate(same):
            out[:features, j] = np.arange(features) % len(same) == k
    return out


@dataclass
class LanguageModel:
    """``weights`` (features + 1, bits) of the bit classifiers and ``trust`` (bits) in each of them."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    margin: float

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """(lang_pred, score, ambiguous) of each text: loss-weighted decoding to the nearest codeword."""
        size, out = len(self.weights) - 1, []
        for text in texts:
            x = ngram_features(text, size) if text else None
            if x is None or not self.languages:
                out.append((UNDECIDED, 0.0, True))
                continue
            out.append(self.decode(x @ self.weights[:-1] + self.weights[-1]))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    def decode(self, bits: np.ndarray) -> tuple[str, float, bool]:
        """The language whose codeword has the least loss, each bit weighted by its trust."""
        loss = (self.trust * np.logaddexp(0, -self.code * bits)).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(loss.argmin())
        second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), bool(p[best] - second < self.margin)


def fit_language_model(
    docs: DataFrame, use: Column | None = None, rows: int = 4000, per_language: int = 1500, features: int = 2048, bits: int = 15, margin: float = 0.2
) -> LanguageModel:
    """Learn from ``text`` and non-NULL ``lang`` of the rows of ``docs`` where ``use`` holds.

    A sample of about ``rows`` rows, at most about ``per_language`` of a language, is drawn by a hash of id and text;
    rare languages are taken whole. Features are made on the executors from whole texts. Each bit of the code is a ridge
    logistic classifier; a bit is trusted by its accuracy on the fifth of the sample it isn't first fitted on. Without
    rows to learn from, every text is ``und``.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    known = (known if use is None else known.filter(use)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # as many as there are languages
    names = sorted(counts)
    each = min(per_language, max(1, rows // max(len(names), 1)))
    draw = F.pmod("h", F.lit(1_000_000)) / 1_000_000
    share = F.lit(1.0)
    for name in names:
        share = F.when(F.col("lang") == name, min(1.0, each / counts[name])).otherwise(share)

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(lang, h, ngram_features(text, features)) for lang, h, text in zip(frame["lang"], frame["h"], frame["text"], strict=True)]
            made = [(lang, h, x.astype(np.float32).tobytes()) for lang, h, x in made if x is not None]
            yield pd.DataFrame(made, columns=["lang", "h", "x"])

    sample = known.filter(draw < share).mapInPandas(featured, "lang string, h long, x binary").toPandas().sort_values(["h", "lang"])
    if sample.empty:
        return LanguageModel([], np.ones((0, bits)), np.zeros((features + 1, bits)), np.ones(bits), margin)
    x = np.hstack([np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), features), np.ones((len(sample), 1), np.float32)])
    names = sorted(set(sample["lang"]))
    y = np.searchsorted(names, sample["lang"])
    code = codewords(len(names), bits)
    target = (code[y] + 1) / 2
    held = np.arange(len(y)) % 5 == 4
    use = feature_shares(code, features)
    trial = _fit_bits(x[~held], target[~held], use)
    right = ((x[held] @ trial > 0) == (target[held] > 0.5)).mean(0) if held.any() else np.ones(bits)
    trust = np.clip(2 * right - 1, 0.05, None)
    return LanguageModel(names, code, _fit_bits(x, target, use), trust / trust.mean(), margin)


def _fit_bits(x: np.ndarray, target: np.ndarray, use: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """All bit classifiers at once, on the features each may use, by accelerated gradient steps on the logistic loss."""
    w = look = np.zeros((x.shape[1], target.shape[1]), np.float32)
    step = 4.0 / max(float((x**2).sum(1).max()), 1e-6)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        new = look - step * (use * (x.T @ (p - target).astype(np.float32)) / max(len(x), 1) + penalty * look)
        look = new + t / (t + 3) * (new - w)
        w = new
    return w


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous of each whole text.

    NULL texts and texts without a letter are ``und`` with score 0 and ambiguous.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict([t if isinstance(t, str) else None for t in texts])

    rows = docs.drop("lang_pred", "score", "ambiguous").withColumn("_found", predict(F.col("text")))
    return rows.select(*[c for c in rows.columns if c != "_found"], "_found.*")

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from tests.llm.helpers import ASCII, prose
from tidegrid.llm import importance
from tidegrid.llm.importance import SlicedGains, bucket_counts, importance_resample, numbered
from tidegrid.llm.common import Scratch
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, percent=25, least=20, seed=7):
    def features(text):
        w = WORD.findall((text or "").translate(ASCII))
        return len(w), Counter(crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    docs = [(i, *features(t)) for i, t in rows]
    corpus, goal = sum((c for _, _, c in docs), Counter()), sum((features(t)[1] for t in target), Counter())
    size, want = sum(corpus.values()), sum(goal.values())
    out = []
    for i, n, c in docs:
        f = sum(c.values())
        total = sum(k * math.floor(1000 * math.log((goal[b] + 1) * (size + 10000) / ((corpus[b] + 1) * (want + 10000)))) for b, k in c.items())
        weight = total // f if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, f, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return out


def shown(rows):
    return sorted((str(tuple(r)) for r in rows))


def test_importance_against_brute_force(spark):
    rng = random.Random(5)
    target = [prose(rng, 60) for _ in range(5)] + [None, "", "Ünïcode wörds 12 ÀB-cd"]
    rows = [(i, " ".join([prose(rng, rng.choice([0, 1, 19, 20, 21, 90])), target[i % 5][: rng.randint(0, 200)]])) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " .,- "), (303, "one"), (304, "the " * 5000), (305, prose(rng, 30000)), (None, rows[0][1]), (7, "another text of this id " * 6)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, rank string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resample(docs, goal).collect()
    assert shown(got) == shown(brute(rows, target))
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(r.n_words >= 20 for r in got) * 25 // 100 + 1))
    assert shown(importance_resample(docs, goal, 100, 1, 11).collect()) == shown(brute(rows, target, 100, 1, 11))


def test_importance_repeated_rows_and_empty_tables(spark):
    text = "word " * 30
    docs = spark.createDataFrame([(1, text)] * 8, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    got = importance_resample(docs, none).collect()
    assert len(got) == 8 and sorted(r.rank for r in got if r.rank) == [1, 2] and len({r.score for r in got}) == 1
    assert importance_resample(none, docs).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = prose(random.Random(1), 400) + " Ähre " * 3
    whole = bucket_counts(text.encode())
    for size in (1, 7, 64):
        monkeypatch.setattr(importance, "PIECE", size)
        n, counts = bucket_counts(text.encode())
        assert n == whole[0] and (counts == whole[1]).all()


def test_sliced_sums_are_exact():
    rng = np.random.default_rng(0)
    for width, low, high in ((10000, -9000, 9000), (65, -1, 1), (64, 0, 1), (3, -8, 8), (1, 0, 1)):
        gains = rng.integers(low, high + 1, width)
        counts = rng.integers(0, 9, (7, width)) * rng.integers(0, 2, (7, width)) ** rng.integers(1, 9)
        counts[3] *= 100_003
        assert (SlicedGains(gains.tolist()).sums(counts) == counts @ gains).all()
    assert SlicedGains([-8, 7]).sums(np.array([[1, 0], [0, 1], [0, 0]])).tolist() == [-8, 7, 0]


def test_numbered_counts_across_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(6)
    got = numbered(rows, [F.desc("k"), F.asc("id")], "at", Scratch(spark, "numbered")).collect()
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r["at"])] == want and sorted(r["at"] for r in got) == list(range(1, 1001))

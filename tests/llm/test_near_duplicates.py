from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.helpers import DOCS, brute_components, near_copies, prose
from tidegrid.llm.common import Scratch
from tidegrid.llm.components import components
from tidegrid.llm.ngram_join import Signatures, near_components, trie_links


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n ", "one", "One", "one two", "one two three", "ONE two\tthree"]
    passage = prose(rng, 60)
    for n, edits in ((12, 1), (30, 1), (60, 2), (120, 3), (400, 8), (400, 20)):
        base = prose(rng, n)
        texts += [base, base, *near_copies(rng, base, 12, edits)]
        texts += [t + " " + prose(rng, n // 20 + 1) for t in near_copies(rng, base, 3, 1)]
    texts += [passage + " " + prose(rng, 30) for _ in range(25)] + [prose(rng, rng.randint(1, 80)) for _ in range(30)]
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, n, num):
    rows = corpus(n)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    want = brute_components(rows, n, num, 100)
    assert len({c for _, c in want.values()}) < len(rows) - 15
    for members, tokens in ((1024, 2_000_000), (4, 2_000_000), (1024, 900)):  # in one block, and in many parts
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs, n, num, 100, members, tokens).collect()}
        assert got == want


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = prose(random.Random(3), 50)
    rows = [(7, text), (7, text), (7, "other words of this"), (None, text), (None, None), (3, text + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near_components(docs, 3, 90, 100).collect())
    assert got == sorted([("7", 48, 3), ("7", 48, 3), ("7", 2, 7), ("None", 48, 3), ("None", 0, None), ("3", 49, 3)], key=lambda x: x)
    assert near_components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_links_share_a_signature(num, den):
    rng = np.random.default_rng(5)
    sign = Signatures(num, den)
    for size in [*range(1, 40), 77, 150, 400]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            drop = rng.integers(0, max(1, size * (den - num) // den) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, rng.integers(0, size // 4 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert set(sign.of(a)) & set(sign.of(b)), (size, len(b), both)


def test_trie_finds_what_all_pairs_find():
    rng = np.random.default_rng(6)
    for _ in range(30):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 50))) for _ in range(25)]
        n = len(sets)
        stored, probing = rng.random(n) < 0.7, rng.random(n) < 0.7
        links = trie_links(sets, stored, probing, np.arange(n), 50, 100)
        group = list(range(n))

        def join(pairs):
            out = list(range(n))
            for a, b in pairs:
                out = [out[a] if x == out[b] else x for x in out]
            return [[out[i] == out[j] for j in range(n)] for i in range(n)]

        want = []
        for i in range(n):
            for j in range(n):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i != j and stored[i] and probing[j] and 2 * both >= len(sets[i]) + len(sets[j]) - both:
                    want.append((i, j))
        assert set(links) <= set(want) and len(links) < n and join(links) == join(want), group


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(900, 901), (901, 900), (7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[x] == 5 for x in range(200, 260)) and got[901] == 900
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0

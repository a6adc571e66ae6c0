"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import random
import re
from collections import defaultdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII = str.maketrans(UPPER, LOWER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "re on ti st an he nd in er ea th at ou or es is it ly ha ing".split()


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def shingles(text: str | None, n: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows: list[tuple[int, str | None]], n: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and den * both >= num * (len(x) + len(y) - both):
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng: random.Random, base: str, copies: int, edits: int) -> list[str]:
    out = []
    for _ in range(copies):
        w = base.split(" ")
        for _ in range(edits):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def distance_to_part(pattern: str, text: str) -> int:
    """Least edit distance between the pattern and any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def dropped_lines(rows: list[tuple[int, str | None]], min_docs: int) -> dict[int, str]:
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(ASCII)

    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if not (key(x) and len(seen[key(x)]) >= min_docs)) for i, t in rows}

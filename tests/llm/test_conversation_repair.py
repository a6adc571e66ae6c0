from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tests.llm.helpers import prose
from tidegrid.llm import queries
from tidegrid.llm.conversation_repair import END, backward, conversation_digests, fix_up, repair_conversations, step, trace

BLANKS = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Report and repaired turns of one conversation by a forward table over whole audits, without chunks or vectors."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    letters = [r[:1] for _, r, _ in rows]
    ways = {"": (0, "", ())}  # what the repaired initials end with -> cost, audit, turns

    def better(table, key, way):
        if key not in table or way[:2] < table[key][:2]:
            table[key] = way

    follows = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def inserts(table):
        for _ in range(3):
            for key, (c, w, out) in list(table.items()):
                better(table, follows[key][0], (c + 2, w + "I", (*out, f"{follows[key]}:")))
        return table

    for (_, role, text), letter, fault in zip(rows, letters, faults, strict=True):
        new = {}
        for key, (c, w, out) in inserts(ways).items():
            better(new, key, (c + 3, w + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            if letter and key + letter in ("s", "u", "su", "ua", "au"):
                better(new, letter, (c + cut, w + "K", (*out, f"{role}:{text}")))
            better(new, follows[key][0], (c + cut + 2, w + "R", (*out, f"{follows[key]}:{text}")))
        ways = new
    cost, audit, out = min(v for k, v in inserts(ways).items() if k in ("", "a"))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def fixture(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in enumerate(sizes):
        texts = [prose(rng, rng.randint(1, 4)).rstrip(".") + rng.choice([".", "!", "?", "", "  ", ".\n "]) for _ in range(6)]
        for t in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = rng.choice(["system", "tool", "", None, "u2"]) if rng.random() < 0.12 or t == 0 and rng.random() < 0.4 else role
            text = rng.choice([None, "", " \t", *texts]) if rng.random() < 0.4 else prose(rng, 3) + rng.choice([".", ".", "!", ""])
            turn = None if rng.random() < 0.05 else rng.randint(0, n) if rng.random() < 0.3 else t
            rows.append((None if conv == 2 else conv, turn, role, text))
    return rows


def repaired(spark, rows, bits):
    turns = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", seq int").repartition(3)
    report, told = repair_conversations(turns, bits)
    digests = {r.conv_id: r.repaired_sha256 for r in conversation_digests(told, "long").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*tuple(r)[1:], digests.get(r.conv_id, empty)) for r in report.collect()}


@pytest.mark.parametrize(("seed", "bits"), [(1, 1), (2, 2), (3, 12)])
def test_repair_against_a_plain_table(spark, seed, bits):
    rows = fixture(seed, [3, 1, 9, 0, 2, 150, 7, 30] + [5] * 20)
    groups = defaultdict(list)
    for conv, *turn in rows:
        groups[conv].append(tuple(turn))
    assert repaired(spark, rows, bits) == {conv: plain(turns) for conv, turns in groups.items()}


def test_query_on_a_fixture_equals_sql(spark, tmp_path):
    rows = fixture(9, [4] * 40 + [60, 1, 1, 2])
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op12(spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE['op12_conversation_repair']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_passes_fix_guesses_that_were_wrong():
    """Costs behind a chunk that differ by more than a constant change what comes before, until the chunk makes them equal."""
    rng = random.Random(4)
    changed = 0
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 8]) for _ in range(rng.randint(1, 12)))
        behind = backward(bytes(rng.choice([0, 1, 2, 3, 8]) for _ in range(rng.randint(1, 5))), END)
        guess = backward(codes, END)
        assert fix_up(codes, END, guess, behind) == backward(codes, behind)
        changed += guess != backward(codes, behind)
    assert changed > 5
    assert trace(b"\x01", END, 0, True) == (["K", "I"], 2)
    assert len({step(END, c)[0] for c in range(9)}) > 3


def test_repeated_rows_of_one_conversation_and_empty_table(spark):
    got = repaired(spark, [(1, None, "user", "hi.")] * 50 + [(1, 5, "assistant", "yes.")], 2)
    assert got[1][:7] == (0, 0, 49, 0, 49, 147, "K" + "D" * 49 + "K")
    report, told = repair_conversations(spark.createDataFrame([], TURNS))
    assert report.count() == told.count() == conversation_digests(told, "long").count() == 0

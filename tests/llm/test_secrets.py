from __future__ import annotations

import random
import re

import duckdb
import pytest

from tests.llm.helpers import prose
from tidegrid.llm import queries
from tidegrid.llm.secrets import scan_secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    """The base kinds, read off their definition."""
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


KEY = "aB3" + "xYz7" * 8
ACCESS = "AKIA" + "Q7" * 8


def mixed(rng):
    pieces = [
        "token = \"" + "%040x" % rng.getrandbits(160) + '"', "api_key: " + "k" * rng.randint(3, 15), "PassWord='" + KEY + "'", ACCESS[: rng.randint(9, 20)],
        "deadbeef" * rng.randint(1, 3), KEY[: rng.randint(15, 30)], "https://db.example.org/x?y=1", "host = db.internal", "user: admin_1", "client_id='abc'",
        "\n\n", "\n \t\n", "é ü 漢 😀", "secret = token = " + "z" * 14, "token=secret=abcdefghijklmnop", "access_key=" + ACCESS, "ſecret = abcdefghijklmnop", "passwd := x", "toKen=abcdefghijkl",
    ]
    return "".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n", prose(rng, rng.choice([1, 3, 60]))]) for _ in range(rng.randint(0, 14)))


def shown(rows):
    return [(r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans), r.credentials) for r in rows]


def test_base_spans_against_brute_force_and_all_spans_against_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, mixed(rng)) for i in range(400)] + [(400, None), (401, ""), (None, mixed(rng)), (3, mixed(rng)), (402, prose(rng, 3000) + mixed(rng) * 300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, row int").repartition(5)
    got = scan_secrets(docs).collect()
    assert len(got) == len(rows)
    base = sorted((str(r.doc_id), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in ("assign", "access", "hex"))) for r in got)
    assert base == sorted((str(i), ",".join(base_spans(t))) for i, t in rows)
    con = duckdb.connect()
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(f"SELECT doc_id, spans, n_credentials FROM ({queries.ORACLE['op13_secret_scan']})").fetchall()
    assert sorted(map(str, shown(got))) == sorted(map(str, want))
    assert sum(r.credentials for r in got) > 100 and any(s.kind in ("key", "pass", "ident", "endpoint") for r in got for s in r.spans)


@pytest.mark.parametrize(
    ("text", "spans", "credentials"),
    [
        (f"{ACCESS} goes with {KEY}", ["access", "key"], 1),
        (f"{ACCESS}\n\n{KEY}", ["access"], 0),  # another paragraph
        (f"{ACCESS} {'x ' * 200} {KEY}", ["access"], 0),  # too far
        (f"{KEY} alone", [], 0),
        ("user: bob password: hunter2x", [], 0),  # no endpoint
        ("https://db.example.org user: bob password: hunter2x", ["endpoint", "ident", "pass"], 1),
        ("https://db.example.org password: hunter2x", [], 0),
        ("server=db.x:5432 login=bob token=zbcdefabcdef1234", ["endpoint", "ident", "assign"], 1),
        (f"access_key={ACCESS} secret={KEY}", ["access", "assign"], 1),
        ("access AKIA12345678 host: s3.local " + KEY, ["ident", "endpoint", "key"], 1),
        (f"login=b11 login=b22 {KEY} login=b33 ftp://x.org/a", ["ident", "key", "endpoint"], 1),
    ],
)
def test_credentials(spark, text, spans, credentials):
    got = scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in got.spans] == spans and got.credentials == credentials
    if "b22" in text:
        assert text[got.spans[0].start : got.spans[0].end] == "login=b22"  # nearest on both sides: the one before


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "token=abcdefghijkl")] * 3
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert shown(got) == [(1, "assign:0:18", 0)] * 3
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0

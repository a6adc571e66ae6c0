from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, dropped_lines, prose
from tidegrid.llm import line_runs
from tidegrid.llm.line_runs import LineRuns, batches_for, drop_repeated_lines
from tidegrid.llm.queries import RULES
from tidegrid.llm.url_reputation import domain_of, host_reputation, judge_urls, suffix_of


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    common = [prose(rng, 5) for _ in range(6)]
    rows = []
    for i in range(120):
        lines = [prose(rng, 4) for _ in range(rng.randint(0, 4))] + [rng.choice(common).upper() + rng.choice(["", " ", "\t\r"]) for _ in range(3)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, common[0]), (204, common[0] + "\n" + common[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("n_dropped", F.lit("mine"))
    own = dict.fromkeys(("doc", "_lines", "_drop", "drop", "lines", "row", "tag", "batch", "h1"), "mine")
    docs = docs.withColumns({c: F.lit(v) for c, v in own.items()})
    for batches, fanout in ((1, 2), (5, 2), (7, 3), (None, 2)):
        out = {r.doc_id: r for r in drop_repeated_lines(docs, 10, 1, batches, fanout).collect()}
        want = dropped_lines(rows, 10)
        assert {i: r.text for i, r in out.items()} == want
        assert all(out[i].n_lines == len((t or "").split("\n")) for i, t in rows)
        assert out[204].n_dropped == 2 and out[202].n_dropped == 0
        assert all(r[c] == v for r in out.values() for c, v in own.items())
    plain = drop_repeated_lines(docs, 10, 1, counts=False)
    assert plain.columns == docs.columns and all(r.n_dropped == "mine" and r.text == want[r.doc_id] for r in plain.collect())


def test_lines_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "x\na", "en", "s", 0)] * 12 + [(None, "x\nb", "en", "s", 0)] * 3
    out = drop_repeated_lines(spark.createDataFrame(rows, DOCS), 3, 1).collect()
    assert len(out) == 15 and all(r.n_dropped == 0 for r in out)  # one document and one text
    assert drop_repeated_lines(spark.createDataFrame([], DOCS), 2).count() == 0


def test_runs_settle_lines_before_the_end(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, b), (1, 1, b), (2, 2, b), (3, 3 + b, b)][: 4 if b < 2 else 2], "h1 long, h2 long, doc long"))
    assert runs.settled
    assert {(r.h1, r.h2) for r in runs.repeated().collect()} == {(1, 1)}


def test_settings_of_the_query_fill_levels_and_settle(spark, monkeypatch):
    """With no more than the defaults: lines settle before the last batch, later batches leave them out, levels are compacted."""
    made, joined = [], []

    class Watched(LineRuns):
        def add(self, batch):
            joined.append(len(self.settled))
            super().add(batch)

        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(line_runs, "LineRuns", Watched)
    rows = [(i, f"own {i}\nshared {i % 3}", "en", "s", 0) for i in range(200)]
    out = drop_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.text == f"own {r.doc_id}" for r in out)
    assert len(joined) == batches_for(200) == 5 and joined[0] == 0 and joined[-1] > 0
    assert made[0].compactions >= 3 and sum(t.count() for t in made[0].settled) == 3
    assert batches_for(256_000) > batches_for(51_000) > batches_for(1000)


def test_rules_hosts_and_paths(spark):
    urls = [
        "https://Blog.Example.org/es/5?x=1", "http://example.org/en/12#t", "http://example.org/en/2", "ftp://a.com/fr/", "http://a.com/de/x", "http://a.com",
        "http://b.net?u=http://c.org/", "no scheme", None, "http://notexample.org/es/", "://org/", "http://x.org", "",
    ]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, none, RULES).collect()}
    assert got[0] == ("blog.example.org", "/es/5", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3] == ("a.com", "/fr/", "com/fr/", "allow") and got[4] == ("a.com", "/de/x", "com/de/", "block")
    assert got[5][:3] == ("a.com", "", None) and got[6][:3] == ("b.net", "", None)
    assert got[7][:3] == got[8][:3] == got[12][:3] == ("", "", None)
    assert got[9][2] == "org/" and got[10] == ("org", "/", "org/", "allow") and got[11][2] is None
    assert len(got) == len(urls)


def test_reputation_shrinks_to_parents(spark):
    rows = [("a.x.com", 1)] * 40 + [("a.x.com", 0)] * 10 + [("b.x.com", 1)] * 30 + [("c.y.com", 0)] * 60 + [("d.z.net", 0)] * 50 + [("d.z.net", None)] * 9
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    hosts = spark.createDataFrame([("new.x.com",), ("new.y.com",), ("new.org",), (None,), ("a.x.com",)], "host string")
    got = {r.host: r for r in host_reputation(outcomes, hosts).collect()}
    assert got["a.x.com"].n == 50 and got["a.x.com"].bad == 40 and got["d.z.net"].n == 50
    assert got["new.x.com"].mean > got["new.org"].mean > got["new.y.com"].mean
    assert got["new.x.com"].upper - got["new.x.com"].lower > got["a.x.com"].upper - got["a.x.com"].lower
    assert all(0 <= r.lower <= r.mean <= r.upper <= 1 for r in got.values()) and "" in got
    cells = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("localhost",), ("",)], "h string")
    assert [tuple(r) for r in cells.select(domain_of(F.col("h")), suffix_of(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("localhost", "localhost"), ("", "")]

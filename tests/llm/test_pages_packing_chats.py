from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from check_sql import TABLES, compare
from tests.llm.helpers import DOCS, prose
from tidegrid.llm.html_blocks import blocks_of, extract_pages, main_text
from tidegrid.llm.packing import Bins, pack_documents
from tidegrid.llm.preferences import every_turn, preference_rows, swapped_replies

SF = "/root/testdata/sf0.001"
LONG = "This is the text of the article and it is as long as a paragraph of an article has to be, with all of the words that are in it."


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")
@pytest.mark.parametrize(
    "name",
    [
        "op2_line_dedup", "op4_preference_format", "op4_preference_all", "op7_url_filter", "op11_importance_resampling", "op12_conversation_repair", "op13_secret_scan",
    ],
)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, text = compare(spark, con, name, SF)
    assert ok, text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain", ""),
        (f"<p>{LONG}", LONG),
        (f"<article><h1>A&nbsp;&amp; B</h1><p>{LONG}</p><p>Short.</p></article>", f"A & B\n\n{LONG}\n\nShort."),
        (f"<nav><a href=x>{LONG}</a></nav><p>{LONG}</p><footer>{LONG}</footer>", LONG),
        (f"<article><p><b>One\n two<br>three<br/><p>{LONG}<p>x</article><div class='ad'>{LONG}</div>", f"One two three\n\n{LONG}\n\nx"),
        (f"<script>if (a</p> '<p>{LONG}</p>')</script><main><p>{LONG}</p></main>", LONG),
        (f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section><form><p>{LONG}</p></form></article>", LONG),
        (f"<!-- <p>{LONG}</p> --><div id='content'><p>{LONG}</p></div><aside><p>{LONG}</p></aside>", LONG),
        (f"<div style='display:none'>{LONG}</div><div><p>{LONG}</p><h2>Links</h2><ul><li><a href=a>{LONG}</a></li></ul></div>", LONG),
        (f"<body><header><p>{LONG}</p></header><article><header><h1>T</h1></header><p>{LONG} <i>a</i>&#233;&lt;b</p></article>", f"T\n\n{LONG} aé<b"),
        ("<article><p>a<p>b", "a\n\nb"),
        (f"<article><p>{LONG}</p><p class='ad'>{LONG}</p><p class=\"notice\">{LONG}</p><p>One <span class='advert'>Buy!</span> two</p></article>", f"{LONG}\n\nOne two"),
        (f"<div class='layout has-sidebar no-ads with-header'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='page sidebar'><main><p>{LONG}</p></main><p>{LONG}</p></div>", LONG),
        (f"<aside><article><p>{LONG}</p></article></aside><article><p>a <a title='a hidden gem' href=x>gem</a></p></article>", "a gem"),
        (f"<article><p>{LONG}</p><div hidden><p>{LONG}</p></div><p aria-hidden='true'>x</p><div class='comment-box cookie-banner'>{LONG}</div></article>", LONG),
        (f"<div class='site-footer'>{LONG}</div><div id='Sidebar'><p>{LONG}</p></div><p>{LONG}</p>", LONG),
        (f"<article><p>{LONG} 1 < 2 and 3 > 2</p><p>cut off <a href='x", f"{LONG} 1 < 2 and 3 > 2\n\ncut off"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_undecided_blocks_follow_their_neighbours():
    page = f"<div><p>Lead</p><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><ul><li><a href=a>Home</a></li></ul><p>Tail</p><ul><li><a href=b>More</a></li></ul>"
    links = "".join(f"<li><a href=x>Link number {i} to another page of the site</a></li>" for i in range(3))
    assert main_text(page.replace("<p>Tail</p>", f"<ul>{links}</ul><p>Tail</p><ul>{links}</ul>")) == f"Lead\n\n{LONG}\n\nShort one.\n\n{LONG}"


def test_very_long_and_deep_pages():
    assert main_text("<div>" * 3000 + f"<p>{LONG}</p>") == LONG
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")) == 3000 * len(LONG) + 2 * 2999
    assert [b.text for b in blocks_of("<" * 50 + "a" * 50)] in ([], ["<" * 50 + "a" * 50], ["<" * 49])


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "mine"), (1, "u", None, "mine"), (None, None, "", None)], "page_id long, url string, html string, text string")
    got = extract_pages(pages).collect()
    assert sorted((r.n_chars, r.text) for r in got) == [(0, ""), (0, ""), (len(LONG), LONG)]
    assert extract_pages(pages.filter("false")).count() == 0


def check_bins(rows, capacity, per_source):
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for content in bins.values():
        content.sort(key=lambda r: r.slot)
        assert sum(r.n_words for r in content) <= capacity
        at = 0
        for slot, r in enumerate(content):
            assert r.bin_offset == at and r.slot == slot and r.n_words > 0
            at += r.n_words
        assert len({r.cluster for r in content}) == len(content)
        sources = [r.source for r in content]
        assert max(map(sources.count, sources)) <= per_source
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_every_place_is_the_best_fit(seed):
    """All bins are looked through at every step: the tightest that fits is taken, a new one only where none does."""
    rng = random.Random(seed)
    capacity, share = rng.choice([(20, 2), (100, 3), (64, 1)])
    bins, plain = Bins(capacity, share), []  # a plain bin: words left, sources, clusters
    for _ in range(600):
        size, source, cluster = rng.randint(1, capacity), rng.randrange(4), rng.choice([-1, -1, 0, 1, 2])
        fits = [b for b, (left, sources, clusters) in enumerate(plain) if left >= size and sources.count(source) < share and (cluster < 0 or cluster not in clusters)]
        b, offset = bins.place(size, source, cluster)
        if fits:
            assert b in fits and plain[b][0] == min(plain[x][0] for x in fits)
        else:
            assert b == len(plain)
            plain.append([capacity, [], []])
        assert offset == capacity - plain[b][0]
        plain[b][0] -= size
        plain[b][1].append(source)
        plain[b][2] += [cluster] if cluster >= 0 else []


def test_packing_is_whole_and_without_conflicts(spark):
    rng = random.Random(5)
    copy = prose(rng, 40)
    rows = [(i, prose(rng, rng.choice([1, 5, 30, 90, 350])), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(300)]
    rows += [(1000 + i, copy, "en", f"s{i % 4}", 0) for i in range(40)] + [(2000, None, "en", None, 0), (2001, "", None, "s", 0), (None, "a b c", "en", None, 0), (5, "again", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("mine"))
    for shard in (8192, 50):
        got = pack_documents(docs, capacity=100, per_source=3, shard=shard).collect()
        bins = check_bins(got, 100, 3)
        words = defaultdict(list)
        for r in got:
            words[r.doc_id].append((r.word_start, r.n_words))
        for i, text, *_ in rows:
            if i != 5:
                n, at = len((text or "").split()), 0
                for start, size in sorted(words[i]):
                    assert start == at
                    at += size
                assert at == n
        full = sum(r.n_words for r in got) / (100 * len(bins))
        assert full > 0.8, full
    assert pack_documents(docs.filter("false")).count() == 0
    assert pack_documents(docs.select("doc_id", "text"), 100).filter("bin_id IS NULL").count() == 2


def test_given_clusters_are_kept_apart(spark):
    docs = spark.createDataFrame([(i, "a b", "s", c) for i, c in enumerate(["x", "x", "y", None, None])], "doc_id long, text string, source string, cluster string")
    got = pack_documents(docs, capacity=10, per_source=9).collect()
    assert len({r.bin_id for r in got}) == 2 and len(got) == 5


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = Bins(10, 2)
    assert [bins.place(*x)[0] for x in ((7, 0, -1), (6, 0, -1), (3, 1, 0), (4, 1, 0))] == [0, 1, 0, 1]
    bins = Bins(10, 2)
    assert bins.place(6, 0, 0)[0] == 0 and bins.place(5, 0, 0)[0] == 1  # same cluster
    assert bins.place(4, 0, 1)[0] == 0 and bins.place(2, 0, 2)[0] == 1 and bins.place(1, 0, 3)[0] == 2 and bins.place(1, 1, 4)[0] == 1


TURNS = "pair_id long, turn long, role string, text string"


def test_preferences(spark):
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "yes <|end|>"), (2, 0, "user", "q"), (2, 1, "assistant", "x"), (3, 0, "user", "q"), (3, 1, "assistant", "x"), (3, 2, "user", "more")]
    a += [(4, 1, "assistant", "only"), (None, 0, "user", None), (5, 1, None, "b"), (5, 1, None, "a")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "no"), (1, 2, "user", "?"), (2, 1, "assistant", "x"), (2, 0, "user", "q"), (3, 0, "user", "q"), (None, 0, "user", ""), (6, 0, "user", "z"), (5, 1, None, "a")]
    got = {r.pair_id: r for r in preference_rows(spark.createDataFrame(a, TURNS), spark.createDataFrame(b, TURNS)).collect()}
    assert {i: (r.status, r.n_common) for i, r in got.items()} == {
        1: ("pair", 1), 2: ("same", 2), 3: ("prefix", 1), 4: ("unpaired", 0), 5: ("prefix", 1), 6: ("unpaired", 0), None: ("same", 1),
    }
    r = got[1]
    assert r.prompt == "<|user|>\nq<|end|>\n" and r.chosen == "<|assistant|>\nyes <\\|end|><|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n<|user|>\n?<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["yes <\\|end|><|end|>"] and [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["no<|end|>"]
    assert got[2].chosen == got[2].rejected == "" and got[4].rejected is None and got[6].chosen is None
    for r in got.values():
        if r.chosen is not None and r.status != "unpaired":
            assert r.prompt + r.chosen  # the conversation, rendered once
    none = spark.createDataFrame([], TURNS)
    assert preference_rows(none, none).count() == 0


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (1, 0, "assistant", "d"), (2, 0, "user", "e"), (3, 0, "assistant", "f"), (None, 0, "assistant", "g")]
    chosen, rejected = swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, chosen.collect())) == [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "assistant", "d"), (3, 0, "assistant", "f")]
    assert sorted(map(tuple, rejected.collect())) == [(0, 0, "user", "a"), (0, 1, "assistant", "d"), (1, 0, "assistant", "b")]


def test_every_conversation_and_turn_comes_back(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (0, None, "user", "z"), (1, 0, "assistant", "d"), (1, 1, "user", "d2")]
    rows += [(2, 0, "user", "e"), (2, 1, "user", "e2"), (3, 0, "assistant", "f"), (4, None, "assistant", "n"), (5, 0, "assistant", "h")]
    rows += [(None, 0, "assistant", "g"), (None, 1, "user", "g2"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, TURNS.replace("pair_id", "conv_id"))
    chosen, rejected, after = every_turn(turns)
    assert sorted(map(str, chosen.unionByName(after).collect())) == sorted(map(str, turns.withColumnRenamed("conv_id", "pair_id").collect()))
    got = {r.pair_id: r for r in preference_rows(chosen, rejected, after).collect()}
    assert {i: (r.status, r.n_common, r.n_after) for i, r in got.items()} == {
        0: ("pair", 1, 2), 1: ("pair", 0, 1), 2: ("unpaired", 0, 0), 3: ("unpaired", 0, 0), 4: ("unpaired", 0, 1), 5: ("unpaired", 0, 0), None: ("unpaired", 0, 2),
    }
    assert got[2].chosen == "<|user|>\ne<|end|>\n<|user|>\ne2<|end|>\n" and got[2].chosen_spans == [] and got[2].rejected is None
    assert got[0].rejected == "<|assistant|>\nd<|end|>\n" and got[0].after == "<|user|>\nc<|end|>\n<|user|>\nz<|end|>\n"
    assert got[4].chosen is None and got[4].after == "<|assistant|>\nn<|end|>\n" and got[None].after == "<|user|>\ng2<|end|>\n<||>\n<|end|>\n"
    assert sum((r.prompt + (r.chosen or "") + r.after).count("<|end|>") for r in got.values()) == len(rows)
    assert preference_rows(*every_turn(turns.filter("false"))).count() == 0

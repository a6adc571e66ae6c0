from __future__ import annotations

import random
from pathlib import Path

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import DOCS, brute_components, distance_to_part, dropped_lines, near_copies, prose
from tidegrid import session
from tidegrid.llm import common
from tidegrid.llm.decontaminate import normalise
from tidegrid.llm.queries import toxicity_model

BAD = ("idiot", "moron", "scum", "loser", "pathetic", "worthless")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with planted toxic texts, repeated lines, near copies and benchmark passages."""
    rng = random.Random(12)
    bench = [(k, prose(rng, 30)) for k in range(5)]
    footer = [prose(rng, 6) for _ in range(3)]
    rows: list[tuple] = []

    def put(text, source="s"):
        rows.append((len(rows), text, "en", source, len(text or "")))

    for i in range(60):
        put("\n".join([prose(rng, 40), rng.choice(footer), prose(rng, 10)]), f"s{i % 5}")
    for i in range(40):
        words = prose(rng, 40).split()
        for w in rng.sample(BAD, 3):
            words.insert(rng.randrange(len(words)), w)
        put(" ".join(words))
    base = prose(rng, 80)
    for text in [base, base, *near_copies(rng, base, 6, 1)]:
        put(text + "\n" + footer[0])
    for k in range(5):
        put(prose(rng, 20) + " " + bench[k][1].upper() + "\n" + prose(rng, 20))
    for text in (None, "", footer[0], "a b", prose(rng, 5000)):
        put(text)
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int(any(w in (r[1] or "") for w in BAD))) for r in rows if r[0] < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r for r in rows}, bench


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    folder, rows, bench = corpus
    model = toxicity_model(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))
    texts = {i: r[1] for i, r in rows.items()}
    want = [{i: t or "" for i, t in texts.items() if model.score([t or ""])[0] < 0.5}]
    want.append(dropped_lines(list(want[-1].items()), 10))
    groups = brute_components(list(want[-1].items()), 5, 80, 100)
    want.append({i: t for i, t in want[-1].items() if groups[i][1] == i})
    clean = {i: t for i, t in want[-1].items() if not any(distance_to_part(normalise(x), normalise(t)) <= int(len(normalise(x)) * 0.05) for _, x in bench)}
    want.append(clean)
    sizes = [len(x) for x in want]
    assert 60 < sizes[3] < sizes[2] < sizes[1] == sizes[0] < len(rows) - 30

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES, [*want, None], strict=True):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if expected is not None:
            assert docs.columns == columns
            assert {r.doc_id: r.text or "" for r in docs.collect()} == expected
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(clean)
    words = {i: 0 for i in clean}
    for r in packed:
        words[r.doc_id] += r.n_words
    assert words == {i: len(t.split()) for i, t in clean.items()}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.n_words) for r in whole} == {(r.doc_id, r.piece, r.n_words) for r in packed}


def test_near_duplicates_judges_rows_not_ids(spark):
    text = prose(random.Random(3), 50)
    rows = [(7, text, "en", "a", 0), (7, text, "en", "b", 0), (7, "other words of this", "en", "s", 0), (3, text + " x", "en", "s", 0), (None, text, "en", "s", 0)]
    rows += [(9, "a row that is there three times", "en", s, 0) for s in ("c", "b", "b")] + [(8, None, "en", "s", 0), (8, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    want = [rows[2], rows[3], rows[4], rows[6], *rows[8:]]
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    only = docs.filter("doc_id = 7 AND text != 'other words of this'")
    assert [tuple(r) for r in corpus_pipeline.near_duplicates(spark, only, "").collect()] == rows[:1]


OWN = {c: "mine" for c in ("score", "predicted", "doc", "_lines", "_drop", "text_key", "row", "leaks", "cls", "key", "hub", "first")}


def test_columns_of_the_caller_stay_and_stages_chain_without_a_write(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = wide = docs
    wide = wide.withColumns({c: F.lit(v) for c, v in OWN.items()}).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain, wide = stage(spark, plain, folder), stage(spark, wide, folder)
        assert wide.columns == [*docs.columns, *OWN, "tags"], name
    got = wide.collect()
    assert got and all(r[c] == v for r in got for c, v in OWN.items()) and all(r.tags == {"k": r.source} for r in got)
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((r.doc_id, r.text or "") for r in plain.collect())
    assert corpus_pipeline.packing(spark, wide, folder).count() >= len(got)


def test_runs_clear_what_stages_leave(spark, corpus, monkeypatch):
    """Other processes may use the shared folder, so only paths that this one makes are looked at."""
    folder, _, _ = corpus
    made, path_of = [], session.scratch_path

    def noted(spark, name):
        made.append(path_of(spark, name))
        return made[-1]

    monkeypatch.setattr(common, "scratch_path", noted)
    with session.scratch_scope(spark):
        out, again = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
        assert out.count() == again.count() > 0
        left = [p for p in map(Path, made) if p.exists()]
        assert len(made) > 8 and len(left) == 2 and all(p.name.startswith("corpus-") for p in left)
    assert not any(Path(p).exists() for p in made)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

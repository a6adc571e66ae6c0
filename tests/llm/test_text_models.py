from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, distance_to_part, prose
from tidegrid.llm import queries, toxicity
from tidegrid.llm.decontaminate import Matcher, find_leaks, myers, normalise, without_leaks
from tidegrid.llm.language_id import LanguageModel, codewords, feature_shares, fit_language_model, identify
from tidegrid.llm.lz_fingerprint import FACTORS, HASHES, SHIFTS, Parser, edited, fingerprints, likeness, neighbour_likeness, text_fingerprint
from tidegrid.llm.toxicity import ToxicityModel, fit_toxicity, label_model, score_toxicity, without_toxic

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def test_toxicity_learns_terms_and_scores_edge_cases(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else i % 2 and 1 or 0):
            words.insert(rng.randrange(len(words)), "zorb" + rng.choice(["al", "in", "ok"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (9999, 1)]
    docs = docs_of(spark, rows + [(1000, None), (1001, ""), (None, "zorbal zorbin zorbok")]).withColumn("score", F.lit("mine"))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, table, use=F.col("doc_id") % 5 != 0)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels[:400])
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5 and by[None].predicted == 1
    assert any(t.startswith("zorb") for _, t in model.events)
    kept = without_toxic(docs.withColumn("predicted", F.lit(7)), model).collect()
    assert len(kept) == sum(r.predicted == 0 for r in got) and all(r.score == "mine" and r.predicted == 7 for r in kept)
    texts = [t for _, t in rows]
    assert np.allclose(model.score(texts), [dense_score(model, t) for t in texts])


def dense_score(model, text):
    """The weights of all voters against their votes, voter by voter."""
    counts, total = model._hits(text)
    votes = [float(counts[t] >= k) for k, t in model.events] + [float(p.search(text) is not None) for _, p in toxicity._PATTERNS]
    votes += [float(total >= x) for x in toxicity.LEVELS] + [float(total >= 2 and 1000 * total >= d * len(text)) for d in toxicity.DENSITIES]
    return 1 / (1 + np.exp(-np.dot([*votes, np.log1p(total), 1.0], model.weights)))


def test_toxicity_without_labels_and_empty_tables(spark):
    docs = docs_of(spark, [(1, "you idiot, such a moron"), (2, "a fine day"), (3, None)])
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, fit_toxicity(docs, empty)).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    none = docs.filter("false")
    assert score_toxicity(none, fit_toxicity(none, empty)).count() == 0


def test_label_model_tells_good_voters_from_bad_and_shares_weight():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good = [np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02) for _ in range(3)]
    votes = np.array([*good, good[0], rng.random(4000) < 0.3]).T.astype(float)  # one voter twice, one that knows nothing
    q, voters = label_model(votes, np.where(rng.random(4000) < 0.1, ~y, y).astype(float))
    assert np.mean((q > 0.5) == y) > 0.9
    assert all(a > 0.5 and b < 0.1 for a, b in voters[:4]) and abs(voters[4][0] - voters[4][1]) < 0.1


@tables
def test_toxicity_held_out_accuracy(spark):
    got = queries.QUERIES["op1_toxicity"](spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic")
    n = {(r.toxic, r.predicted): r["count"] for r in got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.85


def test_myers_is_the_edit_distance():
    rng = random.Random(8)
    for _ in range(60):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        assert min([len(a), *myers(a, b)]) == distance_to_part(a, b)


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.randint(6, 40))) for k in range(12)] + [(50, None), (51, "short"), (52, "")]
    rows = []
    for i in range(60):
        text = prose(rng, 40)
        if i % 2:
            part = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["x"], [part[at], "y"]])
            text = text[:50] + "\n " + "".join(part).upper() + "  " + text[50:]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, items[0][1] * 3)]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    items += [(60, "\u00c9T\u00c9 of 42, now"), (61, "rows in t")]  # short: unchanged and whole words
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows += [(103, "x \u00e9t\u00e9  OF 42,\nNow y"), (104, "t\u00e9t\u00e9 of 42, now"), (105, "arrows in t rows in ten rows in T."), (106, "\u0130 and " + items[1][1].upper())]
    docs = docs_of(spark, rows)

    def holds(item, text):
        item, text = normalise(item), normalise(text or "")
        if len(item) < 24:
            return bool(re.search(r"(?<![^\W_])" + re.escape(item) + r"(?![^\W_])", text))
        return distance_to_part(item, text) <= int(len(item) * 0.05)

    want = {i: {k for k, x in items if x and holds(x, t)} for i, t in rows}
    assert want[103] == {60} and want[105] == {61} and want[106] == {1} and not want[104]
    texts = dict(rows)
    for chars in (4_000_000, 300):  # one automaton, several
        found = find_leaks(docs.withColumn("start", F.lit(1)), bench, shard_chars=chars).collect()
        got = {i: set() for i in want}
        for r in found:
            got[r.doc_id].add(r.item_id)
            if r.distance == 0:
                assert normalise(texts[r.doc_id][r.start : r.end]) == normalise(dict(items)[r.item_id])
        assert got == want
        clean = without_leaks(docs.withColumn("leaks", F.lit("mine")), bench, shard_chars=chars).collect()
        assert {r.doc_id for r in clean} == {i for i, w in want.items() if not w} and all(r.leaks == "mine" for r in clean)
    assert any(want.values()) and not all(want.values())
    assert find_leaks(docs, bench.filter("false")).count() == 0 and find_leaks(docs.filter("false"), bench).count() == 0


def test_every_place_of_an_item_is_reported():
    m = Matcher([(1, "the quick brown fox jumps over the dog")], 0.05, 10)
    text = "A  the quick\tbrown fox jumps over the dog b the quick brown fax jumps over the dog"
    hits = m.hits(text)
    assert [h["distance"] for h in hits] == [0, 1] and text[hits[1]["start"] : hits[1]["end"]] == "the quick brown fax jumps over the dog"
    assert text[hits[0]["start"] : hits[0]["end"]] == "the quick\tbrown fox jumps over the dog"


def test_codewords_are_apart():
    for n in (2, 3, 4, 9, 40):
        code = codewords(n, 15)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[i + 1 :]]
        assert code.shape == (n, 15) and min(apart) >= (7 if n <= 4 else 3)
    assert codewords(1, 15).shape == (1, 15) and codewords(0, 15).shape == (0, 15)


def test_wrong_bits_are_corrected():
    """Any single bit may be wrong and, with equal trust, any three, as codewords of four languages are eight apart."""
    code = codewords(4, 15)
    model = LanguageModel(list("abcd"), code, np.zeros((1, 15)), np.ones(15), 0.2)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) == 8
    for k, word in enumerate(code):
        for wrong in [[j] for j in range(15)] + [[0, 7, 14], [1, 2, 3], [4, 9, 13]]:
            bits = 3.0 * word
            bits[wrong] *= -1
            loss = [sum(np.log1p(np.exp(-c * b)) for c, b in zip(other, bits, strict=True)) for other in code]
            assert model.decode(bits)[0] == "abcd"[k] == "abcd"[int(np.argmin(loss))]
    assert model.decode(np.zeros(15))[2]


def test_repeated_questions_use_other_features():
    code = codewords(4, 15)
    use = feature_shares(code, 90)
    assert use[-1].all() and use[:-1].sum() == 90 * 7
    for i in range(15):
        for j in range(i):
            if (code[:, i] == code[:, j]).all():
                assert not (use[:-1, i] * use[:-1, j]).any()
    assert feature_shares(codewords(40, 15), 90).all()


def test_language_edge_cases(spark):
    rng = random.Random(11)
    other = lambda n: " ".join(rng.choice(["ção", "não", "uma", "ões", "lhe"]) + rng.choice(["a", "os"]) for _ in range(n))
    rows = [(i, prose(rng, 30) if i % 2 else other(30), "aa" if i % 2 else "bb", "s", 0) for i in range(300)]
    rows += [(900, None, "aa", "s", 0), (901, "", None, "s", 0), (902, "12 .. 34", "bb", "s", 0), (903, prose(rng, 9), None, "s", 0), (None, other(9), None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1))
    model = fit_language_model(docs, use=F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert len(got) == 305 and all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(300))
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert got[900].score == 0 and got[900].ambiguous and 0 <= got[903].score <= 1
    empty = fit_language_model(docs.filter("false"))
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}


@tables
def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op9_language_id"](spark, SF)
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").filter("lang IS NOT NULL")
    right = got.filter("held_out").join(langs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_parser_continues_where_it_stopped():
    text = prose(random.Random(1), 300)
    whole = Parser().feed(text)
    half = Parser().feed(text[:700])
    rest = half.fork().feed(text[700:])
    assert whole.phrases().tolist() == rest.phrases().tolist() and half.at == 700
    ends = whole.phrases()
    phrases = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert "".join(phrases) == text and len(set(phrases[:-1])) == len(phrases) - 1
    assert all(p[:-1] == "" or p[:-1] in phrases[:i] for i, p in enumerate(phrases))


def plain_fingerprint(text):
    """Phrases as strings, their polynomials and minima in whole numbers, one hash function after the other."""
    mask, mix, phrases, cur = (1 << 64) - 1, 0xD6E8FEB86659FD93, set(), ""
    for ch in text:
        cur += ch
        if cur not in phrases:
            phrases.add(cur)
            cur = ""
    phrases |= {cur} - {""}
    if not phrases:
        return [0] * HASHES
    values = []
    for phrase in phrases:
        h = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(phrase)) & mask
        h = (h ^ (h >> 32)) * mix & mask
        values.append(h ^ (h >> 29))
    minima = [min((h * int(f) + int(s)) & mask for h in values) for f, s in zip(FACTORS, SHIFTS, strict=True)]
    return [(m * mix & mask) >> 48 for m in minima]


def test_fingerprints_against_plain_minima():
    rng = random.Random(3)
    for text in ("", "a", "aaaa", "é漢😀 é漢😀", prose(rng, 60), prose(rng, 3) * 30):
        assert text_fingerprint(text).tolist() == plain_fingerprint(text)
    a, b = plain_fingerprint(prose(rng, 80)), plain_fingerprint(prose(rng, 80))
    share = sum(x == y for x, y in zip(a, b, strict=True)) / HASHES
    assert likeness(np.array(a, np.uint16), np.array(b, np.uint16)) == pytest.approx(max(0.0, (share - 2**-16) / (1 - 2**-16)))


def test_label_model_against_plain_updates():
    """Posteriors of independent voters by the definition, row by row and voter by voter."""
    rng = np.random.default_rng(6)
    votes = (rng.random((60, 4)) < [0.5, 0.3, 0.6, 0.2]).astype(float)
    gold = (votes[:, 0] + votes[:, 2] > 1).astype(float)
    hit = [(votes[gold == 1, j].sum() + 0.5) / (gold.sum() + 1) for j in range(4)]
    miss = [(votes[gold == 0, j].sum() + 0.5) / ((1 - gold).sum() + 1) for j in range(4)]
    rate, hit0, miss0 = gold.mean(), hit, miss
    for _ in range(3):
        q = []
        for row in votes:
            one, none = rate, 1 - rate
            for j, v in enumerate(row):
                one *= hit[j] if v else 1 - hit[j]
                none *= miss[j] if v else 1 - miss[j]
            q.append(one / (one + none))
        hit = [min(max((sum(p * r[j] for p, r in zip(q, votes)) + 20 * hit0[j]) / (sum(q) + 20), 1e-4), 1 - 1e-4) for j in range(4)]
        miss = [min(max((sum((1 - p) * r[j] for p, r in zip(q, votes)) + 20 * miss0[j]) / (60 - sum(q) + 20), 1e-5), 1 - 1e-4) for j in range(4)]
        rate = min(max(sum(q) / 60, 1e-3), 0.9)
    _, voters = label_model(votes, gold, rounds=3)
    assert np.allclose(voters, list(zip(hit, miss, strict=True)))


def test_fingerprints_follow_likeness():
    rng = random.Random(2)
    a = prose(rng, 400)
    close, far = edited(a, prose(rng, 400)), prose(rng, 400)
    p, q, r = (text_fingerprint(t) for t in (a, close, far))
    assert likeness(p, text_fingerprint(a)) == 1 and likeness(p, q) > 0.4 > likeness(p, r)
    assert likeness(text_fingerprint(""), text_fingerprint("")) == 1


def test_neighbours_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), prose(rng, rng.randint(0, 60)) + rng.choice(["", "é😀"])) for _ in range(90)] + [(-5, None), (2 * 10**6, "")]
    docs = docs_of(spark, rows)
    order = [(i, t or "") for i, t in sorted(dict(rows).items(), reverse=True)]
    assert len(order) == len(rows)
    for ranges in (1, 7, 40):
        got = {r.doc_id: r for r in neighbour_likeness(docs, ranges).collect()}
        assert len(got) == len(rows)
        for k, (i, text) in enumerate(order):
            other = order[(k + 1) % len(order)][1]
            want = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
            r, prints = got[i], [text_fingerprint(t) for t in (text, want, other)]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert r.fingerprint == prints[0].astype(">u2").tobytes().hex() and r.edited_fingerprint == prints[1].astype(">u2").tobytes().hex()
            assert r.near_edited == likeness(prints[0], prints[1]) and r.near_next == likeness(prints[0], prints[2])
    assert {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()} == {i: r.fingerprint for i, r in got.items()}


def test_neighbours_of_equal_and_null_ids(spark):
    docs = docs_of(spark, [(5, "bb bb"), (5, "aa aa"), (None, "zz zz zz"), (9, "cc cc cc"), (None, None)])
    for ranges in (1, 4):
        got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in neighbour_likeness(docs, ranges).collect()]
        texts = [(9, "cc cc cc"), (5, "aa aa"), (5, "bb bb"), (None, ""), (None, "zz zz zz")]
        want = [(i, len(t), hashlib.sha256(edited(t, texts[(k + 1) % 5][1]).encode()).hexdigest()) for k, (i, t) in enumerate(texts)]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert neighbour_likeness(docs.filter("false")).count() == 0
    one = neighbour_likeness(docs.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_model_is_sent_without_its_automaton():
    model = ToxicityModel([(1, "=x"), (2, "abcd")], np.zeros(2 + 4 + 4 + 3 + 2))
    model.score(["x abcde"])
    assert "_automaton" not in model.__getstate__()


def test_an_edit_is_parsed_and_hashed_behind_its_stem_only(monkeypatch):
    """A text and its edited form share what the edit leaves: it is parsed and hashed once, with the same result."""
    from tidegrid.llm import lz_fingerprint

    rng = np.random.default_rng(5)
    texts = ["", "a", "ab", "aaa", "aaaaaaaa", "\U0001f600" * 9 + "x", *("".join(rng.choice(list("abc d"), n)) for n in (3, 50, 900, 1500))]
    other = "".join(rng.choice(list("xya "), 700))
    for text in texts:
        stem, changed = lz_fingerprint.Stem(text), edited(text, other)
        assert (stem.fingerprint(text) == text_fingerprint(text)).all() and (stem.fingerprint(changed) == text_fingerprint(changed)).all()
        assert (stem.fingerprint(text) == text_fingerprint(text)).all()  # the stem is as before
    hashed, minima = [], lz_fingerprint._minima
    monkeypatch.setattr(lz_fingerprint, "_minima", lambda text, ends, start=0: hashed.append(ends[-1] - start if len(ends) else 0) or minima(text, ends, start))
    list(lz_fingerprint._chain(iter([lz_fingerprint.pd.DataFrame({"doc_id": [2, 1], "text": [texts[-1], other], "border": [False, False]})])))
    assert sum(hashed) < 1.5 * len(texts[-1]) + 1.1 * len(other)

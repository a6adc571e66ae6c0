from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import arrays, batches
from tidegrid.functions.arithmetic import acf_bar


@pytest.fixture(scope="module")
def row(spark):
    values = [float(v) for v in np.round(np.random.default_rng(3).normal(5, 2, 50), 4)]
    return values, spark.createDataFrame([(values,)], "seq array<double>")


@pytest.mark.parametrize(("length", "stride", "pad"), [(8, 4, True), (8, 4, False), (16, 8, True)])
def test_patches_unfold(row, length, stride, pad):
    values, df = row
    got = df.select(arrays.patches(F.col("seq"), 50, length, stride, pad).alias("p")).first()["p"]
    padded = np.array(values + [0.0] * (stride if pad else 0))
    expected = [padded[i : i + length].tolist() for i in range(0, len(padded) - length + 1, stride)]
    assert [list(p) for p in got] == expected
    assert len(got) == int((50 - length) / stride + 1) + (1 if pad else 0)


@pytest.mark.parametrize("last", [False, True])
def test_instance_normalisation_inverts(row, last):
    values, df = row
    x = np.array(values)
    stats = df.select("seq", arrays.instance_stats(F.col("seq"), last).alias("s"))
    normed = stats.select("s", arrays.normalize(F.col("seq"), F.col("s"), 2.0, 0.5).alias("n"))
    got = np.array(normed.first()["n"])
    centre = x[-1] if last else x.mean()
    np.testing.assert_allclose(got, (x - centre) / np.sqrt(x.var() + 1e-5) * 2 + 0.5, rtol=1e-9)
    back = normed.select(arrays.denormalize(F.col("n"), F.col("s"), 2.0, 0.5).alias("b")).first()["b"]
    np.testing.assert_allclose(back, x, rtol=1e-6)


def test_patch_sizes(spark):
    assert [arrays.default_patch_config(n)["patch_len"] for n in (48, 49, 168, 169)] == [4, 8, 8, 16]
    df = spark.createDataFrame([(48,), (168,), (336,)], "n int")
    got = [tuple(r[0]) for r in df.select(arrays.patch_config(F.col("n"))).collect()]
    assert got == [(4, 2), (8, 4), (16, 8)]


def test_bar(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (-0.01,), (1.0,)], "v double")
    assert [r[0] for r in df.select(acf_bar("v")).collect()] == ["·", "+" + "█" * 10, "-█", "+" + "█" * 20]


def test_channels_have_their_own_statistics_and_affine(spark):
    x = np.round(np.random.default_rng(4).normal([5, -20, 0], [1, 8, 0], (24, 3)), 4)
    df = spark.createDataFrame([(x.tolist(),)], "x array<array<double>>")
    w, b = [1.5, 0.5, 2.0], [0.25, -0.5, 1.0]
    for last in (False, True):
        stats = df.select("x", arrays.channel_stats(F.col("x"), 3, last).alias("s"))
        normed = stats.select("s", arrays.normalize_channels(F.col("x"), F.col("s"), w, b).alias("n"))
        centre = x[-1] if last else x.mean(0)
        np.testing.assert_allclose(np.array(normed.first()["n"]), (x - centre) / np.sqrt(x.var(0) + 1e-5) * w + b, rtol=1e-7, atol=1e-9)
        back = normed.select(arrays.denormalize_channels(F.col("n"), F.col("s"), w, b).alias("b")).first()["b"]
        np.testing.assert_allclose(np.array(back), x, rtol=1e-6, atol=1e-8)
    got = df.select(arrays.channel_patches(F.col("x"), 3, 24, 4, 2).alias("p")).first()["p"]
    padded = np.vstack([x, np.zeros((2, 3))])
    assert np.array(got).shape == (3, 12, 4) and all(got[c][k] == padded[2 * k : 2 * k + 4, c].tolist() for c in range(3) for k in range(12))


def test_batches_do_what_arrays_do(spark):
    """Batches of samples against the functions on one array a row; a NULL step makes that channel's results NULL."""
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (7, 24, 2)).tolist()
    x[3][10][1] = None
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x array<array<double>>")
    seq = lambda j: arrays.channel(F.col("x"), j)
    weigh = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    stats = lambda j, last: arrays.instance_stats(seq(j), last)
    want = df.select("id", *[c for j in (0, 1) for c in (
        weigh(arrays.normalize(seq(j), stats(j, False), 1.5, 0.25)).alias(f"mean{j}"), weigh(arrays.normalize(seq(j), stats(j, True), 1.5, 0.25)).alias(f"last{j}"),
        weigh(arrays.denormalize(arrays.normalize(seq(j), stats(j, False), 1.5, 0.25), stats(j, False), 1.5, 0.25)).alias(f"back{j}"),
        weigh(F.flatten(arrays.patches(seq(j), 24, 4, 2))).alias(f"patch{j}"),
    )])

    def build(batch, x):
        out = {"id": batch.column("id")}
        for j in (0, 1):
            v = batches.channel(x, j)
            mean, last = batches.instance_stats(v), batches.instance_stats(v, subtract_last=True)
            normal = batches.normalize(v, mean, 1.5, 0.25)
            out |= {f"mean{j}": batches.weighted_sum(normal), f"last{j}": batches.weighted_sum(batches.normalize(v, last, 1.5, 0.25))}
            out |= {f"back{j}": batches.weighted_sum(batches.denormalize(normal, mean, 1.5, 0.25))}
            out[f"patch{j}"] = batches.weighted_sum(batches.patches(v, 24, 4, 2).reshape(len(v), -1))
        return out

    got = batches.of_samples(df, build, want.schema.simpleString()[7:-1].replace(":", " "))
    for a, b in zip(got.orderBy("id").collect(), want.orderBy("id").collect(), strict=True):
        assert [v is None for v in a] == [v is None for v in b]
        assert a == pytest.approx(tuple(b), abs=1e-9)
    assert got.where("mean1 IS NULL").count() == 1

"""Array functions on samples: channels, patches and instance normalisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5  # added to the variance (fixed)


def patch_config(seq_len: Column) -> Column:
    """Patch length and stride by sequence length."""

    def pair(a: int, b: int) -> Column:
        return F.struct(F.lit(a).alias("patch_len"), F.lit(b).alias("stride"))

    return F.when(seq_len <= 48, pair(4, 2)).when(seq_len <= 168, pair(8, 4)).otherwise(pair(16, 8))


def default_patch_config(seq_len: int) -> dict[str, int]:
    length = 4 if seq_len <= 48 else 8 if seq_len <= 168 else 16
    return {"patch_len": length, "stride": length // 2}


def channel(x: Column, j: int) -> Column:
    """One channel of a step-major sample."""
    return F.transform(x, lambda row: row[j])


def patches(seq: Column, seq_len: int, patch_len: int, stride: int, pad_end: bool = True) -> Column:
    """Overlapping pieces of a sequence; ``pad_end`` appends ``stride`` zeros first."""
    last = (seq_len - patch_len) // stride + (1 if pad_end else 0)
    padded = F.concat(seq, F.array_repeat(F.lit(0.0), stride)) if pad_end else seq
    return F.transform(
        F.sequence(F.lit(0), F.lit(last)), lambda i: F.slice(padded, i * stride + 1, F.lit(patch_len))
    )


def instance_stats(seq: Column, subtract_last: bool = False) -> Column:
    """``struct(centre, scale)`` of one sequence; the deviation is the population one."""
    n = F.size(seq)
    mean = F.aggregate(seq, F.lit(0.0), lambda a, v: a + v) / n

    def stats(m: Column) -> Column:
        var = F.aggregate(seq, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n
        return F.struct((F.element_at(seq, -1) if subtract_last else m).alias("centre"), F.sqrt(var + EPS).alias("scale"))

    # As a lambda variable the mean is computed once, not anew for every step.
    return F.transform(F.array(mean), stats)[0]


def normalize(seq: Column, stats: Column, weight: float | Column = 1.0, bias: float | Column = 0.0) -> Column:
    return F.transform(seq, lambda v: (v - stats["centre"]) / stats["scale"] * weight + bias)


def denormalize(seq: Column, stats: Column, weight: float | Column = 1.0, bias: float | Column = 0.0) -> Column:
    return F.transform(
        seq, lambda v: (v - bias) / (weight + EPS * EPS) * stats["scale"] + stats["centre"]
    )


def per_channel(x: Column, channels: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f(sequence, index)`` of every channel of a step-major sample, as an array over the channels."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda j: f(F.transform(x, lambda row: row[j]), j))


def channel_patches(x: Column, channels: int, seq_len: int, patch_len: int, stride: int, pad_end: bool = True) -> Column:
    """[channel][patch][step]: every channel of a ``[steps][channels]`` sample is cut on its own."""
    return per_channel(x, channels, lambda seq, _: patches(seq, seq_len, patch_len, stride, pad_end))


def channel_stats(x: Column, channels: int, subtract_last: bool = False) -> Column:
    """``struct(centre, scale)`` of every channel of a sample."""
    return per_channel(x, channels, lambda seq, _: instance_stats(seq, subtract_last))


def normalize_channels(x: Column, stats: Column, weights: Sequence[float], biases: Sequence[float]) -> Column:
    """A ``[steps][channels]`` sample with each channel normalised and scaled by its own weight and bias."""
    w, b = (F.array(*[F.lit(float(v)) for v in values]) for values in (weights, biases))
    return F.transform(x, lambda row: F.transform(row, lambda v, j: (v - stats[j]["centre"]) / stats[j]["scale"] * w[j] + b[j]))


def denormalize_channels(x: Column, stats: Column, weights: Sequence[float], biases: Sequence[float]) -> Column:
    w, b = (F.array(*[F.lit(float(v)) for v in values]) for values in (weights, biases))
    return F.transform(x, lambda row: F.transform(row, lambda v, j: (v - b[j]) / (w[j] + EPS * EPS) * stats[j]["scale"] + stats[j]["centre"]))

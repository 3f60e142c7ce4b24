"""Cepstra of signals as array expressions.

A signal is one array of its row; frames, power spectrum, mel energies, cepstra
and their slopes are computed from it without a shuffle. The transforms are
small matrices that depend on the settings only; they travel as one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.audio import mel_filters
from threadloom.functions.numeric import dot, let


@dataclass(frozen=True)
class Settings:
    """Window and hop are samples; the transform's length is the next power of 2."""

    rate: int = 16000
    window: int = 400
    hop: int = 160
    n_mels: int = 40
    n_cepstra: int = 13
    preemphasis: float = 0.97
    orders: int = 2

    @property
    def n_fft(self) -> int:
        return 1 << (self.window - 1).bit_length()


COMPLEX = "struct<re: double, im: double>"


def coefficients(s: Settings) -> tuple[list[tuple], str]:
    """One row and its schema: the window's weights, the factors of each halving
    of the transform, the mel filters (first bin from 1 and weights up to the
    last that isn't 0) and the ``dct`` of their logs."""
    row, schema = [np.hamming(s.window).tolist()], ["_taper array<double>"]
    length, stride = s.n_fft, 1
    while length > 1:
        w = np.exp(-2j * np.pi * np.repeat(np.arange(length // 2), stride) / length)
        row.append([(z.real, z.imag) for z in w.tolist()])
        schema.append(f"_turn{stride} array<{COMPLEX}>")
        length, stride = length // 2, stride * 2
    mel = []
    for f in mel_filters(s.n_mels, s.n_fft, s.rate):
        on = np.flatnonzero(f)
        lo, hi = (int(on[0]), int(on[-1]) + 1) if len(on) else (0, 1)
        mel.append((lo + 1, f[lo:hi].tolist()))
    k, n = np.arange(s.n_cepstra)[:, None], s.n_mels
    dct = np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    dct[0] /= np.sqrt(2)
    return [(*row, mel, dct.tolist())], ", ".join([*schema, "_mel array<struct<at: int, w: array<double>>>", "_dct array<array<double>>"])


def spectrum(frame: Column, n_fft: int) -> Column:
    """Power at the frequencies 0 to n_fft / 2: the fast transform, each halving
    sums of the two halves and turned differences, dealt in turn by blocks."""

    def pair(re: Column, im: Column) -> Column:
        return F.struct(re.alias("re"), im.alias("im"))

    half = n_fft // 2

    def halved(x: Column, stride: int) -> Column:
        if stride == n_fft:
            return F.transform(F.slice(x, 1, half + 1), lambda c: (c["re"] * c["re"] + c["im"] * c["im"]) / n_fft)
        low, high = F.slice(x, 1, half), F.slice(x, half + 1, half)
        both = F.zip_with(low, high, lambda a, b: pair(a["re"] + b["re"], a["im"] + b["im"]))
        apart = F.zip_with(low, high, lambda a, b: pair(a["re"] - b["re"], a["im"] - b["im"]))
        turned = F.zip_with(apart, F.col(f"_turn{stride}"), lambda z, w: pair(z["re"] * w["re"] - z["im"] * w["im"], z["re"] * w["im"] + z["im"] * w["re"]))
        blocks = F.sequence(F.lit(1), F.lit(half), F.lit(stride))
        dealt = let(both, lambda u: let(turned, lambda v: F.flatten(F.transform(blocks, lambda at: F.concat(F.slice(u, at, stride), F.slice(v, at, stride))))))
        return let(dealt, lambda y: halved(y, 2 * stride))

    weighed = F.zip_with(frame, F.col("_taper"), lambda v, w: pair(v * w, F.lit(0.0)))
    return let(weighed, lambda x: let(F.concat(x, F.array_repeat(pair(F.lit(0.0), F.lit(0.0)), n_fft - F.size(x))), lambda y: halved(y, 1)))


def emphasised(x: Column, coeff: float) -> Column:
    """P07 over an array: each sample less ``coeff`` times the one before it."""
    before = F.concat(F.array(F.lit(0.0)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    return F.zip_with(x, before, lambda now, last: now - coeff * last)


def frames(x: Column, window: int, hop: int) -> Column:
    """Overlapping frames; a signal shorter than a frame is padded by zeros,
    samples after the last whole frame are left out."""
    padded = F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(window) - F.size(x), F.lit(0))))
    return let(padded, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - window, F.lit(hop)), lambda at: F.slice(v, at + 1, window)))


def slopes(x: Column, reach: int = 2) -> Column:
    """Regression slopes over ``reach`` frames on both sides, edges repeated."""
    norm = 2.0 * sum(d * d for d in range(1, reach + 1))

    def at(v: Column, t: Column) -> Column:
        return F.get(v, F.least(F.greatest(t, F.lit(0)), F.size(v) - 1))

    def slope(v: Column, t: Column) -> Column:
        parts = [weighted(at(v, t + d), at(v, t - d), d / norm) for d in range(1, reach + 1)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)

    return let(x, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda t: slope(v, t)))


def weighted(a: Column, b: Column, w: float) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * w)


def cepstra(signals: DataFrame, signal: str, s: Settings = Settings(), out: str = "frames") -> DataFrame:
    """``signals`` with ``out``: an array of frames, each the ``n_cepstra`` cepstra
    and their ``orders`` slopes. Null or empty signals give an empty array, null
    samples count as 0. Power is floored at 1e-10 before its log."""
    spark = signals.sparkSession
    table = spark.createDataFrame(*coefficients(s))

    def frame(f: Column) -> Column:
        energy = let(spectrum(f, s.n_fft), lambda p: F.transform("_mel", lambda m: dot(F.slice(p, m["at"], F.size(m["w"])), m["w"])))
        return let(F.transform(energy, lambda e: F.log(F.greatest(e, F.lit(1e-10)))), lambda logs: F.transform("_dct", lambda r: dot(r, logs)))

    x = F.transform(F.col(signal), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    static = F.transform(frames(emphasised(x, s.preemphasis), s.window, s.hop), frame)
    none = F.array().cast("array<array<double>>")
    made = signals.crossJoin(F.broadcast(table)).withColumn(out, F.when(F.size(signal) > 0, with_slopes(static, s.orders)).otherwise(none))
    return made.drop(*table.columns)


def with_slopes(static: Column, orders: int) -> Column:
    """Frames joined with their slopes, the slopes' slopes, and so on."""
    if orders == 0:
        return static

    def more(whole: Column, last: Column, left: int) -> Column:
        if left == 0:
            return whole
        return let(slopes(last), lambda d: more(F.zip_with(whole, d, lambda a, b: F.concat(a, b)), d, left - 1))

    return let(static, lambda c: more(c, c, orders))

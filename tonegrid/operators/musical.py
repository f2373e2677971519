"""Chroma, keys and chords."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import layout, spectral

KEYS = layout.KEYS

# The Krumhansl-Kessler key profiles, from the root upwards, and the triads' steps.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
TRIADS = {"": (0, 4, 7), "m": (0, 3, 7)}
NOISE, LOWEST_HZ, HIGHEST_HZ = 0.001, 80.0, 4000.0
MAX_ENTROPY = 3.58


def chroma(spectra: DataFrame, rate: float, size: int, keys: tuple[str, ...] = KEYS, low: float = LOWEST_HZ, high: float = HIGHEST_HZ) -> DataFrame:
    """(keys, chroma): shares of the twelve pitch classes, all 0 if no bin of the range is above the noise.

    Which class a bin belongs to depends on the parameters alone, so a frame is folded in its row
    (in the Arrow batch that its transform came in), and frames are summed per key on the map side.
    """
    folded = np.zeros((size // 2 + 1, 12))
    for b in range(1, size // 2 + 1):
        hz = b * rate / size
        if low < hz < high:
            folded[b, math.floor(69 + 12 * math.log2(hz / 440.0) + 0.5) % 12] = 1.0

    @F.pandas_udf("array<double>")
    def fold(mags: pd.Series) -> pd.Series:
        return mags.map(lambda m: np.where(np.asarray(m) > NOISE, np.asarray(m), 0.0) @ folded)

    sums = spectra.select(*keys, fold("mag").alias("c"))
    parts = sums.select(*keys, *[F.get("c", F.lit(i)).alias(f"c{i}") for i in range(12)])
    out = parts.groupBy(*keys).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(12)])
    whole = sum((F.col(f"c{i}") for i in range(12)), F.lit(0.0))
    return out.select(*keys, F.array(*[F.coalesce(scalar.ratio(F.col(f"c{i}"), whole), F.lit(0.0)) for i in range(12)]).alias("chroma"))


def _dot(profile: tuple[float, ...], shift: int, chroma_: str) -> Column:
    """Sum of chroma[(i + shift) mod 12] * profile[i]."""
    return sum((F.get(chroma_, F.lit((i + shift) % 12)) * F.lit(w) for i, w in enumerate(profile) if w), F.lit(0.0))


def key_scores(chromas: DataFrame, keys: tuple[str, ...] = KEYS, top: int = 4) -> DataFrame:
    """(keys, chroma, candidates): the ``top`` of 24 keys as structs (score, key, root, mode), best first.

    Of equal scores the earlier in the order C major, C minor, C# major, ... is better.
    """
    rows = []
    for shift, note in enumerate(scalar.NOTES):
        for place, (mode, profile) in enumerate((("major", MAJOR), ("minor", MINOR))):
            rows.append(F.struct(_dot(profile, shift, "chroma").alias("score"), F.lit(-(2 * shift + place)).alias("o"), F.lit(f"{note} {mode}").alias("key"), F.lit(note).alias("root"), F.lit(mode).alias("mode")))
    ranked = F.slice(F.sort_array(F.array(*rows), asc=False), 1, top)
    return chromas.select(*keys, "chroma", F.transform(ranked, lambda r: F.struct(r["score"].alias("score"), r["key"].alias("key"), r["root"].alias("root"), r["mode"].alias("mode"))).alias("candidates"))


def detect_key(chromas: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, key, root, mode, score, confidence, alternatives, tonality, mode_clarity, harmonic_complexity)."""
    scored = key_scores(chromas, keys)
    best, second = F.col("candidates")[0], F.col("candidates")[1]
    apart = (best["score"] - second["score"]) / F.greatest(best["score"], F.lit(0.001))
    confidence = scalar.clamp(apart * 0.7 + F.least(best["score"] / 100.0, F.lit(1.0)) * 0.3)
    root = scalar.note_index(best["root"])
    step = lambda k: F.get("chroma", F.pmod(root + k, F.lit(12)))
    clarity = F.least(F.abs(step(4) - step(3)) * 2.0 + step(7), F.lit(1.0))
    entropy = F.aggregate("chroma", F.lit(0.0), lambda s, v: s + F.when(v > NOISE, -v * F.log2(v)).otherwise(F.lit(0.0)))
    return scored.select(
        *keys, best["key"].alias("key"), best["root"].alias("root"), best["mode"].alias("mode"), best["score"].alias("score"),
        confidence.alias("confidence"),
        F.transform(F.slice("candidates", 2, 3), lambda c: c["key"]).alias("alternatives"),
        scalar.clamp(best["score"] / 100.0).alias("tonality"),
        clarity.alias("mode_clarity"),
        scalar.clamp(entropy / MAX_ENTROPY).alias("harmonic_complexity"),
    )


def detect_chord(chromas: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, chord, confidence): the best of 24 triads, the earlier of equal ones; keys without one have no row."""
    rows = []
    for shift, note in enumerate(scalar.NOTES):
        for place, (suffix, steps) in enumerate(TRIADS.items()):
            profile = tuple(1.0 if i in steps else 0.0 for i in range(12))
            rows.append(F.struct(_dot(profile, shift, "chroma").alias("score"), F.lit(-(2 * shift + place)).alias("o"), F.lit(note + suffix).alias("chord")))
    best = F.array_max(F.array(*rows))
    out = chromas.select(*keys, best.alias("b")).where("b.score > 0")
    return out.select(*keys, F.col("b.chord").alias("chord"), F.col("b.score").alias("confidence"))


def chord_progression(samples: DataFrame, rate: float, size: int = 4096, hop: int = 2048) -> DataFrame:
    """(signal_id, window, start_time, duration, chord, confidence) of half seconds at half overlap."""
    half = int(rate * 0.5)
    if half < size:
        return detect_chord(chroma(spectral.stft(layout.frames_of(samples, size, hop)).withColumn("window", F.lit(0)), rate, size, ("signal_id", "window")), ("signal_id", "window")).limit(0).selectExpr("signal_id", "cast(window as bigint) window", "0D start_time", "0.5D duration", "chord", "confidence")
    keys = ("signal_id", "window")
    dealt = layout.assign(samples, half, half // 2, "window")
    whole = dealt.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") == half)
    dealt = dealt.join(whole.drop("n"), list(keys))
    found = detect_chord(chroma(spectral.stft(layout.frames_of(dealt, size, hop, keys, "off"), keys=keys), rate, size, keys), keys)
    return found.select(*keys, (F.col("window") * (half // 2) / F.lit(float(rate))).alias("start_time"), F.lit(0.5).alias("duration"), "chord", "confidence")


def time_signature() -> Column:
    """The signature that is assumed of everything."""
    return F.struct(F.lit(4).alias("numerator"), F.lit(4).alias("denominator"), F.lit(0.5).alias("confidence"))

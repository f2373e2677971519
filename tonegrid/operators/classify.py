"""Content classes: speech, music, silence or mixed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, scalar
from . import layout, spectral

KEYS = layout.KEYS


def frame_stats(crossed: DataFrame, size: int, hop: int, keys: tuple[str, ...] = KEYS, pos: str = "pos") -> DataFrame:
    """(keys, frame_idx, zcr, rms) of whole frames; ``zcr`` is sign changes by the frame's size."""
    dealt = layout.assign(crossed, size, hop, "frame_idx", pos, "turn")
    out = dealt.groupBy(*keys, "frame_idx").agg(
        F.count("*").alias("n"),
        (F.sum(F.when(F.col("turn") > 0, F.col("crossed")).otherwise(0)) / F.lit(float(size))).alias("zcr"),
        F.sqrt(F.sum(F.col("x") * F.col("x")) / F.lit(float(size))).alias("rms"),
    )
    return out.where(F.col("n") == size).drop("n")


def stat_features(stats: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, zcr_mean, zcr_std, energy_mean, energy_std, low_energy_rate); population deviations."""
    mean = stats.groupBy(*keys).agg(F.avg("rms").alias("energy_mean"))
    low = F.when(F.col("rms") < F.col("energy_mean") * 0.5, 1).otherwise(0)
    return stats.join(mean, list(keys)).groupBy(*keys).agg(
        F.avg("zcr").alias("zcr_mean"),
        F.stddev_pop("zcr").alias("zcr_std"),
        F.max("energy_mean").alias("energy_mean"),
        F.stddev_pop("rms").alias("energy_std"),
        F.avg(low).alias("low_energy_rate"),
    )


def spectral_features(spectra: DataFrame, rate: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, spectral_rolloff_mean, spectral_centroid_variance, spectral_flux_mean).

    Frequencies are bin * rate / (2 * bins), a slightly smaller scale than the bins' own.
    """
    hz = F.lit(float(rate)) / (F.size("mag") * 2)
    frames = spectra.select(*keys, "frame_idx", (arrays.rolloff_index("mag") * hz).alias("rolloff"), (arrays.mean_index("mag") * hz).alias("centroid"))
    moved = spectral.flux(spectra, keys).groupBy(*keys).agg(F.coalesce(F.avg("flux_l2"), F.lit(0.0)).alias("spectral_flux_mean"))
    out = frames.groupBy(*keys).agg(F.avg("rolloff").alias("spectral_rolloff_mean"), F.var_pop("centroid").alias("spectral_centroid_variance"))
    return out.join(moved, list(keys))


def periodicity(frame: str | Column, shortest: int, longest: int) -> Column:
    """Greatest of 2 sum(x y) / sum(x x + y y) over lags ``shortest`` to ``longest`` - 1 of a frame, 0 at least."""

    def one(x: np.ndarray) -> float:
        power, best = np.append(0.0, np.cumsum(x * x)), 0.0
        for lag in range(shortest, longest):
            energy = power[len(x) - lag] + power[-1] - power[lag]
            if energy > 0:
                best = max(best, 2.0 * float(x[: len(x) - lag] @ x[lag:]) / energy)
        return best

    @F.pandas_udf("double")
    def run(frames: pd.Series) -> pd.Series:
        return frames.map(lambda f: one(np.asarray(f, dtype=float)))

    return run(scalar.col(frame))


def harmonicity(samples: DataFrame, rate: float, keys: tuple[str, ...] = KEYS, pos: str = "pos", seconds: float = 0.04) -> DataFrame:
    """(keys, hnr): mean periodicity of 40 ms frames at half their length; rates too low for a lag give no row."""
    size = int(seconds * rate)
    if size < 2:
        return samples.select(*keys, F.lit(0.0).alias("hnr")).limit(0)
    frames = layout.frames_of(samples, size, max(1, size // 2), keys, pos)
    value = periodicity("frame", int(rate / 500), min(int(rate / 50), size // 2))
    return frames.select(*keys, value.alias("v")).groupBy(*keys).agg(F.avg("v").alias("hnr"))


def features(crossed: DataFrame, rate: float, size: int = 2048, hop: int = 512, keys: tuple[str, ...] = KEYS, pos: str = "pos", spectra: DataFrame | None = None) -> DataFrame:
    """One row a key: everything the class is decided by. Signals shorter than a frame have nulls."""
    if spectra is None:
        spectra = spectral.stft(layout.frames_of(crossed, size, hop, keys, pos), keys=keys)
    out = stat_features(frame_stats(crossed, size, hop, keys, pos), keys)
    out = out.join(spectral_features(spectra, rate, keys), list(keys), "left").join(harmonicity(crossed, rate, keys, pos), list(keys), "left")
    return out.withColumn("hnr", F.coalesce("hnr", F.lit(0.0)))


# What each test of the features adds to the scores, as
# (name of the test, points for speech if it holds, for music if it holds, for speech if not, for music if not).
POINTS = (
    ("busy", 0.2, 0.0, 0.0, 0.2),
    ("dull", 0.15, 0.0, 0.0, 0.0),
    ("bright", 0.0, 0.15, 0.0, 0.0),
    ("steady", 0.15, 0.0, 0.0, 0.15),
    ("pauses", 0.2, 0.0, 0.0, 0.2),
    ("voiced", 0.15, 0.0, 0.0, 0.1),
    ("uneven", 0.1, 0.0, 0.0, 0.1),
    ("moving", 0.0, 0.15, 0.1, 0.0),
)
SILENCE, QUIET = 0.05, 0.01


def scores(features_: DataFrame) -> DataFrame:
    """Adds speech, music, silence, content_type and confidence.

    A null feature fails its test (a digital silence has no centroid variance).
    """
    c = F.col
    spread = c("energy_std") / F.greatest(c("energy_mean"), F.lit(0.001))
    tests = {
        "busy": (c("zcr_mean") > 0.05) & (c("zcr_std") > 0.02),
        "dull": c("spectral_rolloff_mean") < 2000.0,
        "bright": c("spectral_rolloff_mean") > 4000.0,
        "steady": c("spectral_centroid_variance") < 1_000_000.0,
        "pauses": c("low_energy_rate") > 0.3,
        "voiced": c("hnr") > 0.3,
        "uneven": (spread > 0.3) & (spread < 0.8),
        "moving": c("spectral_flux_mean") > 0.5,
    }
    tests = {k: F.coalesce(v, F.lit(False)) for k, v in tests.items()}
    speech = music = F.lit(0.0)
    for name, s_yes, m_yes, s_no, m_no in POINTS:
        speech = speech + F.when(tests[name], F.lit(s_yes)).otherwise(F.lit(s_no))
        music = music + F.when(tests[name], F.lit(m_yes)).otherwise(F.lit(m_no))
    silent = F.coalesce(c("energy_mean"), F.lit(0.0)) < QUIET
    raw = features_.withColumns({"s": speech, "m": music})
    total = c("s") + c("m") + F.lit(SILENCE)
    out = raw.withColumns(
        {
            "speech": F.when(silent, F.lit(0.02)).otherwise(c("s") / total),
            "music": F.when(silent, F.lit(0.03)).otherwise(c("m") / total),
            "silence": F.when(silent, F.lit(0.95)).otherwise(F.lit(SILENCE) / total),
        }
    ).drop("s", "m")
    best, other = F.greatest("speech", "music"), F.least("speech", "music")
    leader = F.when(c("speech") > c("music"), F.lit("Speech")).otherwise(F.lit("Music"))
    quiet = (c("silence") > c("speech")) & (c("silence") > c("music"))
    kind = F.when(quiet, F.lit("Silence")).when((best <= 0.7) & (other > 0.3), F.lit("Mixed")).otherwise(leader)
    return out.withColumns({"content_type": kind, "confidence": F.when(quiet, c("silence")).otherwise(best)})


def classify_segments(crossed: DataFrame, rate: float, size: int = 2048, hop: int = 512) -> DataFrame:
    """(signal_id, segment, start_time, end_time, content_type, confidence) of seconds at half overlap."""
    second = max(1, int(rate))
    dealt = layout.assign(crossed, second, max(1, second // 2), "segment")
    whole = dealt.groupBy("signal_id", "segment").agg(F.count("*").alias("n")).where(F.col("n") == second)
    dealt = dealt.join(whole.drop("n"), ["signal_id", "segment"])
    out = scores(features(dealt, rate, size, hop, ("signal_id", "segment"), "off"))
    start = F.col("segment") * F.lit(0.5)
    return out.select("signal_id", "segment", start.alias("start_time"), (start + 1.0).alias("end_time"), "content_type", "confidence")

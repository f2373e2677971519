"""Test signals made by Spark: no data is shipped, every sample is an expression of its position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequencies of the C major triad.
C_MAJOR = (261.63, 329.63, 392.0)


def series(spark: SparkSession, signal_id: str, seconds: float, rate: float, value) -> DataFrame:
    """(signal_id, pos, x) with x = ``value(t, pos)`` for t in seconds."""
    at = spark.range(int(seconds * rate)).withColumnRenamed("id", "pos")
    t = F.col("pos") / F.lit(float(rate))
    return at.select(F.lit(signal_id).alias("signal_id"), "pos", value(t, F.col("pos")).cast("double").alias("x"))


def sine(hz: float, level: float = 1.0):
    return lambda t, _: F.sin(t * (2 * math.pi * hz)) * level


def chord(parts: tuple[float, ...] = C_MAJOR, level: float = 1 / 3):
    return lambda t, _: sum((F.sin(t * (2 * math.pi * f)) for f in parts), F.lit(0.0)) * level


def harmonics(base: float, partials: dict[int, float]):
    """A tone with partials, scaled by their number (the base included)."""
    return lambda t, _: (F.sin(t * (2 * math.pi * base)) + sum((F.sin(t * (2 * math.pi * base * k)) * a for k, a in partials.items()), F.lit(0.0))) / (1 + len(partials))


def noise(position: Column, seed: int = 0) -> Column:
    """A draw from -1 to 1 that depends on the position and the seed alone."""
    return F.pmod(F.xxhash64(position, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1.0


def drums(bpm: float = 120.0, seed: int = 0):
    """A kick on each beat, a snare on every second one, a hat on half beats; each decays."""
    beat = 60.0 / bpm

    def value(t: Column, pos: Column) -> Column:
        phase, half = t % beat, t % (beat / 2)
        kick = F.when(phase < 0.1, F.sin(phase * (2 * math.pi * 60)) * F.exp(phase * -30.0) * 0.8).otherwise(0.0)
        off = (t + beat) % (2 * beat)
        snare = F.when(off < 0.05, noise(pos, seed) * F.exp(off * -40.0) * 0.4).otherwise(0.0)
        hat = F.when(half < 0.02, noise(pos, seed + 1) * F.exp(half * -100.0) * 0.2).otherwise(0.0)
        return kick + snare + hat

    return value

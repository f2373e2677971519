"""Short-time spectra and what is read from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, scalar
from . import layout

KEYS = layout.KEYS


def spectrum(frame: str | Column, kind: str = "magnitude", window: str = "hann", size: int | None = None) -> Column:
    """The first n/2+1 bins of a frame's Fourier transform: magnitude, power or phase, unnormalised.

    ``size`` pads frames with zeros or cuts them. Frames arrive in Arrow batches; those of equal
    length are transformed together. A null frame gives null.
    """

    def one(frames: np.ndarray) -> np.ndarray:
        n = size or frames.shape[1]
        windowed = frames * np.array(scalar.window_values(window, frames.shape[1]))
        out = np.fft.rfft(windowed, n, axis=1)
        return np.abs(out) if kind == "magnitude" else np.abs(out) ** 2 if kind == "power" else np.angle(out)

    @F.pandas_udf("array<double>")
    def transform(frames: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(frames), index=frames.index, dtype=object)
        lengths = frames.map(lambda f: -1 if f is None else len(f))
        for n in lengths.unique():
            if n > 0:
                at = np.flatnonzero(lengths.to_numpy() == n)
                out.iloc[at] = list(one(np.stack(frames.iloc[at].to_list()).astype(float)))
        return out

    return transform(scalar.col(frame))


def stft(frames: DataFrame, window: str = "hann", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, frame_idx, mag) of the frames of ``layout.frames_of``; no frames: no rows."""
    return frames.select(*keys, "frame_idx", spectrum("frame", "magnitude", window).alias("mag"))


def cells(spectra: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Long form: (keys, frame_idx, bin, mag)."""
    return spectra.select(*keys, "frame_idx", F.posexplode("mag").alias("bin", "mag"))


def frame_features(spectra: DataFrame, rate: float, size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, frame_idx, centroid, rolloff, dominant, power): per frame, without a shuffle.

    ``centroid`` is null for a silent frame; ``power`` is the L2 norm (the power curve).
    """
    hz = float(rate) / size
    return spectra.select(
        *keys, "frame_idx",
        (arrays.mean_index("mag") * hz).alias("centroid"),
        (arrays.rolloff_index("mag") * hz).alias("rolloff"),
        (arrays.argmax("mag") * hz).alias("dominant"),
        arrays.norm("mag").alias("power"),
    )


def flux(spectra: DataFrame, keys: tuple[str, ...] = KEYS, block: int = 1024) -> DataFrame:
    """(keys, frame_idx, flux_l1, flux_l2): rectified change since the frame before; the first frame has 0 and null."""
    pairs = layout.neighbours(spectra.select(*keys, "frame_idx", "mag"), {"before": ("mag", -1)}, keys, "frame_idx", block)
    return pairs.select(
        *keys, "frame_idx",
        F.when(F.col("before").isNull(), F.lit(0.0)).otherwise(arrays.rise(F.col("mag"), F.col("before"))).alias("flux_l1"),
        F.when(F.col("before").isNotNull(), arrays.rise(F.col("mag"), F.col("before"), 2)).alias("flux_l2"),
    )


def mel_points(filters: int, rate: float, size: int) -> list[int]:
    """FFT bins of the filters' corners: equal steps of the mel scale up to half the rate."""
    top = 2595.0 * math.log10(1.0 + rate / 2 / 700.0)
    hz = [700.0 * (10 ** (top * i / (filters + 1) / 2595.0) - 1.0) for i in range(filters + 2)]
    return [math.floor(size * f / rate + 0.5) for f in hz]


def mel_bank(spark: SparkSession, filters: int, rate: float, size: int) -> DataFrame:
    """(filter, bin, weight): triangular filters, the positive weights alone."""
    points = pd.DataFrame([(i, *mel_points(filters, rate, size)[i : i + 3]) for i in range(filters)], columns=["filter", "lo", "mid", "hi"])
    corners = spark.createDataFrame(points, "filter int, lo int, mid int, hi int")
    last = F.least(F.col("hi") - 1, F.lit(size // 2))
    out = corners.where(F.col("lo") <= last).withColumn("bin", F.explode(F.sequence("lo", last)))
    up, down = scalar.ratio(F.col("bin") - F.col("lo"), F.col("mid") - F.col("lo")), 1.0 - scalar.ratio(F.col("bin") - F.col("mid"), F.col("hi") - F.col("mid"))
    out = out.select("filter", "bin", F.when(F.col("bin") < F.col("mid"), up).otherwise(down).alias("weight"))
    return out.where("weight > 0")


def mel_energies(spectra: DataFrame, filters: int, rate: float, size: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, frame_idx, mel): the filters' sums of each frame, as an array.

    The bank depends on the parameters alone, so each filter is a sum of a few array elements of
    the row: no join, no shuffle.
    """
    points = mel_points(filters, rate, size)
    bands = []
    for lo, mid, hi in zip(points, points[1:], points[2:], strict=False):
        weights = [((b - lo) / (mid - lo) if b < mid else 1.0 - (b - mid) / (hi - mid)) for b in range(lo, min(hi, size // 2 + 1))]
        part = F.zip_with(F.slice("mag", lo + 1, max(1, len(weights))), F.array(*[F.lit(w) for w in weights or [0.0]]), lambda a, w: a * w)
        bands.append(arrays.total(part))
    return spectra.select(*keys, "frame_idx", F.array(*bands).alias("mel"))


def mfcc(mel: DataFrame, coefficients: int = 13, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, frame_idx, mfcc): the cosine transform of the filters' decibels."""
    db = F.transform("mel", lambda m: scalar.to_db(m))
    n = F.size("mel")
    wave = lambda k: F.transform(db, lambda v, i: v * F.cos(F.lit(math.pi * k) * (i + F.lit(0.5)) / n))
    return mel.select(*keys, "frame_idx", F.array(*[arrays.total(wave(k)) for k in range(coefficients)]).alias("mfcc"))


def dominant_bins(spectra: DataFrame, top: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, rank, bin, energy): the bins with the greatest sums over a signal, lower bins first in a tie."""
    sums = cells(spectra, keys).groupBy(*keys, "bin").agg(F.sum("mag").alias("energy"))
    order = Window.partitionBy(*keys).orderBy(F.desc("energy"), "bin")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*keys, "rank", "bin", "energy")

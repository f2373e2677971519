"""Pictures of signals: Spark reduces a signal to the canvas, a helper per picture writes the PNG."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, png, scalar
from . import layout

WIDTH, HEIGHT = 1920, 1080
WHITE, BLACK = (255, 255, 255), (0, 0, 0)


def waveform_points(samples: DataFrame, width: int = WIDTH) -> DataFrame:
    """(signal_id, n, top, at, x): every step-th sample, at most about four a pixel column; ``top`` is the axis' limit."""
    span = samples.groupBy("signal_id").agg(F.count("*").alias("n"), F.max(F.abs("x")).alias("peak"))
    step = F.greatest(F.floor(F.col("n") / (2 * width)), F.lit(1))
    top = F.when(F.col("peak") > 0, F.col("peak") * 1.1).otherwise(F.lit(1.0))
    return samples.join(span, "signal_id").where(F.col("pos") % step == 0).select("signal_id", "n", top.alias("top"), F.col("pos").alias("at"), "x")


def envelope(samples: DataFrame, width: int = WIDTH) -> DataFrame:
    """(signal_id, column, high, low, rms) of chunks of n / width samples; high is 0 at least, low 0 at most."""
    span = samples.groupBy("signal_id").agg(F.count("*").alias("n"))
    size = F.greatest(F.floor(F.col("n") / width), F.lit(1))
    dealt = samples.join(span, "signal_id").withColumn("column", F.floor(F.col("pos") / size))
    return dealt.groupBy("signal_id", "column").agg(
        F.greatest(F.max("x"), F.lit(0.0)).alias("high"), F.least(F.min("x"), F.lit(0.0)).alias("low"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")
    )


def spectrogram_pixels(spectra: DataFrame, width: int, height: int, colors: str = "viridis") -> DataFrame:
    """(signal_id, x, y, color): decibels between a signal's extremes, by the nearest frame and bin, low bins below.

    Only the frames that a pixel column shows are exploded, and the canvas bounds the rows of a signal.
    """
    db = F.transform("mag", lambda m: scalar.to_db(m))
    framed = spectra.select("signal_id", "frame_idx", db.alias("db"))
    span = framed.groupBy("signal_id").agg(F.count("*").alias("frames"), F.min(F.array_min("db")).alias("lo"), F.max(F.array_max("db")).alias("hi"))
    columns = span.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    columns = columns.withColumn("frame_idx", F.least(F.floor(F.col("x") * F.col("frames") / width), F.col("frames") - 1))
    shown = columns.join(framed, ["signal_id", "frame_idx"])
    bins = F.size("db")
    row = shown.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    at = bins - 1 - F.least(F.floor(F.col("y") * bins / height), bins - 1)
    value = scalar.clamp(F.coalesce(scalar.ratio(F.get("db", at.cast("int")) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)))
    return row.select("signal_id", "x", "y", scalar.colormap(colors, value).alias("color"))


def power_curve(spectra: DataFrame) -> DataFrame:
    """(signal_id, frame_idx, power): the L2 norm of each frame."""
    return spectra.select("signal_id", "frame_idx", arrays.norm("mag").alias("power"))


def draw_line(xs: np.ndarray, ys: np.ndarray, width: int, height: int, low: float, high: float, color: tuple[int, int, int], zero: bool = False) -> np.ndarray:
    """A white canvas with a curve through points of increasing x."""
    canvas = np.full((height, width, 3), 255, dtype=np.uint8)
    to_row = lambda v: np.clip(((high - v) / (high - low or 1.0) * (height - 1)).astype(int), 0, height - 1)
    if zero:
        canvas[int(to_row(np.array(0.0))), :] = BLACK
    if len(xs):
        at = np.linspace(xs[0], xs[-1], 4 * width) if len(xs) > 1 else xs
        rows, columns = to_row(np.interp(at, xs, ys)), np.linspace(0, width - 1, len(at)).astype(int)
        for c in np.unique(columns):
            span = rows[columns == c]
            canvas[span.min() : span.max() + 1, c] = color
    return canvas


def _image(points: DataFrame, x: str, y: str, low: str, high: str, size: tuple[int, int], color: tuple[int, int, int], zero: bool) -> DataFrame:
    """(signal_id, png): points are bounded by the canvas before they meet in a row."""
    rows = points.groupBy("signal_id").agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")))).alias("p"), F.min(low).alias("lo"), F.max(high).alias("hi"))

    @F.pandas_udf("binary")
    def draw(xs: pd.Series, ys: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([png.encode(draw_line(np.asarray(a), np.asarray(b), *size, u, v, color, zero)) for a, b, u, v in zip(xs, ys, lo, hi, strict=True)])

    return rows.select("signal_id", draw("p.x", "p.y", "lo", "hi").alias("png"))


def waveform_png(samples: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    points = waveform_points(samples, width).withColumn("bottom", -F.col("top"))
    return _image(points, "at", "x", "bottom", "top", (width, height), (0, 0, 255), True)


def power_png(spectra: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """The power curve, decimated to two points a pixel column."""
    curve = power_curve(spectra).withColumn("n", F.count("*").over(Window.partitionBy("signal_id")))
    curve = curve.where(F.col("frame_idx") % F.greatest(F.floor(F.col("n") / (2 * width)), F.lit(1)) == 0).withColumn("top", F.col("power") * 1.1)
    return _image(curve, "frame_idx", "power", "power", "top", (width, height), (255, 0, 0), False)


def spectrogram_png(spectra: DataFrame, width: int = WIDTH, height: int = HEIGHT, colors: str = "viridis") -> DataFrame:
    """(signal_id, png): pixel columns are put together before columns meet, so a task holds one picture."""
    pixels = spectrogram_pixels(spectra, width, height, colors)
    rgb = F.transform(F.sort_array(F.collect_list(F.struct("y", "color"))), lambda s: (s["color"]["r"] * 65536 + s["color"]["g"] * 256 + s["color"]["b"]))
    columns = pixels.groupBy("signal_id", "x").agg(rgb.alias("column"))
    rows = columns.groupBy("signal_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "column"))), lambda s: s["column"]).alias("columns"))

    @F.pandas_udf("binary")
    def draw(columns: pd.Series) -> pd.Series:
        def one(c) -> bytes:
            grid = np.stack([np.asarray(v, dtype=np.int64) for v in c], axis=1)
            return png.encode(np.stack([grid >> 16, grid >> 8 & 255, grid & 255], axis=2))

        return columns.map(one)

    return rows.select("signal_id", draw("columns").alias("png"))


def base64_of(images: DataFrame, name: str) -> DataFrame:
    return images.select("signal_id", F.base64("png").alias(name))



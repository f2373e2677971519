"""Pitch tracks and vibrato."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import stage
from . import layout

KEYS = layout.KEYS
#: A detector takes (samples of a frame, rate) and gives (frequency, confidence, clarity), 0 if there is none.
Detector = Callable[[np.ndarray, float], tuple[float, float, float]]
NONE = (0.0, 0.0, 0.0)


def differences(x: np.ndarray) -> np.ndarray:
    """Sum of (x[i] - x[i + lag])**2 for lags below half the frame, through one autocorrelation."""
    n, half = len(x), len(x) // 2
    spec = np.fft.rfft(x, 2 * n)
    corr = np.fft.irfft(spec * np.conj(spec), 2 * n)[:half]
    power = np.append(0.0, np.cumsum(x * x))
    lag = np.arange(half)
    out = np.maximum(power[n - lag] + power[n] - power[lag] - 2.0 * corr, 0.0)
    out[:1] = 0.0
    return out


def normalized(x: np.ndarray) -> np.ndarray:
    """Differences by the mean of those before them; 1 at lag 0 and while they are 0."""
    d = differences(x)
    run = np.cumsum(d)
    return np.where(run > 0, d * np.arange(len(d)) / np.where(run > 0, run, 1.0), 1.0)


def vertex(y: np.ndarray, at: int, least: float) -> float:
    """The parabola's lowest place through three neighbours."""
    if at == 0 or at >= len(y) - 1:
        return float(at)
    a, b = (y[at + 1] - 2.0 * y[at] + y[at - 1]) / 2.0, (y[at + 1] - y[at - 1]) / 2.0
    return float(at) if abs(a) < 1.1920929e-07 else max(at - b / (2.0 * a), least)


def yin(threshold: float = 0.1, low: float = 50.0, high: float = 2000.0) -> Detector:
    """The first dip below the threshold, walked down to its lowest place."""
    threshold = min(max(threshold, 0.05), 0.5)

    def detect(x: np.ndarray, rate: float) -> tuple[float, float, float]:
        y = normalized(x)
        under = np.flatnonzero(y[2:] < threshold)
        if not len(under):
            return NONE
        at = int(under[0]) + 2
        rises = np.flatnonzero(np.diff(y[at:]) >= 0)
        at = at + int(rises[0]) if len(rises) else len(y) - 1
        if not int(rate / high) <= at <= int(rate / low):
            return NONE
        clear = min(max(1.0 - y[at], 0.0), 1.0)
        return rate / vertex(y, at, 0.0), clear * max(1.0 - y[at], 0.0), clear

    return detect


def pyin(candidates: int = 10, low: float = 50.0, high: float = 2000.0, shape: tuple[float, float] = (10.0, 1.0)) -> Detector:
    """The dips that a hundred thresholds find first, weighted and gathered in bins of 5 Hz."""
    thresholds = 0.01 + np.arange(100) / 100 * 0.49
    candidates = min(max(candidates, 3), 20)

    def detect(x: np.ndarray, rate: float) -> tuple[float, float, float]:
        y = normalized(x)
        inner = np.arange(2, len(y) - 1)
        dips = inner[(y[inner] < y[inner - 1]) & (y[inner] < y[inner + 1]) & (inner >= int(rate / high)) & (inner <= int(rate / low))]
        bins: dict[int, float] = {}
        for t in thresholds if len(dips) else ():
            below = dips[y[dips] < t]
            if len(below):
                at = int(below[0])
                sure = min(max(1.0 - y[at], 0.0), 1.0)
                weight = sure ** (shape[0] - 1) * (1.0 - sure) ** (shape[1] - 1) * np.exp(-10.0 * abs(t - 0.15))
                b = int(np.floor(rate / vertex(y, at, 1.0) / 5.0 + 0.5))
                bins[b] = bins.get(b, 0.0) + weight
        best = sorted(bins.items(), key=lambda kv: (-kv[1], kv[0]))[:candidates]
        if not best:
            return NONE
        total = sum(w for _, w in best)
        ratio = best[0][1] / max(best[1][1], 1.1920929e-07) if len(best) > 1 else np.inf
        return best[0][0] * 5.0, best[0][1] / total if total > 0 else 0.0, (ratio - 1) / (ratio + 1) if len(best) > 1 else 1.0

    return detect


def detect(frame: str | Column, rate: float, detector: Detector | None = None) -> Column:
    """struct<frequency, confidence, clarity> of each frame by a detector (YIN if none is given)."""
    find = detector or yin()

    @F.pandas_udf("frequency double, confidence double, clarity double")
    def run(frames: pd.Series) -> pd.DataFrame:
        found = [find(np.asarray(f, dtype=float), rate) if f is not None and len(f) else NONE for f in frames]
        return pd.DataFrame(found, columns=["frequency", "confidence", "clarity"])

    return run(scalar.col(frame))


def track(samples: DataFrame, rate: float, detector: Detector | None = None, window: int = 2048, hop: int = 512, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, frame_idx, time, frequency, confidence, clarity, amplitude, midi_note, note_name, cents_offset).

    The frame that ends with the signal is left out; an unsure frequency (confidence 0.5 or less) is null.
    """
    length = samples.groupBy(*keys).agg(F.max("pos").alias("last"))
    frames = layout.frames_of(samples, window, hop, keys).join(length, list(keys))
    frames = frames.where(F.col("frame_idx") * hop + window <= F.col("last"))
    found = frames.select(*keys, "frame_idx", "frame", detect("frame", rate, detector).alias("p"))
    f = F.when(F.col("p.confidence") > 0.5, F.col("p.frequency"))
    level = F.aggregate("frame", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("frame")
    out = found.select(*keys, "frame_idx", (F.col("frame_idx") * F.lit(hop / float(rate))).alias("time"), f.alias("frequency"), F.col("p.confidence").alias("confidence"), F.col("p.clarity").alias("clarity"), level.alias("amplitude"))
    note = F.when(F.col("frequency").isNotNull(), scalar.midi_note("frequency"))
    return out.withColumns({"midi_note": note, "note_name": scalar.note_name(note), "cents_offset": scalar.cents_offset("frequency")})


def summary(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, mean_pitch, min_pitch, max_pitch, pitch_stability, dominant_pitch) of the voiced frames.

    Steps are between neighbouring voiced frames, whatever lies between them. Of equally frequent
    bins of 10 Hz the lowest dominates.
    """
    voiced = frames.where("frequency is not null")
    order = Window.partitionBy(*keys).orderBy("frame_idx")
    step = F.abs(F.col("frequency") - F.lag("frequency").over(order))
    stats = voiced.withColumn("step", step).groupBy(*keys).agg(F.avg("frequency").alias("mean_pitch"), F.min("frequency").alias("min_pitch"), F.max("frequency").alias("max_pitch"), F.avg("step").alias("step"))
    votes = voiced.groupBy(*keys, scalar.nearest(F.col("frequency") / 10.0).alias("bin")).agg(F.count("*").alias("n"))
    top = votes.groupBy(*keys).agg((-F.max(F.struct("n", (-F.col("bin")).alias("b")))["b"] * 10.0).alias("dominant_pitch"))
    steady = F.when(F.col("step").isNull(), F.lit(0.0)).otherwise(F.lit(1.0) - F.least(F.col("step") / F.col("mean_pitch"), F.lit(1.0)))
    return stats.join(top, list(keys)).select(*keys, "mean_pitch", "min_pitch", "max_pitch", steady.alias("pitch_stability"), "dominant_pitch")


#: Voiced frames that a task takes of a track at a time.
TRACK_BLOCK = 16_384
#: Frames and slowest, fastest modulation (Hz) that count as vibrato. Fixed values.
FEWEST, SLOW, FAST = 20, 3.0, 12.0


def _partial_transform(flat: np.ndarray, start: int, n: int, first: int, last: int) -> np.ndarray:
    """Bins ``first`` to ``last`` of a block's part of a transform of ``n`` values, in the phase of its place.

    A block shorter than the bins are many goes through convolution with a chirp; phases are taken
    from whole numbers modulo ``2 n``, so that they stay exact in long tracks.
    """
    k, j = np.arange(first, last + 1), np.arange(len(flat))
    if len(k) * len(j) <= 1 << 20:
        return np.exp(-2j * np.pi * (np.outer(k, start + j) % n) / n) @ flat
    phase = lambda m: np.exp(-1j * np.pi * (m % (2 * n)) / n)
    # k j = (k^2 + j^2 - (k - j)^2) / 2
    span = np.arange(-len(j) + 1, len(k))
    size = 1 << int(len(span) + len(j) - 1).bit_length()
    left = np.fft.fft(flat * phase(j * j + 2 * first * j), size)
    found = np.fft.ifft(left * np.fft.fft(np.conj(phase(span * span)), size))[len(j) - 1 : len(j) - 1 + len(k)]
    turned = np.arange(len(k))
    return found * phase(turned * turned) * np.exp(-2j * np.pi * ((k * (start % n)) % n) / n)


def _track(frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, i, n, cents, flat) of the voiced frames: their place among them, cents from the mean, less the line through them."""
    voiced = frames.where("frequency > 0").select(*keys, "frame_idx", "frequency")
    placed = layout.running_count(voiced, F.lit(True), "i", keys, "frame_idx").withColumn("i", F.col("i") - 1)
    means = voiced.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("frequency").alias("mean")).where(F.col("n") >= FEWEST)
    cents = placed.join(means, list(keys)).withColumn("cents", F.lit(1200.0) * F.log2(F.col("frequency") / F.col("mean")))
    line = cents.groupBy(*keys).agg(F.regr_slope("cents", "i").alias("slope"), F.regr_intercept("cents", "i").alias("base"))
    return cents.join(line, list(keys)).select(*keys, "i", "n", "cents", (F.col("cents") - F.col("slope") * F.col("i") - F.col("base")).alias("flat"))


def _modulation(track: DataFrame, step: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, cycles, strength): the strongest bin of the transform between the slowest and the fastest modulation, of equal ones the last.

    Blocks of a track give their part of each bin, in the phase of their place; parts are added up.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("i")
        n, unit = int(rows["n"].iloc[0]), 1.0 / (step * int(rows["n"].iloc[0]))
        first, last = max(int(SLOW / unit), 1), min(int(FAST / unit), n // 2)
        if last < first:
            return pd.DataFrame({**{k: [] for k in keys}, "cycles": [], "re": [], "im": []})
        part = _partial_transform(rows["flat"].to_numpy(), int(rows["i"].iloc[0]), n, first, last)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "cycles": np.arange(first, last + 1), "re": part.real, "im": part.imag})

    fields = ", ".join(f"{k} {track.schema[k].dataType.simpleString()}" for k in keys)
    parts = track.withColumn("block", F.floor(F.col("i") / TRACK_BLOCK)).groupBy(*keys, "block").applyInPandas(run, f"{fields}, cycles long, re double, im double")
    bins = parts.groupBy(*keys, "cycles").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    n = track.groupBy(*keys).agg(F.max("n").alias("n"), ((F.max("flat") - F.min("flat")) / 2).alias("depth_cents"))
    strength = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")
    top = bins.join(n, list(keys)).groupBy(*keys, "n", "depth_cents").agg(F.max(F.struct(strength.alias("strength"), "cycles")).alias("top"))
    return top.select(*keys, "n", "depth_cents", "top.*").where("strength > 0.01D")


def _rounded(numerator: Column, denominator: Column) -> Column:
    """The nearest whole number to a ratio of whole numbers, halves upwards, without leaving them."""
    return F.call_function("div", 2 * numerator + denominator, 2 * denominator)


def _regularity(track: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, regularity): mean correlation of the first period with each later whole one.

    A period has a few frames whatever the track has, so the first one is sent to all rows; a later
    one's correlation comes from five sums.
    """
    periods = found.select(*keys, "n", _rounded(F.col("n"), F.col("cycles")).alias("period")).where("period < n")
    first = track.drop("n").join(periods, list(keys)).where("i < period")
    first = first.groupBy(*keys, "n", "period").agg(layout.ordered("first", "i", F.col("flat")))
    rows = track.drop("n").join(first, list(keys)).where(F.col("i") < F.floor(F.col("n") / F.col("period")) * F.col("period"))
    x, x0 = F.col("flat"), F.get("first", (F.col("i") % F.col("period")).cast("int"))
    m, m0 = F.avg("flat"), F.avg(x0)
    turns = rows.groupBy(*keys, "period", F.floor(F.col("i") / F.col("period")).alias("turn")).agg(
        m.alias("m"), m0.alias("m0"), F.sum(x * x0).alias("xy"), F.sum(x * x).alias("xx"), F.sum(x0 * x0).alias("yy")
    )
    p, c = F.col("period"), F.col
    dot, size = c("xy") - p * c("m") * c("m0"), F.sqrt(F.greatest(c("xx") - p * c("m") * c("m"), F.lit(0.0))) * F.sqrt(F.greatest(c("yy") - p * c("m0") * c("m0"), F.lit(0.0)))
    alike = F.when(size > 0, dot / size).otherwise(F.lit(0.0))
    return turns.where("turn > 0").groupBy(*keys).agg(F.avg(alike).alias("regularity"))


def _onset(track: DataFrame, found: DataFrame, step: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, onset_time): where the variance of the two periods ahead exceeds that of the two behind by most (over 10), and twofold.

    Blocks see two of the slowest periods beyond their edges.
    """
    reach = int(np.ceil(2.0 / (SLOW * step))) + 2
    rows = track.drop("n").join(found.select(*keys, "n", _rounded(2 * F.col("n"), F.col("cycles")).alias("window")), list(keys))
    rows = layout.with_halo(rows, reach, reach, "i", TRACK_BLOCK).select(*keys, "block", "i", "n", "window", "cents")
    names = [*keys, "change", "at"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("i")
        n, window, block = (int(rows[c].iloc[0]) for c in ("n", "window", "block"))
        start, cents = int(rows["i"].iloc[0]), rows["cents"].to_numpy()
        at = np.arange(max(window, block * TRACK_BLOCK), min(n - window, (block + 1) * TRACK_BLOCK))
        if window < 1 or not len(at):
            return pd.DataFrame(columns=names)
        var = np.lib.stride_tricks.sliding_window_view(cents, window).var(axis=1)
        behind, ahead = var[at - window - start], var[at - start]
        change = np.where(ahead > 2 * behind, np.abs(ahead - behind), 0.0)
        best = int(np.argmax(change))
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "change": [change[best]], "at": [at[best]]})

    fields = ", ".join(f"{k} {track.schema[k].dataType.simpleString()}" for k in keys)
    best = rows.groupBy(*keys, "block").applyInPandas(run, f"{fields}, change double, at long")
    best = best.groupBy(*keys).agg(F.max(F.struct("change", (-F.col("at")).alias("before"))).alias("b")).where("b.change > 10.0D")
    return best.select(*keys, (-F.col("b.before") * F.lit(step)).alias("onset_time"))


def vibrato(frames: DataFrame, rate: float, hop: int = 512, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, vibrato): struct<rate, depth_cents, regularity, presence, onset_time>, null if there is none.

    A track is never in one task: voiced frames are numbered by a scan in two levels, the line
    through them comes from moments, the transform from blocks' parts, correlations from sums by
    period, and the onset from blocks that overlap. Fewer than 20 voiced frames have no vibrato.
    """
    step = hop / rate
    track = stage.keep(_track(frames, keys))
    found = stage.keep(_modulation(track, step, keys))
    out = found.join(_regularity(track, found, keys), list(keys), "left").join(_onset(track, found, step, keys), list(keys), "left")
    regular = F.coalesce("regularity", F.lit(0.0))
    present = F.least(F.col("depth_cents") / 100.0, F.lit(1.0)) * 0.4 + F.least(F.col("strength") * 10.0, F.lit(1.0)) * 0.3 + scalar.clamp(regular) * 0.3
    parts = F.struct(
        (F.col("cycles") / (F.lit(step) * F.col("n"))).alias("rate"), "depth_cents", regular.alias("regularity"), F.least(present, F.lit(1.0)).alias("presence"), "onset_time"
    )
    voiced = frames.where("frequency is not null").select(*keys).distinct()
    return voiced.join(out.select(*keys, parts.alias("vibrato")), list(keys), "left")

"""Onsets, tempo and beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import layout

KEYS = layout.KEYS
#: Width of an interval bin in seconds, and the bins of the tempo range (200 to 60 beats a minute).
BIN, SLOWEST, FASTEST = 0.01, 100, 31


def peak_pick(
    values: DataFrame, value: str = "x", pos: str = "pos", threshold: float = 0.3, near: int = 3, wide: int = 30, keys: tuple[str, ...] = KEYS, block: int = layout.BLOCK
) -> DataFrame:
    """Rows whose value no neighbour within ``near`` exceeds and that lie more than ``threshold`` above
    the mean of the ``wide`` values before and after.

    Ties stay. The first value counts itself among those before, the last among those after.
    """
    halo = layout.with_halo(values, wide, wide, pos, block)
    order = Window.partitionBy(*keys, "block").orderBy(pos)
    v = F.col(value)
    sides = {"back": order.rowsBetween(-wide, -1), "ahead": order.rowsBetween(1, wide)}
    out = halo.withColumn("most", F.max(v).over(order.rowsBetween(-near, near)))
    for side, frame in sides.items():
        out = out.withColumns({f"{side}_sum": F.coalesce(F.sum(v).over(frame), F.lit(0.0)), f"{side}_n": F.count(v).over(frame)})
    own = F.when(F.col("back_n") == 0, 1).otherwise(0) + F.when(F.col("ahead_n") == 0, 1).otherwise(0)
    mean = (F.col("back_sum") + F.col("ahead_sum") + own * v) / (F.col("back_n") + F.col("ahead_n") + own)
    return out.where("own").where((v >= F.col("most")) & (v > mean + F.lit(threshold))).select(values.columns)


def onsets(flux: DataFrame, value: str, hop: int, rate: float, first: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, idx, t): the peaks of an onset function; ``first`` is the frame that counts as time 0."""
    peaks = peak_pick(flux.where(F.col(value).isNotNull()), value, "frame_idx", keys=keys)
    return peaks.select(*keys, F.col("frame_idx").alias("idx"), ((F.col("frame_idx") - first) * (hop / float(rate))).alias("t"))


def intervals(times: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t, gap): each onset's distance from the one before."""
    order = Window.partitionBy(*keys).orderBy("t")
    return times.select(*keys, "t", (F.col("t") - F.lag("t").over(order)).alias("gap")).where("gap is not null")


def tempo(times: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, interval_bin, votes, tempo): the most frequent interval of the tempo range.

    Of equally frequent ones the shortest wins. Signals without an interval in range have no row.
    """
    bins = intervals(times, keys).withColumn("interval_bin", scalar.nearest(F.col("gap") / F.lit(BIN)))
    votes = bins.where(F.col("interval_bin").between(FASTEST, SLOWEST)).groupBy(*keys, "interval_bin").agg(F.count("*").alias("votes"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("interval_bin")).alias("b"))).alias("top"))
    return best.select(*keys, (-F.col("top.b")).alias("interval_bin"), F.col("top.votes").alias("votes"), (F.lit(60.0) / (-F.col("top.b") * F.lit(BIN))).alias("tempo"))


def beats(times: DataFrame, tempos: DataFrame, candidates: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, phase, period, score, last, n_beats, beats): the grid through one of the first onsets that
    most onsets lie near.

    Grid points are a series; onsets meet them by an equality on the period that holds them, not by
    trying all pairs: a point that an onset is nearer than a fifth of the period to is the nearest one.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    timed = times.join(tempos.select(*keys, (F.lit(60.0) / F.col("tempo")).alias("period")), list(keys))
    span = timed.groupBy(*keys).agg(F.max("t").alias("last"))
    heads = times.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= candidates).select(*keys, "turn", F.col("t").alias("phase"))
    scored = timed.join(span, list(keys)).join(heads, list(keys))
    k = F.round((F.col("t") - F.col("phase")) / F.col("period"))
    point = F.col("phase") + k * F.col("period")
    distance = F.abs(F.col("t") - point)
    hit = (k >= 0) & (point < F.col("last")) & (distance < F.col("period") * 0.2)
    score = F.sum(F.when(hit, 1.0 / (1.0 + distance)).otherwise(F.lit(0.0)))
    scored = scored.groupBy(*keys, "turn", "phase", "period", "last").agg(score.alias("score"))
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("turn")).alias("o"), "phase", "period", "last")).alias("b"))
    out = best.select(*keys, "b.phase", "b.period", F.col("b.s").alias("score"), "b.last")
    n = F.floor((F.col("last") - F.col("phase")) / F.col("period") + F.lit(1e-9)) + 1
    grid = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_beats") - 1), lambda i: F.col("phase") + i * F.col("period"))
    return out.withColumn("n_beats", n.cast("long")).withColumn("beats", grid)


def stability(beat_rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, tempo_stability): 1 / (1 + deviation of the beat intervals), 0 for fewer than three beats."""
    gaps = F.zip_with(F.slice("beats", 2, F.greatest(F.size("beats") - 1, F.lit(1))), F.slice("beats", 1, F.greatest(F.size("beats") - 1, F.lit(1))), lambda a, b: a - b)
    mean = F.aggregate("gaps", F.lit(0.0), lambda s, x: s + x) / F.size("gaps")
    var = F.aggregate(F.transform("gaps", lambda g: (g - F.col("mean")) * (g - F.col("mean"))), F.lit(0.0), lambda s, x: s + x) / F.size("gaps")
    many = beat_rows.where(F.size("beats") > 2).withColumn("gaps", gaps).withColumn("mean", mean)
    some = many.select(*keys, (F.lit(1.0) / (F.lit(1.0) + F.sqrt(var))).alias("s"))
    return beat_rows.select(*keys).join(some, list(keys), "left").select(*keys, F.coalesce("s", F.lit(0.0)).alias("tempo_stability"))

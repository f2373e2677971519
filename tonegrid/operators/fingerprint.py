"""Fingerprints: band hashes, landmarks, compact words, perceptual hash, sub-fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, scalar
from . import layout, spectral

KEYS = layout.KEYS
PEAK = 0.1
MOST_LANDMARKS = 1000


def spectral_hashes(spectra: DataFrame, rate: float, hop: int, bands: int = 32) -> DataFrame:
    """(signal_id, frame_idx, time, hash, frequency_bins, energy): the strongest bin of each band, folded
    into 32 bits. Row by row, no shuffle. Spectra with fewer bins than bands have hash 0."""
    width = F.floor(F.size("mag") / bands).cast("int")
    peaks = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: arrays.argmax(F.slice("mag", b * F.col("w") + 1, F.col("w"))))
    framed = spectra.withColumn("w", width).withColumn("peaks", F.when(F.col("w") > 0, peaks).otherwise(F.array().cast("array<int>")))
    words = F.transform("peaks", lambda p, b: F.shiftleft(b.cast("long"), 16).bitwiseOR(p.cast("long")))
    folded = F.aggregate(words, F.lit(0).cast("long"), lambda h, v: scalar.hash_step(h, v))
    return framed.select(
        "signal_id", "frame_idx", (F.col("frame_idx") * F.lit(hop / float(rate))).alias("time"), folded.alias("hash"),
        F.transform("peaks", lambda p, b: b * F.col("w") + p).alias("frequency_bins"), F.coalesce(arrays.mean("mag"), F.lit(0.0)).alias("energy"),
    )


def landmarks(spectra: DataFrame, rate: float, size: int, hop: int, peak: float = PEAK, most: int = MOST_LANDMARKS, block: int = 512) -> DataFrame:
    """(signal_id, landmark, time, frequency, magnitude, landmark_type): the first ``most`` of a signal.

    A spectral peak exceeds ``peak`` and its four neighbours; an onset is an inner frame whose rise is
    more than 0.5. Frequencies are bin * rate / (2 * size), half the bins' own. At one time peaks come
    before onsets, low bins first.
    """
    around = layout.neighbours(spectra.select("signal_id", "frame_idx", "mag"), {"a": ("mag", -1), "b": ("mag", 1)}, pos="frame_idx", block=block)
    inner = around.where("a is not null and b is not null")
    n = F.size("mag")

    def stands_out(i):
        m = F.get("mag", i)
        return (m > peak) & (m > F.get("mag", i - 1)) & (m > F.get("mag", i + 1)) & (m > F.get("a", i)) & (m > F.get("b", i))

    bins = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), stands_out)
    peaks = F.transform(F.when(n > 2, bins).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(0).alias("o"), i.alias("bin"), F.get("mag", i).alias("magnitude"), F.lit("SpectralPeak").alias("landmark_type")))
    rise = arrays.rise(F.col("mag"), F.col("a"))
    onset = F.when(rise > 0.5, F.array(F.struct(F.lit(1).alias("o"), F.lit(0).alias("bin"), rise.alias("magnitude"), F.lit("OnsetEvent").alias("landmark_type")))).otherwise(F.filter(peaks, lambda _: F.lit(False)))
    found = inner.select("signal_id", "frame_idx", F.explode(F.concat(peaks, onset)).alias("l"))
    order = Window.partitionBy("signal_id").orderBy("frame_idx", F.col("l.o"), F.col("l.bin"))
    kept = found.withColumn("landmark", F.row_number().over(order)).where(F.col("landmark") <= most)
    return kept.select(
        "signal_id", "landmark", (F.col("frame_idx") * F.lit(hop / float(rate))).alias("time"), (F.col("l.bin") * F.lit(float(rate) / (2 * size))).alias("frequency"),
        F.col("l.magnitude").alias("magnitude"), F.col("l.landmark_type").alias("landmark_type"),
    )


def compact(hashes: DataFrame, marks: DataFrame) -> DataFrame:
    """(signal_id, part, word, value): eight low hash bytes a word (part 0), then four landmark frequencies
    in tens a word (part 1); words are 64-bit patterns."""
    byte = F.call_function("shiftleft", F.col("hash").bitwiseAND(F.lit(0xFF)), (F.col("frame_idx") % 8 * 8).cast("int"))
    low = hashes.select("signal_id", F.lit(0).alias("part"), F.floor(F.col("frame_idx") / 8).alias("word"), byte.alias("v"))
    tens = scalar.saturating_long(F.col("frequency") / 10.0, 16)
    place = F.col("landmark") - 1
    high = marks.select("signal_id", F.lit(1).alias("part"), F.floor(place / 4).alias("word"), F.call_function("shiftleft", tens, (place % 4 * 16).cast("int")).alias("v"))
    return low.unionByName(high).groupBy("signal_id", "part", "word").agg(F.bit_or("v").alias("value"))


def bin_sums(spectra: DataFrame) -> DataFrame:
    """(signal_id, bin, energy): magnitudes summed over time, combined on the map side."""
    return spectral.cells(spectra).groupBy("signal_id", "bin").agg(F.sum("mag").alias("energy"))


def perceptual_hash(crossed: DataFrame, spectra: DataFrame) -> DataFrame:
    """(signal_id, perceptual_hash): power, centroid, sign changes and rolloff of a signal in 64 bits."""
    base = crossed.groupBy("signal_id").agg(F.avg(F.col("x") * F.col("x")).alias("power"), F.sum(F.when(F.col("pos").between(1, 9999), F.col("crossed")).otherwise(0)).alias("z"))
    order = Window.partitionBy("signal_id").orderBy("bin")
    sums = bin_sums(spectra).withColumns({"upto": F.sum("energy").over(order), "all": F.sum("energy").over(Window.partitionBy("signal_id"))})
    shape = sums.groupBy("signal_id").agg(
        scalar.ratio(F.sum(F.col("bin") * F.col("energy")), F.sum("energy")).alias("centroid"),
        F.min(F.when((F.col("all") > 0) & (F.col("upto") >= F.col("all") * 0.85), F.col("bin"))).alias("rolloff"),
    )
    rows = base.join(shape, "signal_id", "left")
    centroid = F.shiftleft(scalar.saturating_long(F.col("centroid") * 100.0, 47), 16)
    rolloff = F.shiftleft(F.coalesce(F.col("rolloff"), F.lit(0)).cast("long").bitwiseAND(F.lit(0xFFFF)), 48)
    value = scalar.saturating_long(F.col("power") * 1000.0, 62).bitwiseXOR(centroid).bitwiseXOR(F.shiftleft(F.col("z").cast("long"), 32)).bitwiseXOR(rolloff)
    return rows.select("signal_id", value.alias("perceptual_hash"))


def sub_fingerprints(crossed: DataFrame, rate: float, seconds: float = 5.0, chunk: int = 1024) -> DataFrame:
    """(signal_id, sub, start_time, duration, hash, energy_profile) of whole windows at half overlap."""
    size = max(1, int(seconds * rate))
    hop = max(1, size // 2)
    keys = ("signal_id", "sub")
    dealt = layout.assign(crossed, size, hop, "sub")
    parts = dealt.groupBy(*keys, F.floor(F.col("off") / chunk).alias("chunk")).agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("sq"), F.sum(F.when(F.col("off") > 0, F.col("crossed")).otherwise(0)).alias("z")
    )
    parts = parts.withColumn("level", F.sqrt(F.col("sq") / F.col("n")))
    out = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("z").alias("z"), layout.ordered("energy_profile", "chunk", F.col("level"))).where(F.col("n") == size)
    value = scalar.saturating_long(F.col("sq") / F.col("n") * 10000.0, 62).bitwiseXOR(F.shiftleft(F.col("z").cast("long"), 32))
    return out.select(*keys, (F.col("sub") * hop / F.lit(float(rate))).alias("start_time"), F.lit(float(seconds)).alias("duration"), value.alias("hash"), "energy_profile")


def metadata(samples: DataFrame, spectra: DataFrame, rate: float, size: int) -> DataFrame:
    """(signal_id, duration, avg_energy, dominant_frequencies): mean magnitude and the five strongest bins, at half their Hz."""
    base = samples.groupBy("signal_id").agg((F.count("*") / F.lit(float(rate))).alias("duration"), F.avg(F.abs("x")).alias("avg_energy"))
    top = spectral.dominant_bins(spectra, 5).groupBy("signal_id").agg(layout.ordered("dominant_frequencies", "rank", F.col("bin") * F.lit(float(rate) / (2 * size))))
    return base.join(top, "signal_id", "left")

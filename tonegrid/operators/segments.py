"""Segments of a signal, and the structure they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import arrays, scalar
from . import classify, layout, quality, spectral

SEG = ("signal_id", "segment")
#: Segments of a block: what looks at neighbours orders a block at a time.
BLOCK = 4_096


def by_segment() -> WindowSpec:
    return Window.partitionBy("signal_id").orderBy("segment")


def segment_samples(crossed: DataFrame, rate: float, seconds: float = 1.0, overlap: float = 0.5, shortest: float = 0.25) -> DataFrame:
    """(signal_id, segment, off, x, crossed): samples dealt to overlapping segments.

    A signal shorter than a segment is one segment. The part after the last whole segment is one
    more, if it is longer than ``shortest`` seconds.
    """
    size = max(1, int(max(seconds, shortest) * rate))
    hop = max(1, int((1.0 - min(max(overlap, 0.0), 0.9)) * size))
    dealt = layout.assign(crossed, size, hop, "segment")
    sizes = dealt.groupBy(*SEG).agg(F.count("*").alias("n"))
    sizes = layout.neighbours(sizes, {"n_before": (F.col("n"), -1)}, pos="segment", block=BLOCK)
    before = F.coalesce("n_before", F.lit(size))
    tail = (F.col("n") < size) & (before == size) & ((F.col("segment") == 0) | (F.col("n") > int(shortest * rate)))
    kept = sizes.withColumn("keep", (F.col("n") == size) | tail).where("keep").select(*SEG)
    return dealt.join(kept, list(SEG))


def segment_features(dealt: DataFrame, rate: float, size: int = 2048, hop: int = 512, overlap_hop: int | None = None) -> DataFrame:
    """(signal_id, segment, start_time, duration, energy, spectral_centroid, zcr, dynamic_range).

    ``overlap_hop`` is the number of samples between segment starts (half a second if not given).
    """
    step = overlap_hop or max(1, int(0.5 * int(rate)))
    base = dealt.groupBy(*SEG).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"),
        F.sum(F.when(F.col("off") > 0, F.col("crossed")).otherwise(0)).alias("crossings"),
    )
    ends = layout.index_percentiles(quality.chunk_rms(dealt, 0.05, rate, SEG, "off"), "rms", {"low": 5, "high": 95}, SEG, bounded=True)
    ends = ends.select(*SEG, F.when(F.col("n") > 1, F.lit(20.0) * F.log10(F.col("high") / F.col("low"))).otherwise(F.lit(0.0)).alias("dynamic_range"))
    spectra = spectral.stft(layout.frames_of(dealt, size, hop, SEG, "off"), keys=SEG)
    bright = spectra.select(*SEG, arrays.weighted_index("mag").alias("w"), arrays.total("mag").alias("m"))
    bright = bright.groupBy(*SEG).agg((scalar.ratio(F.sum("w"), F.sum("m")) * F.lit(float(rate) / size)).alias("spectral_centroid"))
    out = base.join(ends, list(SEG), "left").join(bright, list(SEG), "left")
    zcr = F.when(F.col("n") > 1, F.col("crossings") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return out.select(
        *SEG, (F.col("segment") * step / F.lit(float(rate))).alias("start_time"), (F.col("n") / F.lit(float(rate))).alias("duration"), "energy",
        F.coalesce("spectral_centroid", F.lit(0.0)).alias("spectral_centroid"), zcr.alias("zcr"), F.coalesce("dynamic_range", F.lit(0.0)).alias("dynamic_range"),
    )


def with_labels(features: DataFrame) -> DataFrame:
    """Adds ``label`` and ``label_confidence`` to segments that have a content_type."""
    e, c, d, kind = F.col("energy"), F.col("spectral_centroid"), F.col("dynamic_range"), F.col("content_type")
    rules = (
        (kind == "Silence", "Silence", 0.95),
        (kind == "Speech", "Speech", 0.8),
        ((kind == "Mixed") & (e > 0.6), "Music", 0.5),
        (kind == "Mixed", "Transition", 0.6),
        (e < 0.1, "Break", 0.7),
        ((e > 0.7) & (c > 2000), "Drop", 0.6),
        ((d > 20) & (e > 0.5), "Chorus", 0.5),
        ((c < 1000) & (e < 0.3), "Ambient", 0.6),
    )
    label, sure = F.lit("Verse"), F.lit(0.4)
    for test, name, confidence in reversed(rules):
        label, sure = F.when(test, F.lit(name)).otherwise(label), F.when(test, F.lit(confidence)).otherwise(sure)
    return features.withColumns({"label": label, "label_confidence": sure})


def segments(crossed: DataFrame, rate: float, size: int = 2048, hop: int = 512) -> DataFrame:
    """All segments of all signals, with features, content class and label."""
    dealt = segment_samples(crossed, rate)
    kinds = classify.scores(classify.features(dealt, rate, size, hop, SEG, "off")).select(*SEG, "content_type", "confidence")
    out = segment_features(dealt, rate, size, hop).join(kinds, list(SEG), "left")
    # a segment too short for a frame has no features to be told apart by
    out = out.withColumn("content_type", F.coalesce("content_type", F.lit("Silence")))
    return with_labels(out)


def _previous(rows: DataFrame, *columns: str) -> DataFrame:
    return layout.neighbours(rows, {f"{c}_before": (F.col(c), -1) for c in columns}, pos="segment", block=BLOCK)


def sections(rows: DataFrame) -> DataFrame:
    """(signal_id, section, section_type, start_time, end_time, n_segments, avg_energy, ...): runs of two
    or more segments with one label and without a marked change.

    Runs are numbered by a scan in two levels and put together with combination on the map side, so
    a signal that is one long run is not one task's. Sections alone are ranked by signal.
    """
    pairs = _previous(rows, "energy", "spectral_centroid", "content_type", "label")
    c = F.col
    marked = (c("label") != c("label_before")) | (F.abs(c("energy") - c("energy_before")) > 0.3)
    marked = marked | (F.abs(c("spectral_centroid") - c("spectral_centroid_before")) > 1000) | (c("content_type") != c("content_type_before"))
    runs = layout.running_count(pairs, marked, "run", pos="segment", block=BLOCK)
    out = runs.groupBy("signal_id", "run").agg(
        F.min("label").alias("label"), F.min("start_time").alias("start_time"), F.max(F.struct("segment", (c("start_time") + c("duration")).alias("t")))["t"].alias("end_time"),
        F.min("segment").alias("first_segment"), F.count("*").alias("n_segments"), F.avg("energy").alias("avg_energy"),
        F.avg("spectral_centroid").alias("avg_brightness"), F.avg("dynamic_range").alias("dynamic_variation"),
    ).where("n_segments > 1")
    kind = F.when(c("label").isin("Intro", "Verse", "Chorus", "Bridge", "Outro", "Break"), c("label")).otherwise(F.lit("Undefined"))
    number = F.row_number().over(Window.partitionBy("signal_id").orderBy("run"))
    constants = {"avg_roughness": 0.5, "rhythmic_density": 0.5, "harmonic_stability": 0.7, "confidence": 0.6}
    out = out.withColumns({"section": number, "section_type": kind, **{k: F.lit(v) for k, v in constants.items()}})
    return out.select("signal_id", "section", "section_type", "start_time", "end_time", "first_segment", "n_segments", "avg_energy", "avg_brightness", "dynamic_variation", *constants)


def transitions(rows: DataFrame) -> DataFrame:
    """(signal_id, to_segment, time, transition_type, strength, duration) where neighbours differ much."""
    c = F.col
    pairs = _previous(rows, "energy", "spectral_centroid", "content_type").where("energy_before is not null")
    pairs = pairs.withColumns({"de": F.abs(c("energy") - c("energy_before")), "ds": F.abs(c("spectral_centroid") - c("spectral_centroid_before")) / 5000.0, "dk": c("content_type") != c("content_type_before")})
    kind = F.when(c("dk"), "Abrupt").when((c("de") > 0.5) & (c("energy") > c("energy_before")), "BuildUp").when(c("de") > 0.5, "DropOut").otherwise("Smooth")
    found = pairs.where("de > 0.3D or ds > 0.3D or dk")
    return found.select("signal_id", F.col("segment").alias("to_segment"), F.col("start_time").alias("time"), kind.alias("transition_type"), F.least(c("de") + c("ds"), F.lit(1.0)).alias("strength"), F.lit(0.1).alias("duration"))


def tension(rows: DataFrame) -> DataFrame:
    """(signal_id, segment, time, tension, change_type) of every segment but the first."""
    c = F.col
    pairs = _previous(rows, "energy", "spectral_centroid").where("energy_before is not null")
    change = c("energy") - c("energy_before")
    value = scalar.clamp(F.abs(change) + F.abs(c("spectral_centroid") - c("spectral_centroid_before")) / 10000.0)
    kind = F.when(change > 0.2, "BuildUp").when(change < -0.2, "Release").otherwise("Plateau")
    return pairs.select("signal_id", "segment", F.col("start_time").alias("time"), value.alias("tension"), kind.alias("change_type"))


def energy_extremes(rows: DataFrame) -> DataFrame:
    """(signal_id, segment, time, energy, kind): strict inner peaks and valleys of the energy."""
    e = F.col("energy")
    around = layout.neighbours(rows, {"a": (e, -1), "b": (e, 1)}, pos="segment", block=BLOCK)
    kind = F.when((e > F.col("a")) & (e > F.col("b")), "peak").when((e < F.col("a")) & (e < F.col("b")), "valley")
    return around.select("signal_id", "segment", F.col("start_time").alias("time"), "energy", kind.alias("kind")).where("kind is not null")


def energy_profile(rows: DataFrame) -> DataFrame:
    """(signal_id, n_segments, average, variance, shape)."""
    numbered = rows.select("signal_id", "energy", (F.row_number().over(by_segment()) - 1).alias("i"), F.count("*").over(Window.partitionBy("signal_id")).alias("n"))
    first, last = F.col("i") < F.floor(F.col("n") / 3), F.col("i") >= F.floor(F.col("n") * 2 / 3)
    out = numbered.groupBy("signal_id").agg(
        F.max("n").alias("n_segments"), F.avg("energy").alias("average"), F.var_pop("energy").alias("variance"),
        (F.avg(F.when(last, F.col("energy"))) - F.avg(F.when(first, F.col("energy")))).alias("d"),
    )
    d = F.col("d")
    shape = F.when((F.col("n_segments") < 3) | (F.abs(d) < 0.1), "Flat").when(d > 0.2, "Increasing").when(d < -0.2, "Decreasing").otherwise("Complex")
    return out.select("signal_id", "n_segments", "average", "variance", shape.alias("shape"))


def periodic_events(rows: DataFrame) -> DataFrame:
    """(signal_id, period, phase, strength): the upper median distance of energy peaks, of signals with three or more."""
    peaks = energy_extremes(rows).where("kind = 'peak'")
    order = Window.partitionBy("signal_id").orderBy("time")
    gaps = peaks.select("signal_id", "time", (F.col("time") - F.lag("time").over(order)).alias("gap"))
    first = gaps.groupBy("signal_id").agg(F.min("time").alias("first"), F.count("*").alias("peaks")).where("peaks > 2")
    middle = layout.index_percentiles(gaps.where("gap is not null"), "gap", {"period": 50}).drop("n")
    out = first.join(middle, "signal_id")
    return out.select("signal_id", "period", F.expr("first % period").alias("phase"), F.lit(0.7).alias("strength"))


def repetitions(rows: DataFrame, shortest: int = 2, longest: int = 8, least: float = 0.7) -> DataFrame:
    """(signal_id, length, start_a, start_b, similarity): pairs of windows of segments that resemble each other.

    Windows start at most at the second last legal place. Segments meet at each distance once;
    a window pair's similarity is a moving average along that distance, so windows of all lengths
    come from one set of segment pairs. Pairs of segments are what is asked for, within a signal.
    """
    c = F.col
    seg = rows.select("signal_id", "segment", "energy", "spectral_centroid", "label", "start_time", F.count("*").over(Window.partitionBy("signal_id")).alias("n"))
    other = seg.select("signal_id", F.col("segment").alias("j"), F.col("energy").alias("e2"), F.col("spectral_centroid").alias("s2"), F.col("label").alias("l2"), F.col("start_time").alias("t2"))
    alike = (2.0 - F.abs(c("energy") - c("e2")) - F.least(F.abs(c("spectral_centroid") - c("s2")) / 10000.0, F.lit(1.0)) + F.when(c("label") == c("l2"), 1.0).otherwise(0.0)) / 3.0
    pairs = seg.join(other, "signal_id").where(c("j") - c("segment") >= shortest).select("signal_id", "n", c("segment").alias("i"), "j", (c("j") - c("segment")).alias("d"), "start_time", "t2", alike.alias("s"))
    order = Window.partitionBy("signal_id", "d").orderBy("i")
    ahead = {w: order.rowsBetween(0, w - 1) for w in range(shortest, longest + 1)}
    means = pairs.withColumns({f"s{w}": F.avg("s").over(ahead[w]) for w in ahead} | {f"m{w}": F.count("*").over(ahead[w]) for w in ahead})
    lengths = F.explode(F.array(*[F.struct(F.lit(w).alias("length"), F.col(f"s{w}").alias("similarity"), F.col(f"m{w}").alias("m")) for w in ahead]))
    out = means.select("signal_id", "n", "i", "j", "d", "start_time", "t2", lengths.alias("w")).select("*", "w.length", "w.similarity", "w.m")
    out = out.where((c("m") == c("length")) & (c("n") >= c("length") * 2) & (c("d") >= c("length")) & (c("j") < c("n") - c("length")))
    out = out.select("signal_id", "length", c("start_time").alias("start_a"), c("t2").alias("start_b"), "similarity")
    return out.where(F.col("similarity") > least)


def coherence(rows: DataFrame) -> DataFrame:
    """(signal_id, coherence_score): mean likeness of neighbours, 1 for a single segment."""
    c = F.col
    pairs = _previous(rows, "energy", "spectral_centroid", "zcr")
    near = lambda a: F.lit(1.0) - F.least(a, F.lit(1.0))
    alike = (F.lit(1.0) - F.abs(c("energy") - c("energy_before")) + near(F.abs(c("spectral_centroid") - c("spectral_centroid_before")) / 10000.0) + near(F.abs(c("zcr") - c("zcr_before")))) / 3.0
    return pairs.groupBy("signal_id").agg(F.coalesce(F.avg(alike), F.lit(1.0)).alias("coherence_score"))


def complexity(rows: DataFrame, profile: DataFrame, repeats: DataFrame) -> DataFrame:
    """(signal_id, temporal_complexity): mean of label variety, energy variance, changes a segment and lack of repetition."""
    labels = rows.groupBy("signal_id").agg(F.count_distinct("label").alias("labels"))
    found = repeats.groupBy("signal_id").agg(F.count("*").alias("r"))
    out = profile.join(labels, "signal_id").join(found, "signal_id", "left")
    n = F.col("n_segments")
    lack = F.lit(1.0) - F.least(F.coalesce("r", F.lit(0)) / F.lit(10.0), F.lit(1.0))
    value = (F.col("labels") / n + F.col("variance") + (n - 1) / n + lack) / 4.0
    return out.select("signal_id", scalar.clamp(value).alias("temporal_complexity"))


def run_length(rows: DataFrame, value: Column) -> DataFrame:
    """(signal_id, run, first_segment, n, value): runs of equal values, the general form of ``sections``."""
    marked = layout.neighbours(rows.withColumn("v", value), {"v_before": (F.col("v"), -1)}, pos="segment", block=BLOCK)
    runs = layout.running_count(marked, F.col("v") != F.col("v_before"), "run", pos="segment", block=BLOCK)
    return runs.groupBy("signal_id", "run").agg(F.min("segment").alias("first_segment"), F.count("*").alias("n"), F.min("v").alias("value"))

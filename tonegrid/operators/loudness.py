"""Loudness: weighting filter, gated level, range, momentary values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters, scalar
from . import layout

KEYS = layout.KEYS
GATE = scalar.power_of_lufs(-70.0)


def weighted(samples: DataFrame, rate: float, block: int = layout.BLOCK) -> DataFrame:
    """(signal_id, pos, x) after the loudness weighting.

    The recurrence is linear, so blocks are filtered side by side from rest; only the four numbers
    of state at the blocks' ends pass from block to block, and a second pass filters each block
    from the state it truly starts with. No signal has to fit into a task.
    """
    system = filters.loudness_weighting(rate)
    schema = samples.schema["signal_id"].dataType.simpleString()
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    blocks = layout.tumbling(samples, block, gathered.alias("part"), name="block")
    n = len(system.a)

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return lists.flatten().to_numpy(zero_copy_only=False).astype(float), lengths

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), values.ravel())

    @F.arrow_udf("array<double>")
    def ends(parts: pa.Array) -> pa.Array:
        x, lengths = flat(parts)
        return lists(system.run_many(x, lengths, np.zeros((len(lengths), n)))[1], np.full(len(lengths), n))

    carry = system.power(block)

    @F.arrow_udf("array<double>")
    def scan(states: pa.Array) -> pa.Array:
        """The states at the starts of each signal's blocks from those at the ends from rest, one after the other; signals side by side."""
        x, lengths = flat(states)
        end, count = x.reshape(-1, n), lengths // n
        first, now, starts = np.cumsum(count) - count, np.zeros((len(count), n)), np.empty((len(x) // n, n))
        for turn in range(int(count.max(initial=0))):
            here = np.flatnonzero(count > turn)
            starts[first[here] + turn] = now[here]
            now[here] = now[here] @ carry.T + end[first[here] + turn]
        return lists(starts, lengths)

    states = blocks.select("signal_id", F.struct("block", ends("part").alias("state")).alias("b"))
    states = states.groupBy("signal_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    starts = states.select("signal_id", F.col("b.block").alias("blocks"), scan(F.flatten("b.state")).alias("starts"))
    starts = starts.select("signal_id", "starts", F.posexplode("blocks").alias("turn", "block"))
    starts = starts.select("signal_id", "block", F.slice("starts", F.col("turn") * n + 1, n).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths = flat(batch.column("part"))
            out = system.run_many(x, lengths, flat(batch.column("start"))[0].reshape(-1, n))[0]
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("block"), lists(out, lengths)], names=["signal_id", "block", "part"])

    out = blocks.join(starts, ["signal_id", "block"]).mapInArrow(run, f"signal_id {schema}, block long, part array<double>")
    at = out.select("signal_id", "block", F.posexplode("part").alias("i", "x"))
    return at.select("signal_id", (F.col("block") * block + F.col("i")).alias("pos"), "x")


def integrated(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, lufs): level of the samples above an absolute gate, then above one 10 below their level.

    Gates apply to single samples. A signal without any sample above the gate has the level of 1e-10.
    """
    square = samples.select(*keys, (F.col("x") * F.col("x")).alias("sq"))
    first = square.groupBy(*keys).agg(F.avg(F.when(F.col("sq") >= GATE, F.col("sq"))).alias("ms"))
    first = first.withColumn("ms", F.coalesce("ms", F.lit(1e-10)))
    gates = first.withColumn("gate", F.greatest(F.col("ms") / 10.0, F.lit(GATE)))
    second = square.join(gates, list(keys)).groupBy(*keys).agg(F.avg(F.when(F.col("sq") >= F.col("gate"), F.col("sq"))).alias("gated"), F.max("ms").alias("ms"))
    return second.select(*keys, scalar.lufs(F.coalesce("gated", "ms")).alias("lufs"))


def _windows(samples: DataFrame, seconds: float, rate: float, keys: tuple[str, ...]) -> DataFrame:
    size, hop = max(1, int(rate * seconds)), max(1, int(rate * 0.1))
    whole = layout.hopping_sums(samples, size, hop, {"sq": F.col("x") * F.col("x")}, keys).where(F.col("n") == size)
    return whole.select(*keys, "window", (F.col("sq") / F.col("n")).alias("ms"))


def momentary(samples: DataFrame, rate: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, window, lufs) of 400 ms each 100 ms, ungated."""
    level = F.when(F.col("ms") > 1e-10, scalar.lufs(F.col("ms"))).otherwise(F.lit(scalar.LUFS_FLOOR))
    return _windows(samples, 0.4, rate, keys).select(*keys, "window", level.alias("lufs"))


def short_term(samples: DataFrame, rate: float, keys: tuple[str, ...] = KEYS, seconds: float = 3.0) -> DataFrame:
    """(keys, window, lufs) of 3 s each 100 ms, those above the absolute gate."""
    return _windows(samples, seconds, rate, keys).where(F.col("ms") >= GATE).select(*keys, "window", scalar.lufs(F.col("ms")).alias("lufs"))


def loudness_range(windows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n, loudness_range): 95th less 10th percentile of the short-term levels, 0 for fewer than two."""
    out = layout.index_percentiles(windows, "lufs", {"low": 10, "high": 95}, keys)
    return out.select(*keys, "n", F.when(F.col("n") > 1, F.col("high") - F.col("low")).otherwise(F.lit(0.0)).alias("loudness_range"))


def levels(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, n, peak, rms, true_peak_dbfs, dynamic_range, crest_factor) of the unweighted samples."""
    out = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    peak_db, rms_db = scalar.level_db(F.col("peak"), -70.0), scalar.level_db(F.col("rms"), -70.0)
    crest = F.coalesce(scalar.ratio(F.col("peak"), F.col("rms")), F.lit(0.0))
    return out.select(*keys, "n", "peak", "rms", peak_db.alias("true_peak_dbfs"), (peak_db - rms_db).alias("dynamic_range"), crest.alias("crest_factor"))


def perceptual(samples: DataFrame, rate: float) -> DataFrame:
    """One row a signal: the levels and the weighted loudness figures. Empty signals have no rows."""
    loud = weighted(samples, rate)
    spread = loudness_range(short_term(loud, rate))
    out = levels(samples).join(integrated(loud), "signal_id").join(spread.drop("n"), "signal_id", "left")
    energy = scalar.clamp((F.col("lufs") + 60.0) / 55.0)
    return out.select("*", energy.alias("energy_level")).withColumn("loudness_range", F.coalesce("loudness_range", F.lit(0.0))).withColumnRenamed("lufs", "loudness_lufs")

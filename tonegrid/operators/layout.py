"""How signals lie in tables, and the windows over them.

A signal is rows ``(signal_id, pos, x)``: sample number from 0 and value. Operators take further key
columns (``keys``) so that they apply to segments as to whole signals. None of them needs a signal
in one task: local rules (neighbours, frames) run in blocks that overlap by what the rule can see,
and everything else is an aggregation that combines on the map side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection

KEYS = ("signal_id",)
#: Samples of a block; a task holds a block and its overlap at a time.
BLOCK = 65_536


def index_samples(rows: DataFrame, key: str, order: list[str], value: Column, bucket: Column | None = None) -> DataFrame:
    """(signal_id, pos, x): ``pos`` numbers the rows of a key in the order of ``order``.

    With ``bucket``, a coarse column that never falls along the order (such as the day of a time),
    ranks are taken in two levels: counts of buckets are summed, rows are numbered inside theirs,
    so a key with a large part of all rows is spread over its buckets.
    """
    base = rows.select(F.col(key).alias("signal_id"), *order, value.alias("x"), (F.lit(0) if bucket is None else bucket).alias("bucket"))
    inside = Window.partitionBy("signal_id", "bucket").orderBy(*order)
    ranked = base.withColumn("rank", F.row_number().over(inside) - 1)
    if bucket is None:
        return ranked.select("signal_id", F.col("rank").cast("long").alias("pos"), "x")
    before = Window.partitionBy("signal_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy("signal_id", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("signal_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(starts, ["signal_id", "bucket"]).select("signal_id", (F.col("start") + F.col("rank")).alias("pos"), "x")


def explode_samples(signals: DataFrame, samples: str = "samples") -> DataFrame:
    """(signal_id, pos, x) from one row a signal; null arrays have no samples."""
    at = signals.select("signal_id", F.posexplode(samples).alias("pos", "x"))
    return at.select("signal_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def with_halo(samples: DataFrame, before: int, after: int, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Adds ``block`` and ``own``: rows near an edge are also given to the neighbouring block.

    A window partitioned by the keys and ``block`` then sees ``before`` rows back and ``after``
    rows ahead of every row with ``own``, as if the signal were whole.
    """
    p = F.col(pos)
    first = F.greatest(F.floor((p - after) / block), F.lit(0))
    blocks = F.sequence(first, F.floor((p + before) / block))
    return samples.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.floor(p / block))


def neighbours(samples: DataFrame, columns: dict[str, tuple[str, int]], keys: tuple[str, ...] = KEYS, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Adds ``columns``: name -> (column, offset), the value ``offset`` rows ahead (negative: back)."""
    reach = [o for _, o in columns.values()]
    halo = with_halo(samples, max(0, -min(reach)), max(0, max(reach)), pos, block)
    order = Window.partitionBy(*keys, "block").orderBy(pos)
    seen = halo.withColumns({name: F.lag(c, -o).over(order) if o < 0 else F.lead(c, o).over(order) for name, (c, o) in columns.items()})
    return seen.where("own").drop("block", "own")


def with_crossings(samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds ``crossed``: 1 if the sign (0 counts as positive) differs from the sample before."""
    pairs = neighbours(samples, {"x_before": ("x", -1)}, keys)
    return pairs.withColumn("crossed", F.coalesce(((F.col("x") >= 0) != (F.col("x_before") >= 0)).cast("int"), F.lit(0))).drop("x_before")


def tumbling(samples: DataFrame, size: int, *aggs: Column, keys: tuple[str, ...] = KEYS, pos: str = "pos", name: str = "chunk") -> DataFrame:
    """Aggregates of chunks of ``size`` samples; the last chunk may be short."""
    return samples.groupBy(*keys, F.floor(F.col(pos) / max(1, size)).alias(name)).agg(*aggs)


def assign(samples: DataFrame, size: int, hop: int, name: str, pos: str = "pos", offset: str = "off") -> DataFrame:
    """One row for each window of ``size`` samples, begun every ``hop``, that a sample lies in:
    adds the window's number and the sample's ``offset`` in it."""
    size, hop = max(1, size), max(1, hop)
    p = F.col(pos)
    last = F.floor(p / hop)
    first = F.least(F.greatest(F.floor((p - size) / hop) + 1, F.lit(0)), last)
    out = samples.withColumn(name, F.explode(F.sequence(first, last)))
    return out.withColumn(offset, p - F.col(name) * hop).where(F.col(offset) < size)


def hopping_sums(samples: DataFrame, size: int, hop: int, sums: dict[str, Column], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, window, start, n, sums...) of whole and partial windows, through sums of small cells.

    Cells of the greatest common divisor of size and hop are summed first; a window is a frame over
    its cells, so strongly overlapping windows cost a row a cell and not a copy of each sample.
    """
    size, hop = max(1, size), max(1, hop)
    g = math.gcd(size, hop)
    cells = tumbling(samples, g, F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()], keys=keys, name="cell")
    frame = Window.partitionBy(*keys).orderBy("cell").rowsBetween(0, size // g - 1)
    out = cells.withColumns({k: F.sum(k).over(frame) for k in ("n", *sums)})
    out = out.where(F.col("cell") % (hop // g) == 0)
    return out.select(*keys, (F.col("cell") * g / hop).cast("long").alias("window"), (F.col("cell") * g).alias("start"), "n", *sums)


def running_count(rows: DataFrame, counted: Column, name: str, keys: tuple[str, ...] = KEYS, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Adds ``name``: how many rows up to this one, in the order of ``pos``, have ``counted``.

    A scan in two levels: rows are counted inside blocks, the blocks' totals before each block are
    summed, so that a task orders a block's rows or a key's blocks, never a key's rows. Groups by
    the count of marked beginnings are runs, which cross blocks as they please.
    """
    marked = rows.withColumns({"block": F.floor(F.col(pos) / block), name: F.when(counted, 1).otherwise(0).cast("long")})
    totals = marked.groupBy(*keys, "block").agg(F.sum(name).alias("total"))
    before = F.sum("total").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("block").alias("block_"), F.coalesce(before, F.lit(0)).alias("before_"))
    inside = F.sum(name).over(Window.partitionBy(*keys, "block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("block") == F.col("block_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    out = marked.withColumn(name, inside).join(starts, same)
    return out.withColumn(name, F.col(name) + F.col("before_")).drop("block", "block_", "before_", *[f"{k}_" for k in keys])


def index_percentiles(values: DataFrame, value: str, percents: dict[str, int], keys: tuple[str, ...] = KEYS, bounded: bool = False) -> DataFrame:
    """(keys, n, percentiles...): the value at index floor(n * percent / 100) of the sorted values.

    This is an index into the sorted list and neither ``percentile`` nor ``percentile_approx``. Keys
    of any number of values are selected from by counting (``selection``); ``bounded`` says that a
    key has few, such as the levels inside a segment, which are ranked in one go.
    """
    if not bounded:
        return selection.index_percentiles(values, value, percents, keys)
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = values.select(*keys, value).withColumn("at", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    picks = [F.max(F.when(F.col("at") == F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col(value))).alias(k) for k, p in percents.items()]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def frames_of(samples: DataFrame, size: int, hop: int, keys: tuple[str, ...] = KEYS, pos: str = "pos") -> DataFrame:
    """(keys, frame_idx, frame): arrays of ``size`` samples begun every ``hop``; whole frames only.

    Samples are first gathered into small chunks, and frames are put together from chunks, so a
    sample is moved once and a chunk once for each frame it lies in.
    """
    g = math.gcd(size, hop)
    gathered = F.transform(F.sort_array(F.collect_list(F.struct(pos, "x"))), lambda s: s["x"])
    chunks = tumbling(samples, g, gathered.alias("part"), keys=keys, pos=pos)
    dealt = assign(chunks, size // g, hop // g, "frame_idx", pos="chunk", offset="turn")
    parts = F.sort_array(F.collect_list(F.struct("turn", "part")))
    frames = dealt.groupBy(*keys, "frame_idx").agg(F.flatten(F.transform(parts, lambda s: s["part"])).alias("frame"))
    return frames.where(F.size("frame") == size)


def frames_of_arrays(signals: DataFrame, size: int, hop: int, samples: str = "samples", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same from one row a signal: slices, without a shuffle."""
    starts = F.when(F.size(samples) >= size, F.sequence(F.lit(0), F.size(samples) - size, F.lit(hop)))
    out = signals.select(*keys, samples, F.posexplode(starts).alias("frame_idx", "at"))
    frame = F.transform(F.slice(samples, F.col("at") + 1, size), lambda x: x.cast("double"))
    return out.select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), frame.alias("frame"))


def ordered(name: str, order: str, value: Column) -> Column:
    """The values of a group as an array in the order of a column; nulls are left out."""
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"]).alias(name)

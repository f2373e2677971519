"""Exact order statistics of keyed values, without sorting a key's values in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bits of a value's pattern that one level of counting tells apart: a cell has at most 2^22 rows, the first level 2^20.
DIGIT = 22
LEVELS = -(-64 // DIGIT)
LEAST = -(2**63)


@F.pandas_udf(LongType())
def _bits(values: pd.Series) -> pd.Series:
    """The bits of doubles, those of negative numbers turned over, so that they order as the doubles do; NaN comes last."""
    x = values.to_numpy(dtype="float64")
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return pd.Series(np.where(bits >= 0, bits, bits ^ np.int64(2**63 - 1)))


def order_pattern(value: Column) -> Column:
    """A long that orders as the double does: null first, then -inf up to inf, then NaN; zeros are equal.

    Spark has no expression for a double's bits; all that follows stays in the JVM.
    """
    return F.when(value.isNull(), F.lit(LEAST)).otherwise(_bits(value.cast("double")))


def index_percentiles(values: DataFrame, value: str, percents: dict[str, int], keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, percentiles...): the value at index floor(n * percent / 100) of a key's sorted values.

    Equal values are counted together first. Their patterns are then counted by their first 42 and
    20 bits, each from the counts below it, and every percentile is narrowed from the top: the cell
    of 20 bits that holds the wanted index, the cell of 42 bits within it, and there one pattern. No group of any step, join or window has more rows than a cell has digits, whatever a
    key has, so one key's values are spread over all tasks; what is sorted are counts of a cell.
    """
    cells = values.select(*keys, F.col(value).alias("v"), order_pattern(F.col(value)).alias("p"))
    cells = cells.groupBy(*keys, "p").agg(F.count("*").alias("c"), F.min("v").alias("v"))
    levels = {LEVELS: cells}
    for level in range(LEVELS - 1, 0, -1):
        levels[level] = levels[level + 1].groupBy(*keys, F.shiftright("p", DIGIT).alias("p")).agg(F.sum("c").alias("c"))
    n = levels[1].groupBy(*keys).agg(F.sum("c").alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1).alias("at")) for name, p in percents.items()])
    goals = n.select(*keys, "n", F.explode(wanted).alias("w")).select(*keys, "n", "w.name", "w.at").withColumn("in", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        parent = F.lit(0).cast("long") if level == 1 else F.shiftright("p", DIGIT)
        upto = F.sum("c").over(Window.partitionBy(*keys, "in_").orderBy("p"))
        counted = levels[level].withColumn("in_", parent).withColumn("before", upto - F.col("c"))
        counted = counted.withColumnsRenamed({k: f"{k}_" for k in keys})
        here = (F.col("in") == F.col("in_")) & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("c"))
        for k in keys:
            here = here & F.col(k).eqNullSafe(F.col(f"{k}_"))
        last = ["v"] if level == LEVELS else []
        goals = goals.join(counted, here).select(*keys, "n", "name", (F.col("at") - F.col("before")).alias("at"), F.col("p").alias("in"), *last)
    picks = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in percents]
    return goals.groupBy(*keys).agg(F.max("n").alias("n"), *picks)

"""Expressions over a spectrum held as an array column (index = FFT bin)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col, ratio


def total(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def weighted_index(a: str | Column) -> Column:
    """Sum of index times value."""
    return total(F.transform(col(a), lambda x, i: x * i))


def mean_index(a: str | Column) -> Column:
    """The centroid in bins; null without any magnitude."""
    return ratio(weighted_index(a), total(a))


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def argmax(a: str | Column) -> Column:
    """Lowest index of the greatest value, from 0; 0 if no value is above 0."""
    a = col(a)
    return F.when(F.array_max(a) > 0, F.array_position(a, F.array_max(a)) - 1).otherwise(F.lit(0)).cast("int")


def rolloff_index(a: str | Column, share: float = 0.85) -> Column:
    """First index at which the running sum reaches ``share`` of the whole."""
    a = col(a)
    # the goal travels in the accumulator, so that it is summed once and not for each element
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("at"), F.lit(False).alias("done"), (total(a) * F.lit(share)).alias("goal"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + x
        done = acc["done"] | (s >= acc["goal"])
        return F.struct(s.alias("s"), F.when(done, acc["at"]).otherwise(acc["at"] + 1).alias("at"), done.alias("done"), acc["goal"].alias("goal"))

    return F.aggregate(a, start, step, lambda acc: F.when(acc["done"], acc["at"]).otherwise(F.lit(0)))


def rise(now: Column, before: Column, power: int = 1) -> Column:
    """Half-wave rectified difference: its sum, or for power 2 the root of its squares' sum."""
    up = F.zip_with(now, before, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return total(up) if power == 1 else norm(up)


def mean(a: str | Column) -> Column:
    return ratio(total(a), F.size(col(a)))

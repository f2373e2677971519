"""Signals from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal a user: the values of the user's events in order of time, scaled to lie around 0."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return layout.index_samples(events, "user_id", ["ts", "event_id"], F.col("value").cast("double") / 100 - 0.5, F.to_date("ts"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, t): the events of a user as onsets, in days of the year."""
    since = F.expr("cast(ts as timestamp_ntz) - timestamp_ntz'2024-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    micros = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")).cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("signal_id"), (micros / F.lit(86_400_000_000.0)).alias("t"))


def embedding_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector: (signal_id, label, samples), taken as a second of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


def daily_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal a return flag: the day's sum of prices, in units of the scale's usual day, around 0."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    days = items.groupBy("l_returnflag", "day").agg(F.sum("price").cast("double").alias("price"))
    return layout.index_samples(days, "l_returnflag", ["day"], F.col("price") / 1e6)

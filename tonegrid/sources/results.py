"""A table of results, keyed by what they were made from: the cache, and its limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import stage

SCHEMA = "cache_key string, created_at timestamp, accessed_at timestamp, size_bytes long, result string"
#: Default budget and lifetime.
MOST_BYTES, LIFETIME_SECONDS = 10 << 30, 24 * 3600


def cache_key(path: Column, modified: Column, length: Column, **params) -> Column:
    """A digest of a file's path, time and length and of the parameters; null parts are left out."""
    parts = [path, modified.cast("string"), length.cast("string"), F.lit(repr(sorted(params.items())))]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def simple_key(value: Column) -> Column:
    return F.sha2(value, 256)


def entries(results: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows of the cache from rows of results: everything but the key as JSON."""
    body = F.to_json(F.struct(*[c for c in results.columns if c != key]))
    return results.select(F.col(key).alias("cache_key"), now.alias("created_at"), now.alias("accessed_at"), F.octet_length(body).cast("long").alias("size_bytes"), body.alias("result"))


def fresh(cache: DataFrame, now: Column, seconds: int = LIFETIME_SECONDS) -> DataFrame:
    """Entries that have not expired; age counts from creation, wherever an entry is held."""
    return cache.where(F.col("created_at") + F.make_dt_interval(secs=F.lit(seconds)) > now)


def lookup(requests: DataFrame, cache: DataFrame, now: Column, seconds: int = LIFETIME_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(hits with their results, requests to compute) of rows with a cache_key."""
    live = fresh(cache, now, seconds).select("cache_key", "result")
    return requests.join(live, "cache_key"), requests.join(live, "cache_key", "left_anti")


def least_recent(cache: DataFrame, needed: int) -> DataFrame:
    """The entries, least recently used first, that free ``needed`` bytes (all of them if that is too few).

    Sizes are summed per hour of access before entries are ordered, so only the hour in which the
    budget is met is sorted.
    """
    hour = F.date_trunc("hour", "accessed_at")
    hours = cache.groupBy(hour.alias("hour")).agg(F.sum("size_bytes").alias("bytes"))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("freed", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("freed") < needed)
    inside = Window.partitionBy("hour").orderBy("accessed_at", "cache_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = cache.withColumn("hour", hour).join(hours.select("hour", "freed"), "hour")
    rows = rows.withColumn("upto", F.col("freed") + F.coalesce(F.sum("size_bytes").over(inside), F.lit(0)))
    return rows.where(F.col("upto") < needed).drop("hour", "freed", "upto")


def evict(cache: DataFrame, incoming: int, most: int = MOST_BYTES) -> DataFrame:
    """What stays when ``incoming`` bytes must fit into the budget."""
    held = cache.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    if held + incoming <= most:
        return cache
    return cache.join(least_recent(cache, held + incoming - most).select("cache_key"), "cache_key", "left_anti")


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache under a path; an empty one if nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def put(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.select("cache_key", "created_at", "accessed_at", "size_bytes", "result").write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)


class ResultCache:
    """A cache that the use of it keeps up to date: entries as a table of runs, and an append-only log of accesses.

    ``get`` answers requests from the entries that are fresh and notes the hits' times in the log;
    ``put`` first makes room, by the last access that entry or log know, and then adds entries.
    Both merge what they need by aggregation on the key: of entries with one key the last made
    holds, and its last access is the greatest noted since. ``merge`` rewrites entries with their
    accesses and empties the log. Only sums of hours reach the driver's decisions.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = MOST_BYTES, seconds: int = LIFETIME_SECONDS):
        self.spark, self.path, self.most, self.seconds = spark, path.rstrip("/"), most, seconds

    def _log(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        schema = "cache_key string, accessed_at timestamp, gone boolean"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """Entries as they are now: one a key, with its last access. Evicted keys are gone until put again."""
        made = read_cache(self.spark, f"{self.path}/entries").withColumn("gone", F.lit(False))
        log = self._log().withColumns({"created_at": F.lit(None).cast("timestamp"), "size_bytes": F.lit(None).cast("long"), "result": F.lit(None).cast("string")})
        both = made.unionByName(log)
        last = F.max(F.when(F.col("created_at").isNotNull(), F.struct("created_at", "size_bytes", "result"))).alias("e")
        dropped = F.max(F.when(F.col("gone"), F.col("accessed_at"))).alias("dropped_at")
        now = both.groupBy("cache_key").agg(last, F.max(F.when(~F.col("gone"), F.col("accessed_at"))).alias("accessed_at"), dropped)
        held = F.col("e").isNotNull() & (F.col("dropped_at").isNull() | (F.col("e.created_at") > F.col("dropped_at")))
        return now.where(held).select("cache_key", "e.created_at", F.greatest("accessed_at", "e.created_at").alias("accessed_at"), "e.size_bytes", "e.result")

    def get(self, requests: DataFrame, now: str = "at") -> DataFrame:
        """Hits (the requests' columns and ``result``) of requests with a cache_key and a time; each one's time is noted."""
        live = self.entries().select("cache_key", "created_at", "result")
        hits = requests.join(live, "cache_key").where(F.col("created_at") + F.make_dt_interval(secs=F.lit(self.seconds)) > F.col(now)).drop("created_at")
        hits = stage.keep(hits)
        noted = hits.groupBy("cache_key").agg(F.max(now).alias("accessed_at")).withColumn("gone", F.lit(False))
        noted.write.mode("append").parquet(f"{self.path}/log")
        return hits

    def put(self, rows: DataFrame, now: Column) -> DataFrame:
        """Add rows of ``entries``; the keys (cache_key) that had to go for them, the least recently used first to go.

        What comes in alone may be more than the cache's budget; then everything else goes.
        """
        held = stage.keep(self.entries())
        sizes = held.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0], rows.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
        needed = sum(sizes) - self.most
        gone = stage.keep((least_recent(held, needed) if needed > 0 else held.limit(0)).select("cache_key"))
        gone.select("cache_key", now.alias("accessed_at"), F.lit(True).alias("gone")).write.mode("append").parquet(f"{self.path}/log")
        put(self.spark, f"{self.path}/entries", rows)
        return gone

    def merge(self) -> None:
        """One entry a key with its last access, and an empty log."""
        now = stage.keep(self.entries())
        now.write.mode("overwrite").parquet(f"{self.path}/entries")
        self._log().limit(0).write.mode("overwrite").parquet(f"{self.path}/log")

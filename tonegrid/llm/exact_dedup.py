"""Exact deduplication through a log-structured merge index of text digests.

Tasks flush memtables: runs sorted by digest, in which a task's own copies are already one entry.
Compaction merges runs level by level into one, keeping the best identifier and the number of rows
of a digest. The index that remains holds the digests of several rows; its filter tells most rows
apart from them without a lookup, and hits receive byte verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Cells of a filter block, and the most blocks (4 KB each) that are broadcast.
BLOCK, MOST_BLOCKS = 1 << 15, 1 << 11


def best_of(col: str, keep: str) -> Column:
    return F.min(col) if keep == "min" else F.max(col)


def flush(docs: DataFrame, scratch: common.Scratch, id_col: str, text_col: str, keep: str, bits: int = 256) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): every row's (id, sha, digest, task), and the runs (run, digest, best, n) of all tasks.

    ``bits`` shortens the digest (tests use it to provoke collisions).
    """
    sha = F.sha2(common.lower_az(F.col(text_col)), 256)
    rows = docs.select(F.col(id_col).alias("id"), sha.alias("sha"), F.spark_partition_id().alias("task"))
    rows = scratch.write(rows.withColumn("digest", F.substring("sha", 1, bits // 4)), "rows")
    return rows, _merge(rows.select(F.col("task").alias("run"), "digest", F.col("id").alias("best"), F.lit(1).cast("long").alias("n")), scratch, keep)


def _merge(entries: DataFrame, scratch: common.Scratch, keep: str) -> DataFrame:
    """Entries of one run and digest become one; each run is written in the order of its digests."""
    merged = entries.groupBy("run", "digest").agg(best_of("best", keep).alias("best"), F.sum("n").alias("n"))
    return scratch.write(merged.sortWithinPartitions("run", "digest"), "run")


def compact(runs: DataFrame, scratch: common.Scratch, keep: str = "min", fan_in: int = 32) -> DataFrame:
    """The index (digest, keep_id, n) of the digests of several rows.

    Each level merges ``fan_in`` runs into one until one is left. An entry moves once a level, and a
    digest with a third of all rows is one entry a run, so no merge has a hot key.
    """
    count = runs.agg(F.max("run")).first()[0] or 0
    while count > 0:
        count //= fan_in
        runs = _merge(runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), scratch, keep)
    index = runs.where("n > 1").select("digest", F.col("best").alias("keep_id"), "n")
    return scratch.write(index, "index")


def filter_of(index: DataFrame, scratch: common.Scratch, bits_each: int = 16) -> tuple[DataFrame, int]:
    """(block, bits): a bitmap of the cells that the index's digests hash to, and its number of cells.

    Beyond ``MOST_BLOCKS`` it doesn't grow: more rows then pass it, and the lookup tells them apart.
    """
    blocks = min(MOST_BLOCKS, max(1, -(-index.count() * bits_each // BLOCK)))
    cells = blocks * BLOCK
    at = _cell(cells)
    made = index.groupBy(F.floor(at / BLOCK).alias("block")).agg(F.bitmap_construct_agg((at % BLOCK).cast("long")).alias("bits"))
    return F.broadcast(scratch.write(made, "filter")), cells


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(cells))


def may_hit(rows: DataFrame, filter_: tuple[DataFrame, int]) -> DataFrame:
    """Adds ``hit``: false proves that a row's digest is not in the index."""
    blocks, cells = filter_
    at = _cell(cells)
    rows = rows.withColumn("block", F.floor(at / BLOCK)).join(blocks, "block", "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor((at % BLOCK) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, (at % 8).cast("int")) == 1
    return rows.withColumn("hit", F.coalesce(set_, F.lit(False))).drop("block", "bits")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", bits: int = 256
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z, over their whole length; a null text
    equals an empty one. Of equal texts the row with the smallest id stays (``keep="max"``: the
    largest). Hits receive byte verification: the least and the greatest text of a digest must be
    the same bytes; digests that fail it are resolved by the texts themselves. Rows that repeat an
    id and its text are the same document: all of them carry the same ``kept``. A null id never
    counts as kept unless its whole group has null ids. An empty table gives an empty result; other
    columns are ignored.
    """
    with common.Scratch(docs.sparkSession, "lsm") as scratch:
        return common.materialize(_dedup(docs, scratch, id_col, text_col, keep, bits), "lsm-result")


def _dedup(docs: DataFrame, scratch: common.Scratch, id_col: str, text_col: str, keep: str, bits: int) -> DataFrame:
    rows, runs = flush(docs, scratch, id_col, text_col, keep, bits)
    index = compact(runs, scratch, keep)
    filter_ = filter_of(index, scratch)
    lookup = common.small(index)

    texts = docs.select(F.col(id_col).alias("id"), common.lower_az(F.col(text_col)).alias("norm"))
    texts = texts.withColumn("digest", F.substring(F.sha2("norm", 256), 1, bits // 4))
    hits = may_hit(texts, filter_).where("hit").join(lookup.select("digest"), "digest", "left_semi")
    checked = hits.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))
    checked = scratch.write(checked, "verified")
    bad = checked.where("not same").select("digest")

    probed = may_hit(rows, filter_)
    out = probed.where("hit").join(lookup, "digest", "left").drop("hit")
    if bad.isEmpty():
        keep_id, size = F.coalesce("keep_id", "id"), F.coalesce("n", F.lit(1))
    else:
        wrong = hits.join(common.small(bad), "digest", "left_semi")
        classes = wrong.groupBy("digest", "norm").agg(best_of("id", keep).alias("text_keep"), F.count("*").alias("text_n"))
        split = wrong.join(classes, ["digest", "norm"]).select("id", "digest", F.sha2("norm", 256).alias("sha"), "text_keep", "text_n")
        out = out.join(split.distinct(), ["id", "digest", "sha"], "left")
        keep_id, size = F.coalesce("text_keep", "keep_id", "id"), F.coalesce("text_n", "n", F.lit(1))
    columns = lambda k, n: [F.col("id").alias(id_col), k.alias("keep_id"), n.cast("long").alias("group_size"), F.col("id").eqNullSafe(k).alias("kept"), F.col("sha").alias("text_sha256")]
    return out.select(*columns(keep_id, size)).unionByName(probed.where("not hit").select(*columns(F.col("id"), F.lit(1))))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Symbols that lower a document's quality weight.
SYMBOLS = "#*$%&|<>!"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, falling with the number of symbols a word: 1 / (1 + symbols / words)."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1)))


def name_of(id_col: Column, text: Column) -> Column:
    """What a row's draw depends on: its id, or its text where it has none."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def uniform(name: Column, seed: int) -> Column:
    """A draw in (0, 1) that depends on the name and the seed only, so reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: Column | None = None) -> DataFrame:
    """(id, source, size, name, key) of every row, and ``row``: ``-ln(u) / quality_weight`` orders a source's rows."""
    text, extra = F.col(text_col), [] if row is None else [row.alias("row")]
    out = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), text.alias("text"), *extra)
    out = out.withColumn("name", name_of(F.col("id"), F.col("text")))
    key = -F.log(uniform(F.col("name"), seed)) / quality_weight(F.col("text"), F.col("size"))
    return out.select("id", "source", "size", "name", key.alias("key"), *(["row"] if extra else []))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, full, rest) from (source, source_size), one row a source.

    Sources by code point, null last, take ``weights`` in turn. Targets are ``min(most * size,
    level * weight)``, the level such that they sum to ``share`` of all sizes: sources sorted by
    the level that fills them, the first one that the remaining budget can't fill sets it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    one = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    one = one.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    one = one.withColumn("budget", F.sum("source_size").over(every) * share)
    one = one.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    one = one.withColumn("w_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    one = one.withColumn("open", F.col("cap") * F.col("w_left") > F.col("left") * F.col("weight"))
    level = F.first(F.when(F.col("open"), F.col("left") / F.col("w_left")), ignorenulls=True)
    one = one.withColumn("level", level.over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.round(F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))), 6)
    full = F.coalesce(F.floor(F.try_divide(target, F.col("source_size"))), F.lit(0))
    return one.select("source", "source_size", target.alias("target"), full.alias("full")).withColumn(
        "rest", F.col("target") - F.col("full") * F.col("source_size")
    )


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def cut_points(base: DataFrame, plan: DataFrame, scratch: common.Scratch, cells: int, most: int) -> DataFrame:
    """(source, lo, cut): a source takes its rows with keys below ``lo`` once more, and the rows
    from there up to ``cut`` = (key, name, size).

    The range of keys in which a source's rest runs out is divided into ``cells``; sizes are summed
    per cell, the cell that reaches the rest is the next range, by the least and greatest key in
    it, until at most ``most`` rows are left or all have one key. Only these are ordered, so no
    source is sorted whatever its share of the rows and however its keys lie.
    """
    ranges = plan.select("source", "rest", "lo", "hi", F.lit(0.0).alias("before"), F.lit(1 << 62).alias("rows"))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(64):
        inside = base.alias("b").join(common.small(ranges).alias("r"), _same("b", "r") & F.col("key").between(F.col("lo"), F.col("hi")))
        place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)).otherwise(0)
        inside = inside.select("b.source", "size", "key", "rest", "before", F.least(place, F.lit(cells - 1)).alias("cell"))
        sums = inside.groupBy("source", "rest", "before", "cell").agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi")
        )
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        over = sums.where("before + words > rest").groupBy("source").agg(F.min_by(F.struct("rest", "lo", "hi", "before", "rows"), "cell").alias("r"))
        ranges = scratch.write(over.select("source", "r.*"), "mix-ranges")
        if ranges.where((F.col("rows") > most) & (F.col("hi") > F.col("lo"))).isEmpty():
            break
    edge = base.alias("b").join(common.small(ranges).alias("r"), _same("b", "r") & F.col("key").between(F.col("lo"), F.col("hi")))
    # rows that are alike are one step: they are taken together
    edge = edge.select("b.source", "key", "name", "size", "rest", "before").groupBy("source", "key", "name", "size", "rest", "before").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("key", "name", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("middle", F.col("before") + F.sum("words").over(upto) - F.col("words") / 2).where("middle <= rest")
    cut = edge.groupBy("source").agg(F.max(F.struct("key", "name", "size")).alias("cut"))
    return ranges.alias("r").join(cut.alias("c"), _same("r", "c"), "left").select("r.source", "lo", "cut")


def plan_mix(base: DataFrame, scratch: common.Scratch, weights: tuple[float, ...], share: float, most: float, cells: int = 1024, sorted_rows: int = 20_000) -> DataFrame:
    """One row a source: source, source_size, target, full, lo, cut. ``base`` is ``keyed`` rows that were written."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    sizes = scratch.write(sizes, "mix-sizes")
    plan = targets(sizes.select("source", "source_size"), weights, share, most)
    plan = scratch.write(plan.alias("p").join(sizes.alias("s"), _same("p", "s")).select("p.*", "lo", "hi"), "mix-targets")
    cuts = cut_points(base, plan, scratch, cells, sorted_rows)
    out = plan.alias("p").join(cuts.alias("c"), _same("p", "c"), "left").select("p.source", "source_size", "target", "full", "c.lo", "cut")
    return common.materialize(out, "mix-plan")


def times_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and ``times`` to ``keyed`` rows, each decided by its own source's line of the plan."""
    out = rows.alias("b").join(common.small(plan).alias("p"), _same("b", "p")).select("b.*", "source_size", "target", "full", "lo", "cut")
    at, cut = F.struct("key", "name", "size"), F.col("cut")
    within = F.coalesce(F.col("key") < F.col("lo"), F.lit(True)) | F.coalesce(at <= cut, F.lit(False))
    return out.withColumn("times", F.col("full") + within.cast("long")).drop("full", "lo", "cut")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    Every document has the key ``-ln(u) / quality_weight``; within its source it is taken in key
    order until the words reach the source's budget. Complete epochs of the source come first
    (every document that many times), the rest of the target is the fractional selection. The
    document that crosses the budget is taken when that brings the sum nearer to it.

    A null or empty text has size 0 and is taken 0 words; whole texts count, however long; null
    sources form one source; rows without an id draw by their text; repeated rows share a key and
    are taken together. Other columns are ignored. Empty table: empty result.
    """
    with common.Scratch(docs.sparkSession, "mix") as scratch:
        base = scratch.write(keyed(docs, id_col, text_col, source_col, seed), "mix-keys")
        out = times_taken(base, plan_mix(base, scratch, weights, share, most))
        out = out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
        return common.materialize(out, "mix-result")


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: every input row as many times as it is taken, with all its columns.

    The same choice as ``mix_sources``. A row decides by its own key and its source's line of the
    plan, so no text moves. Documents without words are taken no times.
    """
    with common.Scratch(docs.sparkSession, "mix") as scratch:
        base = scratch.write(keyed(docs, id_col, text_col, source_col, seed), "mix-keys")
        plan = plan_mix(base, scratch, weights, share, most)
    rows = times_taken(keyed(docs, id_col, text_col, source_col, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), plan)
    rows = rows.where("size > 0 and times > 0").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select("row.*")

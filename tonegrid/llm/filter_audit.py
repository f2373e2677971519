"""Audit of filters that overlap: what each removes in every order, and its Shapley share of the removal."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterable
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The filters in the order of their bits.
FILTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
SYMBOL = re.compile(rb"[#$%&*|]")
#: Rows of the report that a task holds at a time: parts by orders and steps.
ROWS = 60_000


class Removal:
    """The multilinear extension of "rows removed by a set of filters", from counts of failure masks.

    With ``x_i`` the chance that filter i is applied, a row of mask m stays with chance
    ``prod_{i in m} (1 - x_i)``. Its removal polynomial is multiplied out into monomials, one a
    set of filters, whose coefficients are integers.
    """

    def __init__(self, counts: list[int], n: int):
        self.n, self.total = n, sum(counts)
        held = list(counts)
        for i in range(n):  # rows that fail every filter of a set
            for m in range(1 << n):
                if not m >> i & 1:
                    held[m] += held[m | 1 << i]
        self.coefficients = {m: held[m] * (-1) ** (m.bit_count() + 1) for m in range(1, 1 << n) if held[m]}
        corners = [self.coefficients.get(m, 0) for m in range(1 << n)]
        for i in range(n):  # a corner is the sum of the monomials within it
            for m in range(1 << n):
                if m >> i & 1:
                    corners[m] += corners[m ^ 1 << i]
        self.corners = corners

    def removed(self, applied: int) -> int:
        """The polynomial at a corner: rows that any filter of a set removes."""
        return self.corners[applied]

    def survivors(self, applied: int) -> int:
        return self.total - self.corners[applied]

    def partial(self, i: int) -> dict[int, int]:
        """The partial derivative by ``x_i``, as monomials."""
        return {m ^ 1 << i: c for m, c in self.coefficients.items() if m >> i & 1}

    def shapley(self, i: int) -> Fraction:
        """The integral of the partial derivative along the diagonal from 0 to 1."""
        return sum((Fraction(c, m.bit_count() + 1) for m, c in self.partial(i).items()), Fraction(0))


def report(total: list[int], good: list[int], toxic: list[int], names: str = FILTERS) -> Iterable[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders.

    ``shapley`` is scaled by the number of orders, which makes it the integer sum over them.
    """
    n = len(names)
    every, (all_, good_, toxic_) = (1 << n) - 1, [Removal(c, n) for c in (total, good, toxic)]
    fails = [all_.removed(1 << i) for i in range(n)]
    unique = [all_.removed(every) - all_.removed(every ^ 1 << i) for i in range(n)]
    share = [all_.shapley(i) * math.factorial(n) for i in range(n)]
    assert all(s.denominator == 1 for s in share)
    for order in itertools.permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            now = before | 1 << i
            removed, good_lost, toxic_lost = (p.removed(now) - p.removed(before) for p in (all_, good_, toxic_))
            yield "".join(names[j] for j in order), step, all_.survivors(now), removed, fails[i] - removed, unique[i], good_lost, toxic_lost, int(share[i])
            before = now


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, sha, mask): the bits of the filters A to D that each text fails, and its digest.

    A: under 100 words; B: distinct words under 80 % of words; C: capitals A-Z over 10 % of code
    points; D: any of ``#$%&*|``. Words are runs of other than the space and the five ASCII controls
    TAB..CR; a null text is empty; a null part is the empty string.
    """

    def work(part: pa.RecordBatch) -> dict:
        sha, mask = [], []
        points = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_pylist()
        for size, text in zip(points, pc.cast(part.column("text"), pa.binary()), strict=True):
            text = text.as_py() or b""
            words = text.split()  # white space of bytes is exactly these six
            capitals = len(text) - len(text.translate(None, CAPITALS))
            fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * size, SYMBOL.search(text) is not None)
            mask.append(sum(1 << i for i, f in enumerate(fails) if f))
            sha.append(hashlib.sha256(text).digest())
        return {"id": part.column("id"), "part": part.column("part"), "sha": sha, "mask": mask}

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(text_col).alias("text"))
    return common.map_parts(rows, lambda: work, "id long, part string, sha binary, mask int")


def mask_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", copies_bit: int = 4) -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and failure mask, with the copies' filter added.

    A row fails it if a smaller id has the same text anywhere in the table. Rows that repeat an id
    and text are one copy; rows without an id are never found to be one, nor make others one. Rows
    are counted by text, part and id first and by text and part then, so a text of very many copies
    is one row a part before its least id is asked for. A document is good or toxic if any row
    of ``labels`` with its id says so.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    one = rows.groupBy("id", "sha", "part", "mask").agg(F.count("*").alias("n"))
    # rows without an id have no labels: they are spread by their text
    turn = F.when(F.col("id").isNull(), F.crc32("sha")).otherwise(F.lit(0))
    one = one.withColumn("turn", turn).join(marks.withColumn("turn", F.lit(0).cast("long")), ["id", "turn"], "left")
    good, toxic = F.coalesce("good", F.lit(0)) * F.col("n"), F.coalesce("toxic", F.lit(0)) * F.col("n")
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", good.alias("good"), toxic.alias("toxic"))))
    unnamed = lambda c: F.sum(F.when(F.col("id").isNull(), c).otherwise(F.lit(0)))
    texts = one.groupBy("sha", "part", "mask").agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"), unnamed(F.col("n")).alias("free"), least.alias("least"))
    texts = texts.withColumn("first_id", F.min("least.id").over(Window.partitionBy("sha")))
    own = F.when(F.col("least.id") == F.col("first_id"), F.col("least"))
    stay = lambda c: F.coalesce(own[c], F.lit(0)) + (F.col("free") if c == "n" else F.lit(0))
    kinds = ("n", "good", "toxic")
    original = F.struct(F.col("mask").alias("mask"), *[stay(c).alias(c) for c in kinds])
    copies = F.struct((F.col("mask") + F.lit(1 << copies_bit)).alias("mask"), *[(F.col(c) - stay(c)).alias(c) for c in kinds])
    both = texts.select("part", F.explode(F.array(original, copies)).alias("r")).select("part", "r.*").where("n > 0")
    return both.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in kinds])


def interactions(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row a part, order of the filters and step, from (part, mask, n, good, toxic).

    A part's counts are at most one number a mask; its polynomials are formed in one task, parts
    are spread over all.
    """
    size = 1 << len(names)
    at = lambda c: F.map_from_entries(F.collect_list(F.struct("mask", c)))
    full = lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.element_at(c, m), F.lit(0).cast("long")))
    rows = counts.groupBy("part").agg(at("n").alias("n"), at("good").alias("good"), at("toxic").alias("toxic"))
    rows = rows.select("part", *[full(c).alias(c) for c in ("n", "good", "toxic")])
    made = math.factorial(len(names)) * len(names)
    ddl = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, ROWS // made)):
                some = batch.slice(at, max(1, ROWS // made)).to_pylist()
                found = [(r["part"], *row) for r in some for row in report(r["n"], r["good"], r["toxic"], names)]
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*found, strict=True)), strict=True)), schema=schema)

    return rows.mapInArrow(run, ddl)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every whole text is judged by all filters (``text_failures``, and ``mask_counts`` for copies);
    counts of failure masks then give all orders exactly: survivors are values of the part's removal
    polynomial at corners, ``shapley`` integrates its partial derivatives with exact rationals, times
    120. Null texts are empty, null parts the empty string, null labels none; ties and repeated rows
    count as often as they occur; other columns are ignored; an empty table gives an empty result.
    """
    return interactions(mask_counts(text_failures(docs, id_col, text_col, part_col), labels, id_col))

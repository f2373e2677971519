"""Corpus preparation: quality rules, exact and near duplicates, source mixing, packing.

Every stage takes ``documents`` rows with any further columns, reads whole texts, and gives an empty
table for an empty one. Texts stay where they are read: a stage finds the ids that go, or a small
plan, and rows are filtered by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.llm import common, exact_dedup, ngram_join, packing, quality_rules, source_mixing


def _rows(docs: DataFrame, **more) -> DataFrame:
    """The rows as one struct ``row`` beside ``id`` and other columns, so that no name of theirs clashes."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col("doc_id").alias("id"), *[c.alias(name) for name, c in more.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rejected ones go. Row by row, no shuffle.

    Null and empty texts fail the base rule. Equal texts are judged alike, with an id or without.
    """
    return docs.where(quality_rules.kept_column(F.col("text")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id; of rows repeated with one doc_id, one.

    A row without a doc_id stays only where no row of its text has one: one row a text. Null and
    empty texts are equal.
    """
    sha = F.when(F.col("doc_id").isNull(), F.col("text_sha256")).alias("sha")
    found = exact_dedup.exact_dedup(docs, keep="min")
    found = common.materialize(found.groupBy("doc_id", sha).agg(F.min("kept").alias("kept"), F.count("*").alias("n")), "pipeline-exact")
    gone = common.small(found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("id")))
    again = found.where("doc_id is not null and kept and n > 1").select(F.col("doc_id").alias("id"))
    rows = _rows(docs).where("id is not null").join(gone, "id", "left_anti")
    if not again.isEmpty():
        again = common.small(again)
        rows = rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").dropDuplicates(["id"]))
    loose = found.where("doc_id is null and kept").select("sha")
    if not loose.isEmpty():
        unnamed = _rows(docs.where("doc_id is null"), sha=F.sha2(common.lower_az(F.col("text")), 256))
        rows = rows.unionByName(unnamed.join(common.small(loose), "sha", "left_semi").dropDuplicates(["sha"]).drop("sha"))
    return rows.select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by near-equal shingle sets.

    Texts without words stay. Rows without a doc_id stay, as the join's result can't name them;
    rows repeated with one doc_id stay or go together.
    """
    gone = ngram_join.ngram_join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    gone = common.small(common.materialize(gone, "pipeline-near"))
    return _rows(docs).join(gone, "id", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; one without a doc_id is drawn by its text.

    Documents without words go; repeated rows are taken together.
    """
    return source_mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; repeated rows are packed as often as they occur.

    A null or empty text is the end token alone; a null doc_id stays null in its pieces.
    """
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: The line field and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each one's rows are written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

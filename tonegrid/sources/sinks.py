"""Results as JSON, text and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import file_rows


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_each(results: DataFrame, path: str, key: str = "signal_id") -> None:
    """A JSON file for each row in a folder, which is replaced: named by the stem of its key, as a path.

    Rows with one stem are told apart by eight digits of their whole key's digest. Files appear
    together when all are written, and then ``_SUCCESS``.
    """
    last = F.element_at(F.split(F.col(key).cast("string"), "/"), -1)
    stem = F.regexp_replace(last, r"(?s)(.)\.[^.]*$", "$1")
    rows = json_row(results, key).select(F.col(key).cast("string").alias("key"), stem.alias("stem"), "json")
    shared = rows.groupBy("stem").agg(F.count("*").alias("n"))
    mark = F.when(F.col("n") > 1, F.concat(F.lit("-"), F.substring(F.sha2("key", 256), 1, 8))).otherwise(F.lit(""))
    named = rows.join(shared, "stem").select(F.concat("stem", mark, F.lit(".json")).alias("name"), F.col("json").cast("binary").alias("content"))
    file_rows.write_files(named, path)


def json_row(results: DataFrame, key: str = "signal_id") -> DataFrame:
    """(key, json): a row's other columns as one JSON document; nulls are kept."""
    body = F.to_json(F.struct(*[c for c in results.columns if c != key]), {"ignoreNullFields": "false"})
    return results.select(key, body.alias("json"))


def write_onsets(onsets: DataFrame, path: str) -> None:
    """CSV with a header: signal_id, onset_time to six decimals."""
    rows = onsets.select("signal_id", F.format_string("%.6f", F.col("t")).alias("onset_time"))
    rows.sort("signal_id", "onset_time").write.mode("overwrite").option("header", True).csv(path)


def page(array: Column, offset: Column | int, most: int) -> Column:
    """``most`` elements from ``offset``; an offset beyond the end leaves the array as it is."""
    return F.when(F.size(array) > offset, F.slice(array, scalar.col(offset) + 1, most)).otherwise(array)


def next_cursor(array: Column, offset: Column | int, most: int) -> Column:
    """Where the next page of an array begins, null if this is the last."""
    return F.when(F.size(array) > offset + most, (scalar.col(offset) + most).cast("string"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """(signal_id, line): the text form of a summary."""
    lines = F.array(
        F.format_string("Duration: %.2f seconds", "duration"),
        F.format_string("Sample Rate: %d Hz", "sample_rate"),
        F.format_string("Peak: %.3f", "peak_amplitude"),
        F.format_string("RMS: %.3f", "rms_level"),
        F.format_string("Dynamic Range: %.1f dB", "dynamic_range"),
    )
    return summary.select("signal_id", F.explode(lines).alias("line"))

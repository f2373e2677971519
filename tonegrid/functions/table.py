"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_frames(spark: SparkSession, name: str = "frames") -> None:
    """``LATERAL frames(samples, width, hop)``: (frame_idx, frame) of the whole frames of an array.

    A SQL function of the session: Spark inlines it, so frames stay in the JVM and the plan is that
    of ``layout.frames_of_arrays``. Arrays shorter than a frame, and null ones, have none.
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(samples ARRAY<DOUBLE>, width INT, hop INT)
        RETURNS TABLE (frame_idx BIGINT, frame ARRAY<DOUBLE>)
        RETURN SELECT CAST(pos AS BIGINT), slice({name}.samples, start + 1, {name}.width)
            FROM LATERAL posexplode(CASE WHEN size({name}.samples) >= {name}.width THEN sequence(0, size({name}.samples) - {name}.width, {name}.hop) END) AS p(pos, start)""")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than space and the five ASCII controls TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of ids (some tens of bytes a row) may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts that a function gets at once; Spark's own Arrow batches hold at most 64 MB.
PART_BYTES = 8 << 20
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without one gets a temporary folder (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tonegrid-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(found.get()).rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


class Scratch:
    """The tables of one run of an operator, in a folder of the shared one that goes when the run ends.

    What the operator returns must not read them: it is written by ``materialize`` inside the block.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.made = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        return _written(df, f"{self.path}/{self.made:03d}-{name}")

    def drop(self, name: str) -> None:
        """Delete the tables written under a name that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*-{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in files.globStatus(path):
            files.delete(found.getPath(), True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count; for a narrow table that has already been materialised."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_az(col: Column) -> Column:
    """Lower-case A-Z only; null becomes empty. Pure ASCII takes the cheaper built-in."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of ``name kind, ...``; a kind may be ``array<kind>``."""
    kind = lambda k: pa.list_(kind(k[6:-1])) if k.startswith("array<") else KINDS[k]
    return pa.schema([(name, kind(k)) for name, k in (c.split() for c in ddl.split(", "))])


def slices(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes, one row at least."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_parts(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str, most: int = PART_BYTES) -> DataFrame:
    """Rows through Arrow, a part at a time: ``make()`` gives a task its function of a part to columns.

    Columns that a function passes on stay as they are in Arrow, so ids of 64 bits beside nulls
    lose nothing, and no setting of the session is needed.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, most):
                yield pa.RecordBatch.from_pydict(work(part), schema=schema)

    return rows.mapInArrow(run, ddl)


def texts_of(part: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a column one by one; null is empty."""
    return (x.as_py() or "" for x in part.column(column))


def bytes_of(part: pa.RecordBatch, column: str) -> Iterator[bytes]:
    return (x.as_py() for x in part.column(column))


def longs_of(part: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of longs without nulls, as numpy."""
    return part.column(column).to_numpy(zero_copy_only=False)

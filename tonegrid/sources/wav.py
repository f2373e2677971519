"""WAV files as signals, and signals as WAV files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar

#: What is assumed where a header doesn't say.
DEFAULT_RATE, DEFAULT_CHANNELS = 44100, 2
SCHEMA = "path string, sample_rate int, channels int, samples array<float>, error string"
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def data_chunk(head: bytes) -> tuple[int, int, tuple[int, int, int, int]]:
    """(place, size) of a file's samples from its first bytes, and (format, channels, rate, bits) where they are 16-bit or float."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, layout = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt ":
            layout = struct.unpack_from("<HHIIHH", head, at + 8)
            if layout[0] == EXTENSIBLE and size >= 40:
                layout = (struct.unpack_from("<H", head, at + 32)[0], *layout[1:])
        elif name == b"data":
            break
        at += 8 + size + size % 2
    if layout is None or at + 8 > len(head):
        raise ValueError("no fmt or data chunk")
    kind, channels, rate, _, _, bits = layout
    if (kind, bits) not in ((PCM, 16), (FLOAT, 32)):
        raise ValueError(f"Unsupported sample format: {bits} bits, format {kind}")
    return at + 8, size, (kind, channels or DEFAULT_CHANNELS, rate or DEFAULT_RATE, bits)


def samples_of(data: bytes, kind: int) -> np.ndarray:
    """The samples of a part of a data chunk; a part of a sample at its end is left out."""
    width = 2 if kind == PCM else 4
    data = data[: len(data) // width * width]
    return np.frombuffer(data, dtype="<i2").astype(np.float32) / np.float32(32767) if width == 2 else np.frombuffer(data, dtype="<f4")


def decode(content: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, interleaved samples) of a WAV file with 16-bit or float samples; a cut file gives what it has."""
    at, size, (kind, channels, rate, _) = data_chunk(content)
    return rate, channels, samples_of(content[at : at + size], kind)


def encode(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file with 32-bit float samples."""
    data = np.asarray(samples, dtype="<f4").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, FLOAT, channels, rate, rate * channels * 4, channels * 4, 32)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(data)) + b"WAVE" + head + b"data" + struct.pack("<I", len(data)) + data


def decode_rows(files: DataFrame) -> DataFrame:
    """(path, sample_rate, channels, samples, error) from (path, format, content), a row a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path_, format_, content in zip(batch["path"], batch["format"], batch["content"], strict=True):
                try:
                    if format_ != "Wav":
                        raise ValueError(f"Unsupported format: {format_}")
                    out.append((path_, *decode(bytes(content)), None))
                except (ValueError, struct.error) as e:
                    out.append((path_, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "channels", "samples", "error"]).astype({"sample_rate": "Int32", "channels": "Int32"})

    return files.select("path", "format", "content").mapInPandas(run, SCHEMA)


def read_audio(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, format, sample_rate, channels, samples, duration, modificationTime, length, error): one row a file.

    Files that can't be decoded (other formats have no decoder here) keep their row, with an error and
    null samples. A file is one row, as the format holds at most 4 GB; files are read where Spark reads.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("format", scalar.audio_format("path"))
    out = decode_rows(files).join(files.select("path", "format", "modificationTime", "length"), "path")
    duration = F.size("samples") / (F.col("sample_rate") * F.col("channels"))
    return out.withColumn("duration", F.when(F.col("error").isNull(), duration))


def mono(audio: DataFrame) -> DataFrame:
    """(signal_id, sample_rate, pos, x): the mean of the channels; a short last frame is divided by all channels."""
    at = audio.where("error is null").select(F.col("path").alias("signal_id"), "sample_rate", "channels", F.posexplode("samples").alias("i", "v"))
    one = at.where("channels = 1").select("signal_id", "sample_rate", F.col("i").cast("long").alias("pos"), F.col("v").cast("double").alias("x"))
    many = at.where("channels > 1").groupBy("signal_id", "sample_rate", F.floor(F.col("i") / F.col("channels")).alias("pos"))
    return one.unionByName(many.agg((F.sum(F.col("v").cast("double")) / F.first("channels")).alias("x")))


def mono_blocks(blocks: DataFrame) -> DataFrame:
    """The same from blocks of whole frames (``file_rows.read_blocks``): inside each block, without a shuffle."""
    c = F.col("channels")
    frames = F.sequence(F.lit(0), F.ceil(F.size("samples") / c).cast("int") - 1)
    mean = F.transform(frames, lambda i: F.aggregate(F.slice("samples", i * c + 1, c), F.lit(0.0), lambda s, v: s + v) / c)
    at = blocks.where("error is null and size(samples) > 0").select(F.col("path").alias("signal_id"), "sample_rate", (F.col("first") / c).cast("long").alias("begin"), F.posexplode(mean).alias("i", "x"))
    return at.select("signal_id", "sample_rate", (F.col("begin") + F.col("i")).alias("pos"), "x")


def channel(audio: DataFrame, index: int) -> DataFrame:
    """(signal_id, sample_rate, samples) of one channel, of files that have it."""
    picked = F.filter("samples", lambda _, i: i % F.col("channels") == index)
    return audio.where(F.col("channels") > index).select(F.col("path").alias("signal_id"), "sample_rate", picked.alias("samples"))


def to_wav(signals: DataFrame, rate: int, channels: int = 1) -> DataFrame:
    """(signal_id, content): each row's samples (of several channels in turn) as a file of 32-bit floats."""

    @F.pandas_udf("binary")
    def write(samples: pd.Series) -> pd.Series:
        return samples.map(lambda s: encode(np.asarray(s), rate, channels))

    return signals.select("signal_id", write("samples").alias("content"))

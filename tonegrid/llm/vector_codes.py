"""Codes of vectors by product quantisation, with Exponion search for the nearest entries."""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components up to this size have squared distances and products below 2^53 for 2^5 of them, exact in doubles.
EXACT = 1 << 22
#: Scaled components from this size on are not taken as 64-bit integers.
LARGEST = 1 << 62
#: Distances that are held at a time: points by neighbours.
CELLS = 1 << 20
#: Tasks that a label's rows are dealt to where the sums of labels can't be broadcast.
SALTS = 32


@dataclass
class Codebooks:
    """The entries of each part position (rows of integers), and how many components a vector has."""

    parts: list[np.ndarray]
    dim: int

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(x) for part in self.parts for entry in part.tolist() for x in entry).encode()).hexdigest()


def points_of(part: pa.RecordBatch, dim: int) -> np.ndarray:
    """The rows of the column ``v`` of a part as a matrix of 64-bit integers."""
    return part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, dim)


def codes_of(part: pa.RecordBatch, n_parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(common.bytes_of(part, "code")), dtype="<u2").reshape(part.num_rows, n_parts).astype(np.int64)


class Exponion:
    """The nearest entry of a codebook, from each point's previous entry.

    With ``u`` the distance of a point from its previous entry ``a``, an entry at most as far as
    ``a`` is within ``2 u`` of ``a``. So the entries sorted by their distance from ``a`` are scanned
    up to squared distance ``4 u^2``; nothing beyond can be nearer, nor equally near. All distances
    are exact integers: doubles hold them below 2^53, Python's integers beyond.
    """

    def __init__(self, entries: np.ndarray):
        self.largest = int(np.abs(entries).max(initial=0))
        self.entries = entries
        self.apart = self._squares(entries, entries)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.apart, self.order, axis=1)

    @staticmethod
    def _kind(*values: np.ndarray):
        size = max((int(np.abs(v).max(initial=0)) for v in values), default=0)
        width = max(v.shape[1] for v in values)
        return np.float64 if size < EXACT and width <= 32 else object

    def _squares(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Squared distances of all rows of x from all of y."""
        kind = self._kind(x, y)
        x, y = x.astype(kind), y.astype(kind)
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]

    def nearest(self, points: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point; ties go to the lower entry."""
        kind = self._kind(points, self.entries)
        points, entries = points.astype(kind), self.entries.astype(kind)
        start = ((points - entries[previous]) ** 2).sum(1)
        code, best = previous.copy(), start.copy()
        by_entry = np.argsort(previous, kind="stable")
        for group in np.split(by_entry, np.flatnonzero(np.diff(previous[by_entry])) + 1):
            if not len(group):
                continue
            a = previous[group[0]]
            reach = np.searchsorted(self.sorted[a], 4 * start[group], side="right")
            turn = np.argsort(reach, kind="stable")
            group, reach = group[turn], reach[turn]
            # points of like reach are scanned together: twice the least at most, and a bounded number of cells
            at = 0
            while at < len(group):
                end = min(np.searchsorted(reach, 2 * reach[at], side="right"), at + max(1, CELLS // len(entries)))
                seen, near = group[at:end], self.order[a, : reach[end - 1]]
                far = self._squares(points[seen], entries[near])
                least = far.min(axis=1)
                code[seen] = np.where(far == least[:, None], near[None, :], len(entries)).min(axis=1)
                best[seen] = least
                at = end
        return code, best


def _assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, v, code, error): every part at its nearest entry, searched from the one in ``code``."""
    parts, dim = books.parts, books.dim
    width = dim // len(parts)

    def make():
        search = [Exponion(p) for p in parts]

        def work(part: pa.RecordBatch) -> dict:
            points, previous = points_of(part, dim), codes_of(part, len(parts))
            found = [s.nearest(points[:, i * width : (i + 1) * width], previous[:, i]) for i, s in enumerate(search)]
            codes = np.stack([code for code, _ in found], axis=1).astype("<u2")
            errors = [sum(map(int, row)) for row in zip(*[best.tolist() for _, best in found], strict=True)]
            same = {name: part.column(name) for name in ("vec_id", "label", "v")}
            return same | {"code": [row.tobytes() for row in codes], "error": [e if e < 1 << 63 else None for e in errors]}

        return work

    return common.map_parts(rows.select("vec_id", "label", "v", "code"), make, "vec_id long, label string, v array<long>, code binary, error long")


def _sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, s0, s1, ...): counts and component sums of what each entry has; at most a row an entry leaves a task."""
    sizes, dim = [len(p) for p in books.parts], books.dim
    width = dim // len(sizes)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((k, width), dtype=object) for k in sizes]
        counts = [np.zeros(k, dtype=np.int64) for k in sizes]
        for batch in batches:
            for part in common.slices(batch):
                points, codes = points_of(part, dim), codes_of(part, len(sizes))
                if np.abs(points).max(initial=0) >= 1 << 40:  # sums of a part might pass 64 bits
                    points = points.astype(object)
                for i, k in enumerate(sizes):
                    added = np.zeros((k, width), dtype=points.dtype)
                    np.add.at(added, codes[:, i], points[:, i * width : (i + 1) * width])
                    held[i] += added.astype(object)
                    counts[i] += np.bincount(codes[:, i], minlength=k)
        rows = [(i, j, int(counts[i][j]), [decimal.Decimal(x) for x in held[i][j]]) for i, k in enumerate(sizes) for j in range(k) if counts[i][j]]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    found = rows.select("v", "code").mapInArrow(run, "part int, entry int, n long, s array<decimal(38,0)>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)])


def _first(rows: DataFrame, n_parts: int, size: int) -> Codebooks:
    """The parts of the vectors with the smallest ids: ``size`` rows come to the driver, whatever the table."""
    least = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).select("v").collect()]
    dim = len(least[0]) if least else 0
    if dim % n_parts:
        raise ValueError(f"vectors of {dim} components have no {n_parts} equal parts")
    points = np.array([v for v in least if len(v) == dim], dtype=np.int64).reshape(-1, dim) if dim else np.zeros((len(least), 0), dtype=np.int64)
    width = dim // n_parts
    return Codebooks([points[:, i * width : (i + 1) * width] for i in range(n_parts)], dim)


def _moved(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry at its points' componentwise floor of the mean; unused ones stay. One row an entry comes to the driver."""
    parts = [p.copy() for p in books.parts]
    width = books.dim // len(parts)
    for r in sums.collect():
        parts[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return Codebooks(parts, books.dim)


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks): one row per usable vector: id, label, ``code`` (binary, 16-bit little-endian indexes in part order), ``error``.

    Rows whose vector is null or holds a null or a component that isn't finite are dropped. A
    component x is the integer floor(scale * x). Codebooks start as the parts of the vectors with
    the ``size`` smallest ids (a null id comes last, equal ids in the order of their vectors); with
    fewer rows there are fewer entries. Each round assigns every part to its nearest entry (ties to
    the lower index) and moves entries to the floor of their parts' mean; unused entries stay. Then
    parts are assigned once more; ``error`` sums the squared distances. All of it is exact. A vector
    of another length than that of the smallest id, or with scaled components of 2^62 or more, can't
    be compared: code and error are null. An error of 2^63 or more is null. Repeated rows and null
    ids and labels stay rows; other columns are ignored; an empty table gives an empty result.

    Each round reads and writes the rows once in the shared folder, as integers with the entry each
    part had, and aggregates its sums there; nothing else is shuffled, and a lost executor repeats
    tasks of one round. The driver holds the codebooks alone.
    """
    spark, v = vectors.sparkSession, F.col(vec_col).cast("array<double>")
    fit = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    small = F.forall("v", lambda x: F.abs(x * F.lit(float(scale))) < float(LARGEST))
    with common.Scratch(spark, "codes") as scratch:
        rows = kept.where(small).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
        books = _first(rows, n_parts, size)
        rows = rows.where(F.size("v") == books.dim).withColumn("code", F.lit(bytes(2 * n_parts)))
        for turn in range(rounds + 1):
            rows = scratch.write(_assign(rows, books), f"round{turn}")
            if turn:
                scratch.drop(f"round{turn - 1}")
            if turn < rounds:
                books = _moved(books, _sums(rows, books))
        odd = kept.where(~small | (F.size("v") != books.dim)).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        out = rows.select("vec_id", "label", "code", "error").unionByName(odd)
        out = out.select(F.col("vec_id").alias(id_col), F.col("label").cast(vectors.schema[label_col].dataType).alias(label_col), "code", "error")
        return common.materialize(out, "codes-result"), books


def with_label_error(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``: the errors of all rows with an equal label, nulls together; null where all of them are, or their sum passes 64 bits.

    Labels are summed with map-side combination. The sums are broadcast up to a bound of rows;
    beyond it a label's rows are dealt to ``SALTS`` tasks, each with its own copy of the sums.
    """
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy(F.col(label_col).alias("of")).agg(F.when(total.between(-(2**63), 2**63 - 1), total).cast("long").alias("label_error"))
    same = F.col(label_col).eqNullSafe(F.col("of"))
    if sums.count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), same, "left").drop("of")
    copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("turn", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, same & (F.col("turn") == F.col("salt")), "left").drop("of", "turn", "salt")

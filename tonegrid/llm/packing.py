"""Bounded-space best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_ENCODERS: dict[str, Encoder] = {}


class Encoder(dict):
    """Ids of a byte-level BPE vocabulary by ``tokenizers``, remembered for each word of the vocabulary's pattern.

    Merges never cross the pattern's words, so a text's ids are those of its words one after the
    other. Texts with an added token's name are encoded whole. The memory has a bound of words.
    """

    MOST = 600_000

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.model, self.words = Tokenizer.from_file(path), regex.compile(pattern).findall
        self.merge = self.model.model.tokenize
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        # the vocabulary spells printable bytes as themselves, and the others, in order, by the characters from 256
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.spelling = {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        spelt = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spelling)
        ids = np.array([t.id for t in self.merge(spelt)], dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(name in text for name in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.words(text)))


def encoder(path: str, pattern: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, pattern)
    return _ENCODERS[path]


def public_files() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.PATTERN


def cut(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, files: tuple[str, str]) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): the pieces of every document, remainder first.

    ``row`` numbers the pieces: the task's number and the place there.
    """

    def make():
        enc, at = encoder(*files), itertools.count(TaskContext.get().partitionId() << 34)

        def work(part: pa.RecordBatch) -> dict:
            owner, rows = [], []
            for i, text in enumerate(common.texts_of(part)):
                ids = enc.ids(text) + end_id.to_bytes(4, "little")
                start, total = 0, len(ids) // 4
                for piece in range(-(-total // capacity)):
                    n = total % capacity or capacity if start == 0 else capacity
                    owner.append(i)
                    rows.append((next(at), piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            row, piece, start, length, crc = zip(*rows, strict=True)
            return {"row": row, "doc_id": part.column("doc_id").take(pa.array(owner)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_parts(rows, make, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A fixed number of open bins, found by a bitset whose bit ``i`` says that some bin has ``i`` free.

    An item goes to the fullest bin that holds it (the lowest set bit at or above its size). Without
    one a new bin opens; when all slots are taken the fullest bin closes first.
    """

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots = capacity, slots
        self.bits, self.free, self.open, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item of that size."""
        fits = self.bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(room)
        else:
            if self.open >= self.slots:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            bin_, room, self.next, self.open = self.next, self.capacity, self.next + 1, self.open + 1
        left = room - size
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return bin_, self.capacity - room

    def _take(self, room: int) -> int:
        bins = self.free[room]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        return bin_

    def still_open(self) -> dict[int, int]:
        """Used space of the bins that are open at the end."""
        return {b: self.capacity - room for room, bins in enumerate(self.free) for b in bins}


def by_slot(rows: DataFrame, work: Callable[[pa.Table], dict], ddl: str) -> DataFrame:
    """``work`` over all rows of each slot; rows lie sorted by slot, and several slots may share a partition."""
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                edges = (np.flatnonzero(np.diff(common.longs_of(batch, "slot"))) + 1).tolist()
                for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                    if b > a:
                        yield batch.slice(a, b - a)

        for _, group in itertools.groupby(parts(), key=lambda x: x.column("slot")[0].as_py()):
            yield from pa.Table.from_pydict(work(pa.Table.from_batches(list(group)).combine_chunks()), schema=schema).to_batches()

    return rows.mapInArrow(run, ddl)


def packed(sizes: list[int], capacity: int, slots: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, left) of each item in turn; ``left`` is the used space of a bin that is open at the end, else 0."""
    bins = OpenBins(capacity, slots)
    at = np.array([bins.put(n) for n in sizes], dtype=np.int64).reshape(-1, 2)
    used = np.zeros(bins.next + 1, dtype=np.int64)
    for b, n in bins.still_open().items():
        used[b] = n
    return base + at[:, 0], at[:, 1], used[at[:, 0]]


def pack(pieces: DataFrame, capacity: int, slots: int, rows_per_task: int) -> DataFrame:
    """Adds sequence_id and offset. Tasks pack the pieces hashed to them on their own, in order of
    a hash; the bins that they leave open (``slots`` at most) are items of a second pass of the same
    kind, whose tasks each take the leftovers of many, so nothing but ends of the second pass
    stays unfilled."""
    tasks = max(1, -(-pieces.count() // rows_per_task))

    def first(part: pa.Table) -> dict:
        bin_, offset, left = packed(part["length"].to_pylist(), capacity, slots, part["slot"][0].as_py() << 40)
        return {"row": part["row"], "bin": bin_, "offset": offset, "left": left}

    rows = pieces.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(tasks)).alias("slot"))
    rows = rows.repartition(tasks, "slot").sortWithinPartitions("slot", F.xxhash64("row", F.lit(1)), "row")
    placed = common.materialize(by_slot(rows, first, "row long, bin long, offset long, left long"), "pack-first")

    groups = max(1, -(-tasks * slots // rows_per_task))

    def second(part: pa.Table) -> dict:
        bin_, offset, _ = packed(part["left"].to_pylist(), capacity, slots, (part["slot"][0].as_py() << 40) | (1 << 39))
        return {"bin": part["bin"], "sequence_id": bin_, "shift": offset}

    ends = placed.where("left > 0").select("bin", "left").distinct().withColumn("slot", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    ends = ends.repartition(groups, "slot").sortWithinPartitions("slot", F.xxhash64("bin", F.lit(1)), "bin")
    moved = common.materialize(by_slot(ends, second, "bin long, sequence_id long, shift long"), "pack-second")
    placed = placed.join(common.small(moved), "bin", "left").select(
        "row", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
    return pieces.join(placed, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit_pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    slots: int = 64,
    rows_per_task: int = 50_000,
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is that id alone. Whole texts are
    encoded, however long; documents longer than ``capacity`` are cut, and the first piece takes
    the remainder. Repeated rows are packed as often as they occur; a null id stays null. Other
    columns are ignored. Empty table: empty result. Only piece lengths move between tasks; an
    executor's loss repeats its tasks with the same outcome, as order and slots are hashes.
    """
    pieces = common.materialize(cut(docs, id_col, text_col, capacity, end_id, files or public_files()), "pack-pieces")
    return pack(pieces, capacity, slots, rows_per_task)

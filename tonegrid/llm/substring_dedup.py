"""Removal of byte strings that occur again anywhere in the corpus, by suffix sorting of shards.

Each window of ``length`` bytes has an anchor, the 32-byte gram in it whose hash is least: equal
windows have equal anchors at the same place. Anchors cut texts into segments, and segments are
dealt to shards such that equal windows of two of them meet. Shards are suffix-sorted by induction
in external memory; what goes is read off the common prefixes of neighbours.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .induced_sort import repeated_starts
from .ngram_join import mix

GRAM = 32
CHUNK = 4 << 20
#: Pieces into which a range of window starts is cut where too many segments agree on it.
WAYS = 14
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-byte grams, by doubling."""
    h, span = _TABLE[data], 1
    while span < GRAM:
        h = h[:-span] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * span) + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    return mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by prefix and suffix minima of blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.append(x, np.full(-len(x) % w, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, lo, hi, place): every window start lies in one [lo, hi] whose windows share the anchor at ``place``."""
    out = []
    for at in range(0, len(data) - length + 1, chunk):
        part = data[at : at + chunk + length - 1]
        h = gram_hashes(part)
        low = np.uint64((1 << 24) - 1)
        best = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        place = (best & low).astype(np.int64)
        lo = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        out.append((h[place[lo]], lo + at, np.append(lo[1:] - 1, len(place) - 1) + at, place[lo] + at))
    if not out:
        return np.empty(0, dtype=np.uint64), *(np.empty(0, dtype=np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def segments(rows: DataFrame, length: int) -> DataFrame:
    """(gram, key, left, right, node, lo, size) of every anchor of every text.

    A segment is the window starts ``lo`` to ``lo + size - 1`` that share the anchor, and ``key``
    digests its bytes. A window reaches over at least half of what it holds besides the gram on one
    side of it, so two segments have an equal window only if those bytes agree to the left or to
    the right: ``left`` and ``right`` are their checksums, null where no window of the segment
    reaches so far.
    """
    half = (length - GRAM) // 2
    names = ("gram", "key", "left", "right", "node", "lo", "size")

    def work(part: pa.RecordBatch) -> dict:
        out = []
        for node, text in zip(common.longs_of(part, "node").tolist(), common.texts_of(part), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            gram, *places = anchors(np.frombuffer(raw, dtype=np.uint8), length)
            for g, a, b, at in zip(gram.view(np.int64).tolist(), *(x.tolist() for x in places), strict=True):
                left = zlib.crc32(raw[at - half : at]) if at - half >= a else None
                right = zlib.crc32(raw[at + GRAM : at + GRAM + half]) | 1 << 32 if at + GRAM + half <= b + length else None
                out.append((g, hashlib.blake2b(raw[a : b + length], digest_size=16).digest(), left, right, node, a, b - a + 1))
        return dict(zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True))

    return common.map_parts(rows, lambda: work, "gram long, key binary, left long, right long, node long, lo long, size int")


def with_cuts(rows: DataFrame, wanted: DataFrame, columns: tuple[str, ...], scratch: common.Scratch) -> DataFrame:
    """(node, text, cuts): the texts in ``wanted``, each with the list of its rows there."""
    named = scratch.write(wanted.groupBy("node").agg(F.collect_list(F.struct(*columns)).alias("cuts")), "cuts")
    texts = rows.join(common.small(named.select("node")), "node", "left_semi").dropDuplicates(["node"]).join(named, "node")
    return texts.select("node", "text", "cuts")


def cut_segments(rows: DataFrame, wanted: DataFrame, length: int, scratch: common.Scratch) -> DataFrame:
    """(gram, key, size, sides, segment): the bytes of the segments named by (gram, key, sides, node, lo, size)."""
    texts = with_cuts(rows, wanted, ("gram", "key", "sides", "lo", "size"), scratch)

    def work(part: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("gram", "key", "size", "sides", "segment")}
        for text, cuts in zip(common.texts_of(part), part.column("cuts"), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for c in cuts.as_py():
                for name in ("gram", "key", "size", "sides"):
                    out[name].append(c[name])
                out["segment"].append(raw[c["lo"] : c["lo"] + c["size"] - 1 + length])
        return out

    return common.map_parts(texts, lambda: work, "gram long, key binary, size int, sides array<long>, segment binary")


def cut_pieces(rows: DataFrame, wanted: DataFrame, length: int, scratch: common.Scratch) -> DataFrame:
    """(gram, key, piece, side, node, lo, size, shift, low, high) of the segments (gram, key, node, lo, size, low, high).

    A piece is the window starts of a segment that lie ``low`` to ``high`` bytes before its gram, a
    part of the range asked for. It starts ``shift`` after the segment, ``piece`` digests its bytes,
    and ``side`` those that all windows of the range have in common.
    """
    texts = with_cuts(rows, wanted, ("gram", "key", "lo", "size", "low", "high"), scratch)
    names = ("gram", "key", "piece", "side", "node", "lo", "size", "shift", "low", "high")

    def work(part: pa.RecordBatch) -> dict:
        out = []
        for node, text, cuts in zip(common.longs_of(part, "node").tolist(), common.texts_of(part), part.column("cuts"), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, dtype=np.uint8)
            for c in cuts.as_py():
                first, last = c["lo"], c["lo"] + c["size"] - 1
                # all windows of a segment hold its gram, and their anchor is where it is first
                place = first + int((gram_hashes(data[first : last + length]).view(np.int64) == c["gram"]).argmax())
                step = -(-(c["high"] - c["low"] + 1) // WAYS)
                for low in range(c["low"], c["high"] + 1, step):
                    high = min(low + step - 1, c["high"])
                    a, b = max(first, place - high), min(last, place - low)
                    if a <= b:
                        salt = low.to_bytes(8, "little") + high.to_bytes(8, "little")
                        piece = hashlib.blake2b(raw[a : b + length], digest_size=16, salt=salt).digest()
                        side = hashlib.blake2b(raw[place - low : place - high + length], digest_size=8, salt=salt).digest()
                        side = int.from_bytes(side, "little", signed=True)
                        out.append((c["gram"], c["key"], piece, side, node, a, b - a + 1, a - first, low, high))
        return dict(zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True))

    ddl = "gram long, key binary, piece binary, side long, node long, lo long, size int, shift int, low int, high int"
    return common.map_parts(texts, lambda: work, ddl)


class Shard:
    """The segments of a shard in unnamed files of the task: their bytes, one apart, and marks of the window starts."""

    def __init__(self):
        self.bytes, self.marks, self.grams, self.keys, self.bases, self.n = tempfile.TemporaryFile(), tempfile.TemporaryFile(), [], [], [], 0

    def add(self, gram: int, key: bytes, size: int, segment: bytes) -> None:
        if self.grams and (self.grams[-1], self.keys[-1]) == (gram, key):
            return  # it is there for its other side
        self.grams.append(gram)
        self.keys.append(key)
        self.bases.append(self.n)
        self.bytes.write(segment + b"\0")
        self.marks.write(b"\1" * size + b"\0" * (len(segment) + 1 - size))
        self.n += len(segment) + 1

    def runs(self, length: int, budget: int) -> dict:
        """The segments with a window that occurs again, and the runs of such window starts, as first and last."""
        self.bytes.flush()
        self.marks.flush()
        data, marks = np.memmap(self.bytes, dtype=np.uint8, mode="r"), np.memmap(self.marks, dtype=bool, mode="r")
        hit = repeated_starts(data, marks, length, budget)
        bases = np.array(self.bases, dtype=np.int64)
        owner = np.searchsorted(bases, hit, "right") - 1
        at = hit - bases[owner]
        new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(at) != 1)) + 1
        by: dict[int, list[list[int]]] = {}
        if len(hit):
            for i, j in zip(np.append(0, new), np.append(new - 1, len(hit) - 1), strict=True):
                by.setdefault(int(owner[i]), []).append([int(at[i]), int(at[j])])
        return {"gram": [self.grams[o] for o in by], "key": [self.keys[o] for o in by], "runs": list(by.values())}


def sort_shards(dealt: DataFrame, length: int, shards: int, budget: int) -> DataFrame:
    """(gram, key, runs) of the segments with a window that another segment has, from (shard, gram, key, size, segment).

    A shard's segments stream into the task's files and are sorted there, so a shard may be far
    larger than a task's memory. A segment may come out of two shards.
    """
    ddl = "gram long, key binary, runs array<array<int>>"
    schema = common.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            for i, number in enumerate(common.longs_of(batch, "shard").tolist()):
                if number != now:
                    if shard is not None:
                        yield pa.RecordBatch.from_pydict(shard.runs(length, budget), schema=schema)
                    now, shard = number, Shard()
                shard.add(*(batch.column(c)[i].as_py() for c in ("gram", "key", "size", "segment")))
        if shard is not None:
            yield pa.RecordBatch.from_pydict(shard.runs(length, budget), schema=schema)

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "gram", "key").mapInArrow(run, ddl)


def merge(spans: list, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    shard_bytes: int = 8 << 20,
    budget: int = 96 << 20,
    split_from: int = 2000,
    most: int = 2000,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a ``length``-byte string of the input that also starts elsewhere, in the
    same text or another, is removed; strings are judged on the input and do not cross texts.
    Texts of ``length`` bytes or more that occur twice go whole. Null and empty texts have no
    bytes; whole texts are read, however long. Repeated rows are copies of each other; a null id is
    a document as any other. Ids are taken as unique but for repeated rows. Other columns are
    ignored. Empty table: empty result. The kept bytes may split a code point where a repeated
    string does.

    Segments of one gram meet in one shard, or in one for each side of theirs where the gram has more
    than ``split_from``. Where more than ``most`` segments agree on a side, they are cut into pieces by the distance of
    windows from the gram, and pieces take the place of segments. Texts are known as copies by SHA-256, segments and
    pieces by 128-bit digests; all other strings are compared byte by byte in the sorter.
    """
    with common.Scratch(docs.sparkSession, "substring") as scratch:
        return common.materialize(_dedup(docs, scratch, id_col, text_col, length, shard_bytes, budget, split_from, most), "substring-result")


def _repeated(single: DataFrame, distinct: DataFrame, scratch: common.Scratch, length: int, shard_bytes: int, budget: int, split_from: int, most: int) -> DataFrame:
    """(gram, key, runs) of the segments with a window that a segment of another key has.

    ``distinct``: (gram, key, node, lo, size, ways), one of each kind of segment. ``ways``: its sides,
    each with the least and the greatest number of bytes before the gram of the windows it is for.
    """
    spark = single.sparkSession
    # bytes are fetched only where others of the gram agree on a side
    sides = distinct.select("gram", "key", F.explode("ways").alias("way")).select("gram", "key", "way.*").where("side is not null")
    agreed = sides.groupBy("gram", "side").agg(F.count("*").alias("c"), F.min("low").alias("low"), F.min("high").alias("high"))
    agreed = scratch.write(agreed.where("c > 1"), "agreed")
    crowded = (F.col("c") > most) & (F.col("low") < F.col("high"))
    few, crowds = agreed.where(~crowded).select("gram", "side"), agreed.where(crowded).select("gram", "side")
    asked = scratch.write(sides.select("gram", "key", "side").join(few, ["gram", "side"]).groupBy("gram", "key").agg(F.collect_list("side").alias("sides")), "asked")
    # segments with an equal window agree on a side, so a gram of very many segments is split by their sides
    many = asked.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > split_from).select("gram", F.lit(True).alias("many"))
    asked = asked.join(many, "gram", "left").select("gram", "key", F.when(F.col("many"), F.col("sides")).otherwise(F.array(F.lit(0).cast("long"))).alias("sides"))
    wanted = scratch.write(distinct.join(asked, ["gram", "key"]).select("gram", "key", "sides", "node", "lo", "size"), "wanted")

    volume = wanted.agg(F.sum((F.col("size") + length) * F.size("sides"))).first()[0] or 0
    shards = max(1, -(-volume // shard_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    flagged = []
    if volume:
        dealt = cut_segments(single, wanted, length, scratch).withColumn("side", F.explode("sides"))
        dealt = dealt.select(F.pmod(F.xxhash64("gram", "side"), F.lit(shards)).alias("shard"), "gram", "key", "size", "segment")
        flagged.append(sort_shards(dealt, length, shards, budget))
    if not crowds.isEmpty():
        # a crowd on one side doesn't meet: windows of one distance from the gram do, range by range
        crowd = sides.join(common.small(crowds), ["gram", "side"]).select("gram", "key", "low", "high")
        crowd = scratch.write(crowd.join(distinct.select("gram", "key", "node", "lo", "size"), ["gram", "key"]), "crowd")
        pieces = scratch.write(cut_pieces(single, crowd, length, scratch), "pieces")
        one = F.min(F.struct("node", "lo", "size", "side", "low", "high")).alias("one")
        kinds = scratch.write(pieces.groupBy("gram", "piece").agg(one, F.count("*").alias("n")), "kinds")
        kinds = kinds.select("gram", F.col("piece").alias("key"), "n", "one.*").withColumn("ways", F.array(F.struct("side", "low", "high")))
        found = _repeated(single, kinds, scratch, length, shard_bytes, budget, 0, most)  # a piece has one side: no need to meet others of its gram
        sure = kinds.where("n > 1").select("gram", "key", F.array(F.array(F.lit(0), F.col("size") - 1)).alias("runs"))
        found = common.small(scratch.write(found.unionByName(sure).withColumnRenamed("key", "piece"), "found"))
        back = pieces.select("gram", "key", "piece", "shift").join(found, ["gram", "piece"])
        shifted = F.transform("runs", lambda r: F.array(r[0] + F.col("shift"), r[1] + F.col("shift")))
        flagged.append(back.select("gram", "key", shifted.alias("runs")))
    if not flagged:
        return spark.createDataFrame([], "gram long, key binary, runs array<array<int>>")
    return functools.reduce(DataFrame.unionByName, flagged)


def _dedup(docs: DataFrame, scratch: common.Scratch, id_col: str, text_col: str, length: int, shard_bytes: int, budget: int, split_from: int, most: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    base = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    base = scratch.write(base, "base")
    groups = base.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))
    groups = scratch.write(groups.withColumn("node", F.coalesce("first", F.xxhash64("sha"))), "groups")
    copied = common.small(scratch.write(groups.where("copies > 1").select("sha", "first", "node"), "copied"))

    # one row of every text: of a group of copies the first, and any one where ids repeat
    single = rows.where(F.octet_length("text") >= length).withColumn("sha", F.sha2("text", 256))
    single = single.join(copied, "sha", "left").where("first is null or id <=> first")
    single = single.select(F.coalesce("node", "id", F.xxhash64("sha")).alias("node"), "text")

    found = scratch.write(segments(single, length), "segments")
    one = F.min(F.struct("node", "lo", "size", "left", "right")).alias("one")
    distinct = scratch.write(found.groupBy("gram", "key").agg(one, F.count("*").alias("n")), "distinct")
    distinct = distinct.select("gram", "key", "n", "one.*")
    # a window with more bytes left of its gram than right of it has its segment's left side, others the right one
    middle, most_left = length - GRAM - (length - GRAM) // 2, length - GRAM
    way = lambda side, low, high: F.struct(F.col(side).alias("side"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    ways = F.array(way("left", middle + 1, most_left), way("right", 0, middle))
    flagged = _repeated(single, distinct.withColumn("ways", ways), scratch, length, shard_bytes, budget, split_from, most)
    sure = distinct.where("n > 1").select("gram", "key", F.array(F.array(F.lit(0), F.col("size") - 1)).alias("runs"))
    # two equal windows never share a segment: they have different anchors
    flagged = scratch.write(flagged.unionByName(sure), "flagged")

    spans = found.select("gram", "key", "node", "lo").join(flagged, ["gram", "key"]).select("node", "lo", F.explode("runs").alias("run"))
    spans = spans.select("node", F.array(F.col("lo") + F.col("run")[0], F.col("lo") + F.col("run")[1] + length).alias("span"))
    spans = scratch.write(spans.groupBy("node").agg(F.collect_list("span").alias("spans")), "spans")

    def strip(part: pa.RecordBatch) -> dict:
        removed, runs_, kept_ = [], [], []
        for text_, spans_ in zip(common.texts_of(part), part.column("spans"), strict=True):
            raw = text_.encode("utf-8", "surrogatepass")
            runs = merge([tuple(s) for s in spans_.as_py()], len(raw))
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            removed.append(sum(b - a for a, b in runs))
            runs_.append(len(runs))
            kept_.append(kept.hexdigest())
        return {"node": part.column("node"), "removed": removed, "runs": runs_, "kept": kept_}

    hit = common.small(spans.select("node"))
    cut = single.join(hit, "node", "left_semi").join(spans, "node")
    cut = common.map_parts(cut, lambda: strip, "node long, removed long, runs long, kept string").dropDuplicates(["node"])
    cut = scratch.write(cut, "cut")
    out = base.join(groups.select("sha", "copies", "node"), "sha").join(cut, "node", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )

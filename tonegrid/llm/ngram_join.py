"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct word shingles. Sets of Jaccard similarity t or more differ in
few tokens, so two of them share a signature from short prefixes of their token orders: a single
token of the rare class, or a combination of k tokens of one group of a frequent class. The more
sets have a token, the greater its k.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import connected_components

#: Odd multipliers of the five places of a shingle, and of the final mixing.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Longs of a set's sketch, and the set size from which a wider one is kept beside it.
SKETCH, WIDE_FROM = 8, 600
MOST_COMBINED = 4


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer words are one shingle.

    Shingles are known by their hashes. Two of one pair of documents fall together by chance with
    probability n^2 / 2^64, which no size of the corpus raises.
    """
    # bytes are lower-cased and split by the ASCII rules that words are defined by
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(k, n)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total += h[i : n - k + 1 + i] * (PLACES[i % 5] + np.uint64(2 * (i // 5)))
    total = mix(total)
    total.sort()
    new = np.append(True, total[1:] != total[:-1])
    return total if new.all() else total[new]


@functools.lru_cache(maxsize=256)
def choices(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), dtype=np.int64).reshape(-1, k)


@dataclass(frozen=True)
class Plan:
    """percent: the threshold. frequent: number of sets from which a token is of a frequent class.

    bits: tokens are known by so many high bits, their cell. Cells fall into ``buckets`` ranges.
    """

    percent: int = 80
    frequent: int = 24
    bits: int = 32
    buckets: int = 64

    def errors(self, n: int) -> int:
        """Most tokens of a set of n that a partner may lack: n - ceil(t n)."""
        return n - -(-self.percent * n // 100)

    def band(self, n: int) -> int:
        """Size bands as wide as the threshold allows: partners lie in the same or the next one."""
        return int(math.log(n) / math.log(100 / self.percent) + 1e-9)

    def groups(self, band: int) -> int:
        """Groups of a frequent class in a band; 0: single tokens, as the sets are too small for combinations."""
        n = int((100 / self.percent) ** band)
        return 0 if n < 24 else max(1, n // 13)

    def classes(self, counts: np.ndarray) -> np.ndarray:
        """0: no other set has the token. 1: rare, indexed singly. k: indexed in combinations of k tokens."""
        out = np.minimum(counts, 2).astype(np.uint8) - 1
        limit = self.frequent
        for k in range(2, MOST_COMBINED + 1):
            out[counts >= limit] = k
            limit *= max(2, self.frequent)
        return out

    def signatures(self, cells: np.ndarray, classes: np.ndarray, lone: int, n: int) -> np.ndarray:
        """Signatures of a set of ``n`` tokens, of which ``lone`` are in no other set.

        ``cells`` are the others, ``classes`` theirs. Tokens stand in the order of class and cell,
        the lone ones first. A prefix covers as many errors as it has single tokens, and of each
        group of a class k all its tokens but k - 1; it ends where it covers one more than the set
        may have. Of two partners, the shorter prefix lies in the longer one, and one of its groups
        has k common tokens: both index that combination.
        """
        need = self.errors(n) + 1 - lone
        if need <= 0 or not len(cells):
            return np.empty(0, dtype=np.uint64)
        single = cells[classes == 1][:need]
        out, need = [mix(single)], need - len(single)
        if need > 0:
            often = classes > 1
            rest, k = cells[often], classes[often].astype(np.int64)
            order = np.lexsort((rest, k))
            rest, k = rest[order], k[order]
            top = self.band(n)
            for band in {top, top - 1} if top else {0}:
                g = self.groups(band)
                if not g or not len(rest):
                    out.append(mix(rest[:need]))
                    continue
                group = k * g + (rest % np.uint64(g)).astype(np.int64)
                by = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(group[by]) != 0))
                place = np.empty(len(rest), dtype=np.int64)
                place[by] = np.arange(len(rest)) - np.repeat(first, np.diff(np.append(first, len(rest))))
                upto = int(np.searchsorted(np.cumsum(place >= k - 1), need)) + 1
                by = by[by < upto]
                for a, b in _runs(group[by]):
                    part, size = rest[by[a:b]], int(k[by[a]])
                    if b - a >= size:
                        picked = part[choices(b - a, size)]
                        sig = np.full(len(picked), np.uint64(band * 8 + size))
                        for i in range(size):
                            sig = mix(sig + picked[:, i] * PLACES[i])
                        out.append(sig)
        return np.unique(np.concatenate(out))


def sketch(cells: np.ndarray, longs: int) -> np.ndarray:
    """Parities of the cells in ``64 * longs`` bits. The bits in which two sketches differ are at
    most as many as the cells that one set has and the other lacks."""
    at = (mix(cells + PLACES[4]) % np.uint64(64 * longs)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * longs) & 1).astype(np.uint8)).view("<i8")


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=chr(data[0]))


def _least_width(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype("B" if top < 1 << 8 else "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal neighbours."""
    edges = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
    return list(itertools.pairwise([0, *edges, len(keys)])) if len(keys) else []


def _deltas(values: np.ndarray) -> bytes:
    return _pack(_least_width(np.diff(values, prepend=np.uint64(0))))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def set_keys(rows: DataFrame, k: int) -> DataFrame:
    """(id, n, set_key): the size of each set, and a digest that equal sets share."""

    def work(part: pa.RecordBatch) -> dict:
        ns, keys = [], []
        for text in common.texts_of(part):
            tokens = shingles(text, k)
            ns.append(len(tokens))
            keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
        return {"id": part.column("id"), "n": ns, "set_key": keys}

    return common.map_parts(rows, lambda: work, "id long, n long, set_key binary")


def token_slices(rows: DataFrame, k: int, plan: Plan) -> DataFrame:
    """(slice, bucket, cells, counts, slots): the tokens of a slice of documents, by ranges of cells.

    A slice is what a task reads at once. ``cells`` has the distinct cells of a bucket in order,
    ``counts`` how many documents of the slice have each, ``slots`` which. Bucket -1 has the
    documents: ids and set sizes. A slice's number is its task's and its place there, so that a
    task which runs again makes the same slices.
    """
    per = np.uint64(plan.bits - int(math.log2(plan.buckets)))

    def make():
        numbers = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 24)

        def work(part: pa.RecordBatch) -> dict:
            number = next(numbers)
            sets = [shingles(t, k) for t in common.texts_of(part)]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            out = [(number, -1, _pack(common.longs_of(part, "id")), _pack(sizes), b"")]
            tokens = np.concatenate(sets) >> np.uint64(64 - plan.bits)
            slots = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, slots = tokens[order], _least_width(slots[order])
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, dtype=np.int64)
            cells, counts = tokens[first], _least_width(np.diff(np.append(first, len(tokens))))
            bucket = (cells >> per).astype(np.int64)
            for a, b in _runs(bucket):
                ends = first[a], first[b] if b < len(cells) else len(tokens)
                out.append((number, int(bucket[a]), _deltas(cells[a:b]), _pack(counts[a:b]), _pack(slots[ends[0] : ends[1]])))
            return dict(zip(("slice", "bucket", "cells", "counts", "slots"), zip(*out, strict=True), strict=True))

        return work

    return common.map_parts(rows, make, "slice long, bucket int, cells binary, counts binary, slots binary")


def token_classes(slices: DataFrame, plan: Plan) -> DataFrame:
    """(slice, bucket, classes): the class of each distinct cell of a slice, counted over all slices.

    A slice sends a cell once, with its count, so a token of very many documents costs a bucket
    one entry a slice.
    """

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells = [np.cumsum(_unpack(x), dtype=np.uint64) for x in group["cells"]]
        counts = np.concatenate([_unpack(x) for x in group["counts"]]).astype(np.int64)
        _, back = np.unique(np.concatenate(cells), return_inverse=True)
        classes = plan.classes(np.bincount(back, weights=counts).astype(np.int64))[back]
        parts = np.split(classes, np.cumsum([len(c) for c in cells])[:-1])
        return pd.DataFrame({"slice": group["slice"], "bucket": group["bucket"], "classes": [_pack(p) for p in parts]})

    asked = slices.where("bucket >= 0").select("slice", "bucket", "cells", "counts")
    return asked.groupBy("bucket").applyInPandas(work, "slice long, bucket int, classes binary")


SKETCHES = [f"s{i}" for i in range(SKETCH)]


def signed_sets(slices: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """(id, n, lone, s0.., wide, sigs) of every set that has a signature."""
    columns = ["id", "n", "lone", *SKETCHES, "wide", "sigs"]

    def work(key: tuple, group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answer = dict(zip(answers["bucket"], answers["classes"], strict=True))
        ids, sizes, parts = None, None, []
        for bucket, cells, counts, slots in zip(group["bucket"], group["cells"], group["counts"], group["slots"], strict=True):
            if bucket < 0:
                ids, sizes = _unpack(cells), _unpack(counts)
                continue
            counts = _unpack(counts)
            each = (np.repeat(x, counts) for x in (np.cumsum(_unpack(cells), dtype=np.uint64), _unpack(answer[bucket])))
            parts.append((*each, _unpack(slots).astype(np.int64)))
        out = []
        if parts:
            cells, kinds, slots = (np.concatenate(x) for x in zip(*parts, strict=True))
            lone = np.bincount(slots[kinds == 0], minlength=len(ids))
            # a set whose lone tokens alone are more than a partner may lack has no partner
            may = np.array([plan.errors(int(n)) for n in sizes]) >= lone
            held = (kinds > 0) & may[slots]
            cells, kinds, slots = cells[held], kinds[held], slots[held]
            order = np.lexsort((cells, slots))
            cells, kinds, slots = cells[order], kinds[order], slots[order]
            new = np.append(True, (slots[1:] != slots[:-1]) | (cells[1:] != cells[:-1])) if len(cells) else np.empty(0, dtype=bool)
            cells, kinds, slots = cells[new], kinds[new], slots[new]
            for a, b in _runs(slots):
                slot = slots[a]
                n = int(sizes[slot])
                sigs = plan.signatures(cells[a:b], kinds[a:b], int(lone[slot]), n)
                if len(sigs):
                    wide = sketch(cells[a:b], 1 << math.ceil(math.log2(n / 32))) if n > WIDE_FROM else None
                    out.append((int(ids[slot]), n, int(lone[slot]), *sketch(cells[a:b], SKETCH).tolist(), wide, sigs.view("<i8")))
        return pd.DataFrame(out, columns=columns)

    ddl = f"id long, n long, lone long, {', '.join(f'{s} long' for s in SKETCHES)}, wide array<long>, sigs array<long>"
    return slices.groupBy("slice").cogroup(classes.groupBy("slice")).applyInPandas(work, ddl)


def may_link(percent: int, a: str, b: str) -> Column:
    """Sizes and sketches allow the pair to reach the threshold; false only by proof.

    Sets of similarity t differ in at most (n_a + n_b)(1 - t)/(1 + t) tokens. Lone tokens are
    among those, and so are at least as many others as sketches have different bits.
    """
    c = lambda side, name: F.col(f"{name}_{side}")
    sizes = F.lit(100) * F.least(c(a, "n"), c(b, "n")) >= F.lit(percent) * F.greatest(c(a, "n"), c(b, "n"))
    differ = lambda bits: (c(a, "lone") + c(b, "lone") + bits) * (100 + percent) <= (c(a, "n") + c(b, "n")) * (100 - percent)
    bits = functools.reduce(lambda x, y: x + y, [F.bit_count(c(a, s).bitwiseXOR(c(b, s))) for s in SKETCHES])
    half = F.least(F.size(c(a, "wide")), F.size(c(b, "wide")))
    fold = lambda w: F.when(F.size(w) > half, F.zip_with(F.slice(w, 1, half), F.slice(w, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(w)
    wide = F.aggregate(F.zip_with(fold(c(a, "wide")), fold(c(b, "wide")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    either = c(a, "wide").isNull() | c(b, "wide").isNull()
    return sizes & differ(bits) & F.when(either, F.lit(True)).otherwise(differ(wide))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of similarity ``percent`` or more, by their whole sets (id, tokens)."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("tokens").alias(f"tokens_{s}"))

    def work(part: pa.RecordBatch) -> dict:
        good = []
        for x, y in zip(common.bytes_of(part, "tokens_a"), common.bytes_of(part, "tokens_b"), strict=True):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            same = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * same >= percent * (len(x) + len(y) - same))
        kept = pa.array(good, pa.bool_())
        return {"a": part.column("a").filter(kept), "b": part.column("b").filter(kept)}

    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "tokens_a", "tokens_b")
    return common.map_parts(both, lambda: work, "a long, b long")


STATE = ["id", "n", "lone", "component", *SKETCHES, "wide"]


def _side(lists: DataFrame, s: str) -> DataFrame:
    return lists.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in STATE])


def _star_pairs(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """For every set the partner, among the leaders of its signatures, that leads most of them.

    A signature's leader is one of its sets, another one each turn. One candidate a set keeps the
    pairs linear in the sets whatever the size of a group of copies.
    """
    first = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
    leaders = lists.groupBy("sig").agg(F.min(F.struct(first.alias("h"), *STATE)).alias("l")).select("sig", "l.*")
    pairs = _side(lists, "b").join(_side(leaders, "a"), "sig")
    pairs = pairs.where("component_a <> component_b").where(may_link(percent, "a", "b"))
    counted = pairs.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.count("*").alias("shared"))
    return counted.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    frequent: int = 24,
    turns: int = 3,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Words are runs of non-white-space after lower-casing A-Z; documents link when 100 times the
    intersection of their shingle sets is at least ``percent`` times the union. Equal sets are one
    node of the graph. Candidates that share a signature are first checked against leaders (one
    each a turn), whose links make components; then every candidate pair that still joins
    two components is checked, so no link between components is lost. Links inside a component
    are not enumerated. Null, empty and wordless texts have n_shingles 0 and are their own
    component; whole texts count, however long; repeated rows share a component; rows with a null
    id take part as copies only when an id shares their set. Ids are taken as unique but for
    repeated rows. Other columns are ignored. Empty table: empty result.
    """
    spark = docs.sparkSession
    with common.Scratch(spark, "jaccard") as scratch:
        return common.materialize(_join(docs, scratch, id_col, text_col, k, percent, frequent, turns), "jaccard-result")


def _join(docs: DataFrame, scratch: common.Scratch, id_col: str, text_col: str, k: int, percent: int, frequent: int, turns: int) -> DataFrame:
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    base = scratch.write(set_keys(texts, k), "base")
    nodes = base.where("n > 0").groupBy("set_key").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = scratch.write(nodes, "nodes")
    named = base.where("n > 0 and id is not null")
    extra = scratch.write(named.join(nodes.where("copies > 1"), "set_key").where("id <> node").select("id").distinct(), "copies")
    again = scratch.write(named.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "again")

    rows = texts.where("id is not null")
    few = extra.count() <= common.BROADCAST_ROWS
    rows = rows.join(F.broadcast(extra) if few else extra, "id", "left_anti")
    if not again.isEmpty():
        again = common.small(again)
        rows = rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").dropDuplicates(["id"]))
        few = False
    if not few:  # texts that had to move are written, so that they move once
        rows = scratch.write(rows, "rows")

    total = base.agg(F.sum("n")).first()[0] or 1
    buckets = 1 << max(6, math.ceil(math.log2(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total / 2_000_000))))
    plan = Plan(percent, frequent, min(60, max(32, math.ceil(math.log2(total)) + 6)), buckets)
    slices = scratch.write(token_slices(rows, k, plan), "slices")
    classes = scratch.write(token_classes(slices, plan), "classes")
    signed = scratch.write(signed_sets(slices, classes, plan), "signed")
    sigs = signed.select("id", F.explode("sigs").alias("sig"))
    several = sigs.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("sig")
    lists = scratch.write(sigs.join(several, "sig", "left_semi"), "lists")
    state = common.small(signed.drop("sigs"), common.BROADCAST_ROWS // 10)

    def tokens(part: pa.RecordBatch) -> dict:
        return {"id": part.column("id"), "tokens": [shingles(t, k).tobytes() for t in common.texts_of(part)]}

    def linked(pairs: DataFrame) -> DataFrame:
        asked = scratch.write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
        sets = common.map_parts(rows.join(common.small(asked), "id", "left_semi"), lambda: tokens, "id long, tokens binary")
        return verify(pairs, sets, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    links = components = None
    open_ = lists.withColumn("component", F.col("id"))
    for turn in range(turns + 1):
        member = open_.join(state, "id").select("sig", *STATE)
        if turn < turns:
            pairs = _star_pairs(member, percent, turn)
        else:
            cross = _side(member, "a").join(_side(member, "b"), "sig").where("id_a < id_b and component_a <> component_b")
            pairs = cross.where(may_link(percent, "a", "b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        pairs = scratch.write(pairs, "pairs")
        if pairs.isEmpty():
            # leaders of other sizes give no pairs though others of their signature may: only the last turn is exact
            continue
        found = scratch.write(linked(pairs), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        components = scratch.write(connected_components(links, scratch), "components")
        if turn < turns:
            part = lists.join(components.withColumnRenamed("node", "id"), "id", "left")
            open_ = scratch.write(_open(part.withColumn("component", F.coalesce("component", "id"))), "open")
    out = base.join(nodes, "set_key", "left")
    if components is not None:
        out = out.join(components, "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    own = F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _open(member: DataFrame) -> DataFrame:
    """Only signatures whose sets lie in different components can still give a link."""
    several = member.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    return member.join(several, "sig", "left_semi")

"""Comparing fingerprints, and searching a collection of them."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import stage
from . import fingerprint, layout, pairwise

TIME, HZ, START = 0.1, 50.0, 1.0
PAIR = ("id_a", "id_b")
#: Candidates of a pair that one task decides; a pair with more is decided in rounds first.
AT_ONCE, ROUNDS = 20_000, 6
#: Prints on a feature's list from which the list is dealt to several tasks.
LONG_LIST = 100_000
#: Rows up to which a table of features or ids (some 40 bytes a row) is broadcast.
BROADCAST_ROWS = 500_000
#: Rows that joins of features form, as a share of all pairs of queries and prints, from which all pairs are scored directly.
JOINED = 0.01
#: Pairs that a task scores where all are scored, about.
TASK_PAIRS = 2_000_000
#: Rows of a kind of feature that a print has at most where all pairs are scored directly.
SHORT = 512
# What each score weighs, and the similarity from which a pair has a class.
WEIGHTS = {"spectral": 0.3, "landmark": 0.25, "perceptual": 0.2, "energy": 0.15, "temporal": 0.1}
CLASSES = ((0.95, "Identical"), (0.85, "VerySimilar"), (0.7, "Similar"), (0.5, "PartiallySimilar"))


@dataclass
class Fingerprints:
    """The tables of a collection's fingerprints, each keyed by signal_id.

    ``postings`` are (feature, signal_id) rows, as ``postings_of`` makes them or an index has them
    stored: then with ``bucket``, the feature modulo ``buckets``, by which its files lie in folders.
    """

    hashes: DataFrame
    landmarks: DataFrame
    meta: DataFrame
    subs: DataFrame
    postings: DataFrame | None = None
    buckets: int | None = None

    @classmethod
    def of(cls, crossed: DataFrame, spectra: DataFrame, rate: float, size: int, hop: int, bands: int = 32, seconds: float = 5.0, chunk: int = 1024) -> Fingerprints:
        meta = fingerprint.metadata(crossed, spectra, rate, size).join(fingerprint.perceptual_hash(crossed, spectra), "signal_id")
        return cls(fingerprint.spectral_hashes(spectra, rate, hop, bands), fingerprint.landmarks(spectra, rate, size, hop), meta, fingerprint.sub_fingerprints(crossed, rate, seconds, chunk))

    def tables(self) -> dict[str, DataFrame]:
        return {"hashes": self.hashes, "landmarks": self.landmarks, "meta": self.meta, "subs": self.subs}

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Fingerprints:
        """The same change made to every table; postings are made anew when asked for."""
        return Fingerprints(**{name: f(t) for name, t in self.tables().items()})


def _side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    return rows.select(F.col("signal_id").alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def _near(pairs: DataFrame, rows: DataFrame, row: str, equal: tuple[str, ...], extra: tuple[str, ...], time: str, tolerance: float) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a band join: rows of A meet rows of B in the same or a neighbouring slot of time.

    Slots make it an equality join, so no pair of rows further apart than two slots is ever formed.
    """
    slot = lambda t: F.floor(F.col(t) / F.lit(tolerance))
    a = pairs.join(_side(rows, "a", row, time, *equal, *extra), "id_a")
    a = a.withColumn("slot", F.explode(F.sequence(slot(f"{time}_a") - 1, slot(f"{time}_a") + 1)))
    b = _side(rows, "b", time, *equal, *extra).withColumn("slot", slot(f"{time}_b"))
    on = (a["id_b"] == b["id_b"]) & (a["slot"] == b["slot"]) & (F.abs(a[f"{time}_a"] - b[f"{time}_b"]) < tolerance)
    for c in equal:
        on = on & (a[f"{c}_a"] == b[f"{c}_b"])
    return a, b, on


def _share(pairs: DataFrame, rows: DataFrame, matched: DataFrame, name: str) -> DataFrame:
    """(pair, score): matched rows of A by the larger side's rows; 1 if both are empty, 0 if one is."""
    n = rows.groupBy("signal_id").agg(F.count("*").alias("n"))
    m = matched.groupBy(*PAIR).agg(F.count("*").alias("m"))
    out = pairs.join(_side(n, "a", "n"), "id_a", "left").join(_side(n, "b", "n"), "id_b", "left").join(m, list(PAIR), "left")
    both = F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    return out.select(*PAIR, F.when(both == 0, F.lit(1.0)).otherwise(F.coalesce("m", F.lit(0)) / both).alias(name))


def spectral_score(pairs: DataFrame, hashes: DataFrame, tolerance: float = TIME) -> DataFrame:
    """Share of A's hashes that B has within the tolerance."""
    a, b, on = _near(pairs, hashes, "frame_idx", ("hash",), (), "time", tolerance)
    return _share(pairs, hashes, a.join(b, on, "left_semi").select(*PAIR, "frame_idx_a").distinct(), "spectral")


def landmark_score(pairs: DataFrame, marks: DataFrame, tolerance: float = TIME, hz: float = HZ) -> DataFrame:
    """Share of A's landmarks that B has one of the same type near, in time and frequency."""
    a, b, on = _near(pairs, marks, "landmark", ("landmark_type",), ("frequency",), "time", tolerance)
    on = on & (F.abs(a["frequency_a"] - b["frequency_b"]) < hz)
    return _share(pairs, marks, a.join(b, on, "left_semi").select(*PAIR, "landmark_a").distinct(), "landmark")


def temporal_score(pairs: DataFrame, subs: DataFrame, tolerance: float = START) -> DataFrame:
    """Mean hash similarity of sub-fingerprints that start within a second of each other."""
    a, b, on = _near(pairs, subs, "sub", (), ("hash",), "start_time", tolerance)
    near = a.join(b, on).select(a["id_a"], a["id_b"], scalar.hamming_similarity(F.col("hash_a"), F.col("hash_b")).alias("s"))
    mean = near.groupBy(*PAIR).agg(F.avg("s").alias("s"))
    n = subs.groupBy("signal_id").agg(F.count("*").alias("n"))
    out = pairs.join(_side(n, "a", "n"), "id_a", "left").join(_side(n, "b", "n"), "id_b", "left").join(mean, list(PAIR), "left")
    none = F.col("n_a").isNull() & F.col("n_b").isNull()
    return out.select(*PAIR, F.when(none, F.lit(1.0)).otherwise(F.coalesce("s", F.lit(0.0))).alias("temporal"))


def meta_scores(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """(pair, perceptual, energy, shorter): bits of the perceptual hashes, closeness of mean levels, shorter duration."""
    columns = ("perceptual_hash", "avg_energy", "duration")
    both = pairs.join(_side(meta, "a", *columns), "id_a").join(_side(meta, "b", *columns), "id_b")
    most = F.greatest("avg_energy_a", "avg_energy_b")
    energy = F.coalesce(F.lit(1.0) - F.least(scalar.ratio(F.abs(F.col("avg_energy_a") - F.col("avg_energy_b")), most), F.lit(1.0)), F.lit(1.0))
    return both.select(*PAIR, scalar.hamming_similarity(F.col("perceptual_hash_a"), F.col("perceptual_hash_b")).alias("perceptual"), energy.alias("energy"), F.least("duration_a", "duration_b").alias("shorter"))


def profile_similarity(a: Column, b: Column) -> Column:
    """1 less the summed differences by the sums of two energy profiles, over their common length."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda p: F.slice(p, 1, F.greatest(n, F.lit(1)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    apart, both = total(F.zip_with(cut(a), cut(b), lambda x, y: F.abs(x - y))), total(F.zip_with(cut(a), cut(b), lambda x, y: x + y))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce(F.lit(1.0) - F.least(scalar.ratio(apart, both), F.lit(1.0)), F.lit(1.0)))


def segment_candidates(pairs: DataFrame, subs: DataFrame) -> DataFrame:
    """(pair, time_a, time_b, duration, quality): sub-fingerprints alike in hash and in energy profile."""
    columns = ("start_time", "duration", "hash", "energy_profile")
    both = pairs.join(_side(subs, "a", *columns), "id_a").join(_side(subs, "b", *columns), "id_b")
    both = both.withColumn("h", scalar.hamming_similarity(F.col("hash_a"), F.col("hash_b"))).where("h > 0.7D")
    both = both.withColumn("e", profile_similarity(F.col("energy_profile_a"), F.col("energy_profile_b"))).where("e > 0.6D")
    return both.select(*PAIR, F.col("start_time_a").alias("time_a"), F.col("start_time_b").alias("time_b"), F.least("duration_a", "duration_b").alias("duration"), ((F.col("h") + F.col("e")) / 2.0).alias("quality"))


def _priority() -> Column:
    """Better candidates have greater ones: by quality, then the earlier in A, then in B."""
    return F.struct("quality", (-F.col("time_a")).alias("a"), (-F.col("time_b")).alias("b"), (-F.col("duration")).alias("d"))


def _covered(candidates: DataFrame, by: DataFrame, side: str, width: float = START) -> DataFrame:
    """(pair, time, p): of each start of the candidates on a side, the greatest priority of those of ``by`` whose interval holds it.

    Intervals are joined to starts by slots of time; of intervals that begin and end together only the best is.
    """
    time = f"time_{side}"
    slot = lambda c: F.floor(c / F.lit(width))
    best = by.groupBy(*PAIR, F.col(time).alias("begin"), "duration").agg(F.max(_priority()).alias("p"))
    best = best.withColumn("slot", F.explode(F.sequence(slot(F.col("begin")), slot(F.col("begin") + F.col("duration")))))
    starts = candidates.select(*PAIR, time).distinct().withColumn("slot", slot(F.col(time)))
    inside = (F.col(time) >= F.col("begin")) & (F.col(time) < F.col("begin") + F.col("duration"))
    return starts.join(best, [*PAIR, "slot"]).where(inside).groupBy(*PAIR, time).agg(F.max("p").alias(f"p_{side}"))


def _with_covers(candidates: DataFrame, by: DataFrame, how: str) -> DataFrame:
    for side in ("a", "b"):
        candidates = candidates.join(_covered(candidates, by, side), [*PAIR, f"time_{side}"], how)
    return candidates


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """One pair's candidates, best first; each that stays rules out the later ones that start inside it."""
    rows = group.sort_values(["quality", "time_a", "time_b", "duration"], ascending=[False, True, True, True])
    a, b, d = (rows[c].to_numpy() for c in ("time_a", "time_b", "duration"))
    left, kept = np.ones(len(rows), dtype=bool), []
    while left.any():
        i = int(left.argmax())
        kept.append(i)
        left &= ~(((a >= a[i]) & (a < a[i] + d[i])) | ((b >= b[i]) & (b < b[i] + d[i])))
        left[: i + 1] = False
    return rows.iloc[kept]


def matched_segments(candidates: DataFrame, at_once: int = AT_ONCE, rounds: int = ROUNDS) -> DataFrame:
    """The candidates that stay when each, best first, goes if it starts inside one that stays, in A or in B.

    Of equal quality the earlier one is better; equal rows are one. A pair with more than ``at_once``
    candidates is decided in rounds of joins: what no better undecided candidate holds stays, and
    what a better staying one holds goes, so a pair is spread over its starts and slots of time.
    Candidates in chains (each held by the one before, as ties make them) might take a round each;
    after some ``rounds`` the best ``at_once`` of a pair are therefore decided by themselves in each
    further round, which is exact as a choice depends on better ones alone. Pairs with no more than
    that left are decided in one go.
    """
    schema = candidates.schema
    left, kept = stage.keep(candidates.dropDuplicates()), None
    for turn in itertools.count():
        most = left.groupBy(*PAIR).count().agg(F.max("count")).first()[0] or 0
        if most <= at_once:
            last = left.groupBy(*PAIR).applyInPandas(_choose, schema)
            return last if kept is None else kept.unionByName(last)
        if turn < rounds:
            best = _with_covers(left, left, "inner").where((_priority() == F.col("p_a")) & (_priority() == F.col("p_b")))
        else:
            order = Window.partitionBy(*PAIR).orderBy(_priority().desc())
            best = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= at_once).drop("r").groupBy(*PAIR).applyInPandas(_choose, schema)
        best = stage.keep(best.select(*schema.names))
        held = lambda side: F.coalesce(F.col(f"p_{side}") >= _priority(), F.lit(False))
        left = stage.keep(_with_covers(left, best, "left").where(~held("a") & ~held("b")).select(*schema.names))
        kept = best if kept is None else kept.unionByName(best)


def time_offset(matched: DataFrame) -> DataFrame:
    """(pair, n_segments, time_offset): the upper median of how much later matched segments lie in B."""
    offset = matched.select(*PAIR, (F.col("time_b") - F.col("time_a")).alias("time_offset"))
    return layout.index_percentiles(offset, "time_offset", {"time_offset": 50}, PAIR).withColumnRenamed("n", "n_segments")


def _judged(scores: DataFrame) -> DataFrame:
    """Adds similarity and match_type to the five scores of pairs."""
    total = scalar.clamp(sum((F.col(k) * F.lit(w) for k, w in WEIGHTS.items()), F.lit(0.0)))
    kind = F.lit("Different")
    for least, name in reversed(CLASSES):
        kind = F.when(F.col("similarity") > least, F.lit(name)).otherwise(kind)
    return scores.withColumn("similarity", total).withColumn("match_type", kind)


def score(pairs: DataFrame, prints: Fingerprints) -> DataFrame:
    """One row a pair: the five scores, the shorter duration, similarity and match_type."""
    scores = meta_scores(pairs, prints.meta)
    for part in (spectral_score(pairs, prints.hashes), landmark_score(pairs, prints.landmarks), temporal_score(pairs, prints.subs)):
        scores = scores.join(part, list(PAIR))
    return _judged(scores)


def _with_segments(scored: DataFrame, pairs: DataFrame, prints: Fingerprints) -> DataFrame:
    """Adds to scored pairs what their matched segments show: confidence, time_offset, n_segments."""
    matched = matched_segments(segment_candidates(pairs, prints.subs))
    middle = time_offset(matched)
    length = matched.groupBy(*PAIR).agg(F.sum("duration").alias("covered"))
    out = scored.join(middle, list(PAIR), "left").join(length, list(PAIR), "left")
    sure = F.coalesce(F.least(scalar.ratio(F.col("covered"), F.col("shorter")), F.lit(1.0)), F.lit(0.0))
    return out.select(*PAIR, "similarity", "match_type", *WEIGHTS, sure.alias("confidence"), "time_offset", F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def compare(pairs: DataFrame, prints: Fingerprints) -> DataFrame:
    """One row a pair: similarity, match_type, the five scores, confidence, time_offset, n_segments."""
    return _with_segments(score(pairs, prints), pairs, prints)


def near_hashes(queries: DataFrame, meta: DataFrame, bits: int = 2, pieces: int = 4, joined: float = JOINED) -> DataFrame:
    """(id_a, id_b): queries and rows whose perceptual hashes differ in at most ``bits`` bits.

    Of the hash's ``pieces`` one differs in at most ``bits // pieces`` bits. Pieces are joined by
    equality: a query has all values that near its own, a row has its own alone, so that rows
    aren't multiplied and few of them meet a query whatever their number. Where pieces are so common
    that these joins would form more rows than ``joined`` times all pairs, the pairs themselves are
    compared, each once: queries go to all tasks, or both sides in parts where queries are many.
    """
    width = 64 // pieces
    masks = [sum(1 << i for i in c) for n in range(bits // pieces + 1) for c in itertools.combinations(range(width), n)]
    piece = lambda h, i: F.call_function("shiftrightunsigned", h, F.lit(i * width)).bitwiseAND(F.lit((1 << width) - 1))
    places = lambda h, values: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), values(piece(h, i)).alias("v")) for i in range(pieces)]))
    nearby = lambda v: F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: v.bitwiseXOR(m))
    own = queries.select(F.col("signal_id").alias("id_a"), F.col("perceptual_hash").alias("ha")).distinct()
    others = meta.select(F.col("signal_id").alias("id_b"), F.col("perceptual_hash").alias("hb")).distinct()
    a = own.select("*", places(F.col("ha"), nearby).alias("p")).select("id_a", "ha", "p.i", F.explode("p.v").alias("v"))
    b = others.select("*", places(F.col("hb"), lambda v: v).alias("p")).select("id_b", "hb", "p.*")
    near = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= bits
    lists = b.groupBy("i", "v").agg(F.count("*").alias("n")).join(a.groupBy("i", "v").agg(F.count("*").alias("m")), ["i", "v"])
    rows, n = lists.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0, own.count()
    pairs = n * others.count()
    if rows <= joined * pairs:
        return a.join(b, ["i", "v"]).where(near).select(*PAIR).distinct()
    dealt = others.repartition(-(-pairs // (4 * TASK_PAIRS)), "id_b")
    own = F.broadcast(own) if n <= BROADCAST_ROWS else own.repartition(-(-n // BROADCAST_ROWS), "id_a")
    return dealt.crossJoin(own).where(near).select(*PAIR)


def _cell(kind: Column, time: Column, hz: Column) -> Column:
    return F.xxhash64(F.lit(1), kind, time, hz)


def _slot(c: str, width: float) -> Column:
    return F.floor(F.col(c) / F.lit(width))


def postings_of(prints: Fingerprints) -> DataFrame:
    """(feature, signal_id): the band hashes of a print, the cells of time and frequency of its landmarks by type, or that it has none.

    Features are 64-bit digests: two that fall together can only add candidates.
    """
    hashes = prints.hashes.select(F.xxhash64(F.lit(0), "hash").alias("feature"), "signal_id")
    cells = prints.landmarks.select(_cell(F.col("landmark_type"), _slot("time", TIME), _slot("frequency", HZ)).alias("feature"), "signal_id")
    bare = prints.meta.join(prints.landmarks.select("signal_id").distinct(), "signal_id", "left_anti").select(F.xxhash64(F.lit(2)).alias("feature"), "signal_id")
    return hashes.unionByName(cells).unionByName(bare).distinct()


def _query_features(queries: DataFrame, prints: Fingerprints) -> DataFrame:
    """(id_a, unit, weight, feature): what each hash and landmark of a query can add to a score, and the features that show it.

    A hash counts with its share of the query's rows, a landmark with one of the query's landmarks;
    the other side's rows can only lower that. A landmark is seen in its own and the neighbouring cells.
    """
    own = lambda t: t.join(queries.select("signal_id"), "signal_id", "left_semi")
    every = Window.partitionBy("signal_id")
    hashes = own(prints.hashes).groupBy("signal_id", "hash").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(every))
    feature = F.xxhash64(F.lit(0), "hash")
    hashes = hashes.select(F.col("signal_id").alias("id_a"), feature.alias("unit"), (F.col("c") / F.col("n") * F.lit(WEIGHTS["spectral"])).alias("weight"), feature.alias("feature"))
    marks = own(prints.landmarks).withColumn("n", F.count("*").over(every))
    near = F.array(*[_cell(F.col("landmark_type"), _slot("time", TIME) + i, _slot("frequency", HZ) + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    marks = marks.select(F.col("signal_id").alias("id_a"), F.col("landmark").cast("long").alias("unit"), (F.lit(WEIGHTS["landmark"]) / F.col("n")).alias("weight"), F.explode(F.array_distinct(near)).alias("feature"))
    bare = own(prints.meta).join(own(prints.landmarks).select("signal_id").distinct(), "signal_id", "left_anti")
    bare = bare.select(F.col("signal_id").alias("id_a"), F.lit(-1).cast("long").alias("unit"), F.lit(WEIGHTS["landmark"]).alias("weight"), F.xxhash64(F.lit(2)).alias("feature"))
    return hashes.unionByName(marks).unionByName(bare)


def _meet(asked: DataFrame, postings: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """The query features with every print on their lists. Lists beyond ``longest`` are dealt to several tasks, queries copied to each."""
    long_lists = counts.where(F.col("n") > longest).select("feature", F.ceil(F.col("n") / longest).cast("int").alias("deals"))
    n = long_lists.count()
    if not n:
        return asked.join(postings, "feature")
    long_lists = F.broadcast(long_lists) if n <= BROADCAST_ROWS else long_lists
    deals = F.coalesce("deals", F.lit(1))
    dealt = postings.join(long_lists, "feature", "left").withColumn("deal", F.pmod(F.xxhash64("signal_id"), deals).cast("int")).drop("deals")
    copied = asked.join(long_lists, "feature", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return copied.join(dealt, ["feature", "deal"]).drop("deal")


def _hash_slack(threshold: float, bits: int) -> float:
    """What hashes and landmarks must bring to the threshold where perceptual hashes aren't near."""
    return threshold - WEIGHTS["energy"] - WEIGHTS["temporal"] - WEIGHTS["perceptual"] * (1 - (bits + 1) / 64) - 1e-9


@dataclass
class _Asked:
    """Features that queries ask for, the posting lists and their lengths, and which units of a query are left out."""

    features: DataFrame
    postings: DataFrame
    counts: DataFrame
    units: DataFrame

    @classmethod
    def of(cls, q: DataFrame, prints: Fingerprints, slack: float) -> _Asked:
        asked = stage.keep(_query_features(q, prints))
        postings = postings_of(prints) if prints.postings is None else prints.postings
        if prints.buckets:  # only the folders that are asked for are opened: as many numbers as there are buckets at most
            opened = asked.select(F.pmod("feature", F.lit(prints.buckets)).cast("int").alias("b")).distinct().collect()
            postings = postings.where(F.col("bucket").isin([r["b"] for r in opened]))
        postings = postings.select("feature", "signal_id").join(asked.select("feature").distinct(), "feature", "left_semi")
        counts = stage.keep(postings.groupBy("feature").agg(F.count("*").alias("n")))
        length = asked.join(counts, "feature", "left").groupBy("id_a", "unit", "weight").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        order = Window.partitionBy("id_a").orderBy(F.col("n").desc(), "unit", "weight")
        upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return cls(asked, postings, counts, stage.keep(length.withColumn("upto", upto).withColumn("out", F.col("upto") < slack)))

    def rows(self) -> int:
        """Rows that the join of features and lists would form."""
        return self.units.where("not out").agg(F.sum("n")).first()[0] or 0


def _sharing_rows(q: DataFrame, hashes: DataFrame) -> int:
    """Rows that the join of the queries' hashes with all prints' would form."""
    pairs = hashes.select("signal_id", "hash").distinct()
    lists = pairs.groupBy("hash").agg(F.count("*").alias("n"))
    asked = pairs.join(q, "signal_id", "left_semi").groupBy("hash").agg(F.count("*").alias("m"))
    return asked.join(lists, "hash").agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0


def candidates(queries: DataFrame, prints: Fingerprints, threshold: float = 0.0, bits: int = 2, longest: int = LONG_LIST, asked: _Asked | None = None) -> DataFrame:
    """(id_a, id_b): what shares a band hash with a query, or nearly its perceptual hash, and may reach the threshold.

    The three scores beside those of hashes and landmarks add a known amount at most, and less where
    a pair isn't near in its perceptual hash. What is missing to the threshold, hashes and landmarks
    must bring. So a query's features on the longest lists are left out while together they bring
    less than that: a pair that shares no other feature can't reach the threshold, and is never
    formed. Pairs that are formed stay if the features they share, all those left out, and their own
    perceptual and energy scores reach it. No pair with a score of ``threshold`` is lost.
    """
    q = queries.select("signal_id")
    own = prints.hashes.join(q, "signal_id", "left_semi").select(F.col("signal_id").alias("id_a"), "hash").distinct()
    others = prints.hashes.select(F.col("signal_id").alias("id_b"), "hash")
    near = near_hashes(prints.meta.join(q, "signal_id", "left_semi"), prints.meta, bits)
    slack = _hash_slack(threshold, bits)
    if slack <= 0:
        return own.join(others.distinct(), "hash").select(*PAIR).unionByName(near).distinct()
    asked = asked or _Asked.of(q, prints, slack)
    left_out = asked.units.where("out").groupBy("id_a").agg(F.sum("weight").alias("rest"))
    features = asked.features.join(asked.units.where("not out").select("id_a", "unit"), ["id_a", "unit"], "left_semi")
    met = _meet(features, asked.postings, asked.counts, longest).withColumnRenamed("signal_id", "id_b")
    shared = met.groupBy(*PAIR, "unit").agg(F.max("weight").alias("weight")).groupBy(*PAIR).agg(F.sum("weight").alias("weight"))
    scored = shared.join(meta_scores(shared.select(*PAIR), prints.meta), list(PAIR)).join(left_out, "id_a", "left")
    most = F.col("weight") + F.coalesce("rest", F.lit(0.0)) + F.col("perceptual") * F.lit(WEIGHTS["perceptual"]) + F.col("energy") * F.lit(WEIGHTS["energy"]) + F.lit(WEIGHTS["temporal"])
    able = scored.where(most >= F.lit(threshold - 1e-9)).select(*PAIR)
    sharing = able.join(own, "id_a").join(others, ["id_b", "hash"], "left_semi").select(*PAIR)
    return sharing.unionByName(near).distinct()


def similar(queries: DataFrame, prints: Fingerprints, threshold: float = 0.5, longest: int = LONG_LIST, bits: int = 2, joined: float = JOINED) -> DataFrame:
    """(pair, five scores, shorter, similarity, match_type): candidates of the queries that reach the threshold.

    Where joins of features would form more rows than ``joined`` times all pairs, and no print is
    long, every pair is scored in blocks (``pairwise``) and only those that reach the threshold
    become rows: the same pairs with the same scores.
    """
    q = queries.select("signal_id").distinct()
    slack = _hash_slack(threshold, bits)
    asked = _Asked.of(q, prints, slack) if slack > 0 else None
    rows = asked.rows() if asked else _sharing_rows(q, prints.hashes)
    pairs = q.count() * prints.meta.count()
    if rows > joined * pairs:
        packed = stage.keep(pairwise.packed(prints.tables()).repartition(-(-pairs // TASK_PAIRS), "signal_id"))
        if (packed.agg(F.max(F.greatest(*[F.size(c) for c in pairwise.FEATURES]))).first()[0] or 0) <= SHORT:
            own = packed.join(q, "signal_id", "left_semi")
            return _judged(pairwise.scored(own, packed, WEIGHTS, threshold, pairwise.Limits(TIME, HZ, START, bits)))
    return score(stage.keep(candidates(q, prints, threshold, bits, longest, asked)), prints).where(F.col("similarity") >= threshold)


def search(queries: DataFrame, prints: Fingerprints, threshold: float = 0.5, longest: int = LONG_LIST) -> DataFrame:
    """Candidates of the queries that reach the threshold, scored as pairs; order by similarity, then id."""
    found = stage.keep(similar(queries, prints, threshold, longest))
    return _with_segments(found, found.select(*PAIR), prints)

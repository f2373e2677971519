"""What must hold for keys of any size: selection, scans, rounds, bounded search, the stored index, long tracks."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.functions import filters
from tonegrid.operators import layout, loudness, matching, pairwise, pitch, quality, segments, selection
from tonegrid.sources import print_index, stage


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


# selection


def test_index_percentiles_by_counting(spark):
    rng = random.Random(2)
    pool = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0 + 2**-52, -1.5, 1e300, -1e-300]
    rows = [(key, rng.choice(pool)) for key in ("a", None) for _ in range(301)]
    rows += [("b", rng.gauss(0, 1)) for _ in range(2000)] + [("c", 7.0), ("d", None)] + [("e", float(i)) for i in range(100)]
    percents = {"low": 10, "middle": 50, "high": 95, "last": 100}
    order = lambda v: (v is not None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v)
    same = lambda v: None if v is None else "nan" if math.isnan(v) else v + 0.0
    df = spark.createDataFrame(rows, "signal_id string, v double").repartition(5)
    want = {}
    for key in {k for k, _ in rows}:
        values = sorted((v for k, v in rows if k == key), key=order)
        n = len(values)
        want[key] = (n, *[same(values[min(n * p // 100, n - 1)]) for p in percents.values()])
    for bounded in (False, True):
        got = layout.index_percentiles(df, "v", percents, bounded=bounded).collect()
        assert {r["signal_id"]: (r["n"], *[same(r[c]) for c in percents]) for r in got} == want
    assert layout.index_percentiles(df.limit(0), "v", percents).collect() == []


def test_selection_spreads_one_signal(spark):
    """Values of one signal are never ordered, only counts of cells, 2^22 at most in a window."""
    df = spark.range(200_000).select(F.concat(F.lit("s"), F.col("id") % 1).alias("signal_id"), F.xxhash64("id").cast("double").alias("v"))
    out = layout.index_percentiles(df, "v", {"p": 30})
    windows = re.findall(r"windowspecdefinition\(([^)]*?), specified", plan_of(out))
    assert len(windows) == selection.LEVELS and all(re.search(r", p#\d+L ASC", w) for w in windows)
    assert sum("in_" in w for w in windows) == selection.LEVELS - 1  # the first level has the 2^20 cells of a key
    cells = df.select("signal_id", selection.order_pattern(F.col("v")).alias("p")).groupBy("signal_id", "p").count().withColumn("task", F.spark_partition_id())
    most = cells.groupBy("task").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert most[1] > 1 and most[0] < 120_000
    values = sorted(r["v"] for r in df.collect())
    assert out.first()["p"] == values[60_000]


# scans


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_running_count(spark, block):
    rng = random.Random(block)
    rows = [(k, p, rng.random() < 0.3) for k in ("x", "y", None) for p in sorted(rng.sample(range(60), 33))]
    got = layout.running_count(spark.createDataFrame(rows, "signal_id string, pos long, m boolean").repartition(3), F.col("m"), "n", block=block)
    seen, want = {}, []
    for k, p, m in rows:
        seen[k] = seen.get(k, 0) + m
        want.append((k, p, m, seen[k]))
    assert sorted(map(tuple, got.select("signal_id", "pos", "m", "n").collect()), key=str) == sorted(want, key=str)


def test_clipping_throughout(spark):
    """Runs cross blocks; a signal that clips throughout is ordered by its blocks."""
    n = 3 * layout.BLOCK + 10
    rows = spark.range(n).select(F.lit("all").alias("signal_id"), F.col("id").alias("pos"), F.lit(1.0).alias("x"))
    edge = layout.BLOCK
    other = [("some", p, -1.0) for p in [0, 1, edge - 1, edge, edge + 1, 2 * edge - 1, 2 * edge + 1]] + [("some", 5, 0.5)]
    rows = rows.unionByName(spark.createDataFrame(other, "signal_id string, pos long, x double"))
    out = quality.clip_regions(rows, 1.0)
    got = sorted((r["signal_id"], r["region"], r["start"], r["end"]) for r in out.collect())
    assert got == [("all", 1, 0.0, float(n)), ("some", 1, 0.0, 2.0), ("some", 2, edge - 1.0, edge + 2.0), ("some", 3, 2.0 * edge - 1, 2.0 * edge), ("some", 4, 2.0 * edge + 1, 2.0 * edge + 2)]
    for window in re.findall(r"windowspecdefinition\(([^)]*?), specified", plan_of(out)):
        assert "block" in window


def test_sections_cross_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("s", i, i * 0.5, 1.0, rng.choice([0.1, 0.15, 0.6]), 500.0, 0.1, 3.0, "Music", rng.choice(["Verse", "Verse", "Break"])) for i in range(300)]
    df = spark.createDataFrame(rows, "signal_id string, segment long, start_time double, duration double, energy double, spectral_centroid double, zcr double, dynamic_range double, content_type string, label string")
    whole = sorted(map(tuple, segments.sections(df).collect()))
    monkeypatch.setattr(segments, "BLOCK", 7)
    assert sorted(map(tuple, segments.sections(df).collect())) == whole
    runs, start = [], 0
    for i in range(1, 301):
        if i == 300 or rows[i][9] != rows[i - 1][9] or abs(rows[i][4] - rows[i - 1][4]) > 0.3:
            if i - start > 1:
                runs.append((start, i - start))
            start = i
    assert [(r[5], r[6]) for r in sorted(whole, key=lambda r: r[1])] == runs


# greedy choice


CANDIDATE = "id_a string, id_b string, time_a double, time_b double, duration double, quality double"


def brute_greedy(rows):
    kept = []
    for r in sorted(set(rows), key=lambda r: (r[0], r[1], -r[5], r[2], r[3], r[4])):
        inside = lambda k: k[:2] == r[:2] and (k[2] <= r[2] < k[2] + k[4] or k[3] <= r[3] < k[3] + k[4])
        if not any(inside(k) for k in kept):
            kept.append(r)
    return sorted(kept)


@pytest.mark.parametrize("at_once,rounds", [(100_000, 6), (4, 0), (4, 2), (0, 99)])
def test_greedy_in_rounds(spark, at_once, rounds):
    rng = random.Random(rounds)
    rows = [("a", b, rng.randrange(40) / 2, rng.randrange(40) / 2, rng.choice([0.5, 2.0, 3.5]), rng.choice([0.8, 0.85, rng.random()])) for b in "bcd" for _ in range(45)]
    rows += rows[:4] + [("t", "t", i / 2, i / 2, 5.0, 1.0) for i in range(12)]
    got = matching.matched_segments(spark.createDataFrame(rows, CANDIDATE).repartition(3), at_once, rounds)
    assert sorted(map(tuple, got.collect())) == brute_greedy(rows)


def test_greedy_of_one_large_pair(spark):
    """A pair of 100,000 candidates: rounds of joins leave few for one task."""
    i, j = F.col("id") % 400, F.floor(F.col("id") / 400)
    rows = spark.range(100_000).select(F.lit("a").alias("id_a"), F.lit("b").alias("id_b"), (i * 2.5).alias("time_a"), (j * 2.5).alias("time_b"), F.lit(5.0).alias("duration"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 10.0**9).alias("quality"))
    got = matching.matched_segments(rows, at_once=2_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, matching._choose(rows.toPandas()).itertuples(index=False)))


# bounded search and the stored index


def made_prints(spark, n=60, seed=3, common=None):
    rng = random.Random(seed)
    hashes, marks, meta, subs = [], [], [], []
    for s in range(n):
        like = rng.randrange(12)
        own = random.Random(like)
        for f in range(10):
            h = common if common is not None and f == 0 else own.randrange(40) if rng.random() < 0.8 else rng.randrange(1000)
            hashes.append((s, f, f * 0.09, h))
        for k in range(0 if s % 13 == 5 else 8):
            t, hz = own.randrange(10) * 0.1, own.randrange(20) * 40.0
            marks.append((s, k + 1, t + rng.random() * 0.05, hz + rng.random() * 20, 1.0, own.choice(["SpectralPeak", "OnsetEvent"])))
        word = own.getrandbits(63) ^ (rng.getrandbits(63) if rng.random() < 0.4 else 1 << rng.randrange(60))
        meta.append((s, word, 10.0, 0.5 + rng.random() * (2 if like % 2 else 0.1)))
        subs += [(s, k, k * 2.5, 5.0, own.getrandbits(63), [own.random() + 0.1 for _ in range(4)]) for k in range(3)]
    frame = spark.createDataFrame
    return matching.Fingerprints(
        frame(hashes, "signal_id long, frame_idx long, time double, hash long"),
        frame(marks, "signal_id long, landmark int, time double, frequency double, magnitude double, landmark_type string"),
        frame(meta, "signal_id long, perceptual_hash long, duration double, avg_energy double"),
        frame(subs, "signal_id long, sub long, start_time double, duration double, hash long, energy_profile array<double>"),
    )


def found_by(df):
    return sorted((r["id_a"], r["id_b"], round(r["similarity"], 9)) for r in df.collect())


@pytest.mark.parametrize("common", [None, 7])
def test_search_forms_few_pairs_and_loses_none(spark, common):
    prints = made_prints(spark, common=common)
    queries = prints.meta.where("signal_id % 7 = 0").select("signal_id")
    every = stage.keep(matching.candidates(queries, prints))
    scored = stage.keep(matching.compare(every, prints))
    for threshold in (0.5, 0.6, 0.8):
        want = found_by(scored.where(F.col("similarity") >= threshold))
        for longest in (3, 1000):
            assert found_by(matching.search(queries, prints, threshold, longest)) == want
        formed = matching.candidates(queries, prints, threshold).count()
        assert len(want) <= formed <= every.count()
    if common is not None:
        assert every.count() == queries.count() * prints.meta.count()
        assert matching.candidates(queries, prints, 0.8).count() < every.count() / 2


def test_search_of_all_pairs_equals_joins(spark, monkeypatch):
    """Where features are common, all pairs are scored in blocks of any size: same pairs, same doubles, no join of pairs."""
    prints = made_prints(spark, 24, common=7).map(stage.keep)
    bare = prints.map(lambda t: t.where("signal_id != 8"))  # a print without features
    odd = F.expr("case signal_id when 6 then null when 7 then 0.0 when 9 then double('NaN') else avg_energy end")
    prints = matching.Fingerprints(bare.hashes, bare.landmarks, prints.meta.withColumn("avg_energy", odd), bare.subs)
    queries = prints.meta.where("signal_id % 4 = 0 or signal_id in (6, 7, 9)").select("signal_id").repartition(2)
    exact = lambda df: sorted(tuple(r) for r in df.select(*matching.PAIR, "similarity", "match_type", *matching.WEIGHTS, "shorter").collect())
    for threshold, sizes in ((0.0, (8192,)), (0.6, (1, 7, 8192))):
        joins = matching.similar(queries, prints, threshold, joined=1e9)
        assert "MapInArrow" not in plan_of(joins)
        want = exact(joins)
        assert want
        for rows in sizes:
            monkeypatch.setattr(pairwise, "BLOCK_ROWS", rows)
            monkeypatch.setattr(pairwise, "QUERY_BYTES", 3000 if rows == 7 else 1 << 20)
            pairs = matching.similar(queries, prints, threshold)
            assert "MapInArrow" in plan_of(pairs) and "Join" not in plan_of(pairs)
            assert exact(pairs) == want


def test_near_hashes_with_common_pieces(spark, monkeypatch):
    """Where few pieces differ every pair is compared once, without rows a piece; where they differ joins are kept."""
    values = [(i % 3) << 48 | (i * 37) % 256 << 3 for i in range(90)]
    meta = stage.keep(spark.createDataFrame(list(enumerate(values)) + [(0, values[0])], "signal_id long, perceptual_hash long"))
    want = sorted((i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i % 4 == 0 and bin(a ^ b).count("1") <= 5)
    queries = meta.where("signal_id % 4 = 0")
    for rows in (matching.BROADCAST_ROWS, 7):
        monkeypatch.setattr(matching, "BROADCAST_ROWS", rows)
        got = matching.near_hashes(queries, meta, 5)
        assert sorted(map(tuple, got.collect())) == want and "Join Cross" in plan_of(got)
    assert sorted(map(tuple, matching.near_hashes(queries, meta, 5, joined=1e9).collect())) == want
    rare = spark.range(2000).select(F.col("id").alias("signal_id"), F.xxhash64("id").alias("perceptual_hash"))
    assert "Join Cross" not in plan_of(matching.near_hashes(rare, rare, 2))


def test_index_equals_a_rebuild(spark):
    """Inserted, replaced, removed and inserted again, before and after a merge."""
    old, new = made_prints(spark, seed=4).map(stage.keep), made_prints(spark, seed=5).map(stage.keep)
    index = print_index.PrintIndex(spark, stage.new_path(spark, "prints"), 4)
    assert index.size() == 0
    index.insert(old.map(lambda t: t.where("signal_id < 50")))
    index.insert(new.map(lambda t: t.where("signal_id % 3 = 0")))
    index.remove(spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 777)], "signal_id long"))
    index.insert(new.map(lambda t: t.where("signal_id = 2")))
    state = lambda t: t.where("signal_id % 3 > 0 and signal_id < 50 and signal_id not in (1, 2)")
    fresh = lambda t: t.where("signal_id % 3 = 0 and signal_id not in (0, 3) or signal_id = 2")
    want = matching.Fingerprints(**{name: state(t).unionByName(fresh(new.tables()[name])) for name, t in old.tables().items()})
    queries = want.meta.where("signal_id % 4 = 2").select("signal_id")
    found = found_by(matching.search(queries, want, 0.5))
    rows = lambda t: sorted(map(str, t.select(*sorted(set(t.columns) - {"bucket"})).collect()))
    for _ in range(2):
        live = index.prints()
        for name, t in want.tables().items():
            assert rows(live.tables()[name]) == rows(t)
        assert rows(live.postings) == rows(matching.postings_of(want))
        assert index.size() == want.meta.count() and found_by(index.search(queries, 0.5)) == found
        index.merge()
    assert len(index.runs()) == 1
    index.drop()
    assert index.runs() == []


def test_index_scores_without_segments(spark, monkeypatch):
    """Scores of a stored index after a replacement; no segments are matched for them."""
    prints = made_prints(spark, 12, common=7).map(stage.keep)
    index = print_index.PrintIndex(spark, stage.new_path(spark, "prints"), 2)
    index.insert(made_prints(spark, 12, seed=5).map(lambda t: t.where("signal_id < 5")))
    index.insert(prints)
    monkeypatch.setattr(matching, "matched_segments", None)
    queries = prints.meta.where("signal_id % 5 = 0").select("signal_id")
    assert found_by(index.similar(queries, 0.5)) == found_by(matching.similar(queries, prints, 0.5, joined=1e9)) != []
    index.drop()


def test_index_commits(spark):
    """A run that no manifest lists doesn't count; of two writers that saw the same state one fails."""
    prints = made_prints(spark, 6).map(stage.keep)
    index = print_index.PrintIndex(spark, stage.new_path(spark, "prints"), 2)
    index.insert(prints)
    index._write("r00000009-lost", {**made_prints(spark, 9).tables(), "ids": spark.createDataFrame([(i, True) for i in range(9)], "signal_id long, live boolean")})
    assert index.size() == 6
    with pytest.raises(Exception, match="exists"):
        index._commit(["r00000009-lost"], 0)
    assert index.size() == 6
    index.drop()


# vibrato


def brute_vibrato(p, step):
    """The whole track at once, in NumPy."""
    n = len(p)
    if n < 20:
        return None
    cents = 1200 * np.log2(p / p.mean())
    i = np.arange(n)
    flat = cents - np.polyval(np.polyfit(i, cents, 1), i)
    bins = np.arange(max(int(3.0 * step * n), 1), min(int(12.0 * step * n), n // 2) + 1)
    strengths = np.array([abs(np.exp(-2j * np.pi * (k * i % n) / n) @ flat) / n for k in bins])
    k, s = int(bins[strengths.argmax()]), strengths.max()
    period, window = (2 * n + k) // (2 * k), (4 * n + k) // (2 * k)
    rows = flat[: n // period * period].reshape(-1, period)
    regular = np.mean([np.corrcoef(rows[0], r)[0, 1] for r in rows[1:]]) if len(rows) > 1 else 0.0
    var = np.lib.stride_tricks.sliding_window_view(cents, window).var(axis=1)
    at = np.arange(window, n - window)
    change = np.where(var[at] > 2 * var[at - window], np.abs(var[at] - var[at - window]), 0) if len(at) else np.zeros(1)
    depth = (flat.max() - flat.min()) / 2
    presence = min(depth / 100, 1) * 0.4 + min(s * 10, 1) * 0.3 + min(max(regular, 0), 1) * 0.3
    return k / (step * n), depth, regular, presence, at[change.argmax()] * step if change.max() > 10 else None


@pytest.mark.parametrize("block", [50, 16_384])
def test_vibrato_by_blocks(spark, monkeypatch, block):
    rng = np.random.default_rng(6)
    step, tracks = 512 / 44100, {}
    for name, n in (("long", 3000), ("odd", 331), ("short", 25), ("none", 19)):
        i = np.arange(n)
        depth = np.where(i > n // 3, 0.02, 0.001)
        tracks[name] = 300 * (1 + depth * np.sin(2 * np.pi * 5.5 * i * step)) + rng.normal(0, 0.3, n) + i * 0.001
    rows = [(k, 2 * j, float(v)) for k, p in tracks.items() for j, v in enumerate(p)] + [("long", 1, None), ("long", 3, 0.0), ("none", 1, None)]
    monkeypatch.setattr(pitch, "TRACK_BLOCK", block)
    df = spark.createDataFrame(rows, "signal_id string, frame_idx long, frequency double").repartition(4)
    got = {r["signal_id"]: r["vibrato"] for r in pitch.vibrato(df, 44100, 512).collect()}
    for name, p in tracks.items():
        want = brute_vibrato(p, step)
        assert (got[name] is None) == (want is None)
        if want:
            assert [got[name][c] for c in ("rate", "depth_cents", "regularity", "presence", "onset_time")] == pytest.approx(want, abs=1e-8)


def test_partial_transforms_add_up():
    rng = np.random.default_rng(7)
    x, n = rng.normal(size=5000), 5000
    want = np.fft.fft(x)[100:900]
    for size in (700, 5000):
        got = sum(pitch._partial_transform(x[s : s + size], s, n, 100, 899) for s in range(0, n, size))
        assert np.abs(got - want).max() < 1e-8


# loudness weighting


def test_many_short_signals_are_filtered_together(spark):
    """Outputs and states of signals of all lengths equal those one by one, and no signal takes a Python call of its own."""
    system, rng = filters.loudness_weighting(8000), np.random.default_rng(3)
    parts = [rng.normal(size=n) for n in (0, 1, 24, 255, 256, 257, 700, 24, 512)]
    starts = rng.normal(size=(len(parts), 4))
    for width in (1, 7, 256):
        out, ends = system.run_many(np.concatenate(parts), [len(p) for p in parts], starts, width)
        alone = [system.run(p, s) for p, s in zip(parts, starts, strict=True)]
        assert np.allclose(out, np.concatenate([a[0] for a in alone])) and np.allclose(ends, [a[1] for a in alone])
    rows = spark.range(900).select((F.col("id") % 30).alias("signal_id"), F.floor(F.col("id") / 30).alias("pos"), F.rand(1).alias("x")).where("signal_id > 0 or pos < 5")
    got = loudness.weighted(stage.keep(rows), 8000, 8)
    plan = plan_of(got)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "MapInPandas" not in plan
    assert got.count() == 29 * 30 + 5

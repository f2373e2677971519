"""Operators on synthetic signals, with the tolerances of FIXTURES.md."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.functions import filters, png, scalar
from tonegrid.operators import classify, fingerprint, layout, loudness, matching, musical, pitch, quality, render, report, segments, spectral, temporal
from tonegrid.sources import results, sinks, synthetic, wav

RATE = 44100


def rows_of(spark, values, signal_id="s"):
    return spark.createDataFrame([(signal_id, i, float(v)) for i, v in enumerate(values)], "signal_id string, pos long, x double")


def arrays_of(spark, **signals):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in signals.items()], "signal_id string, samples array<double>")


def sine(hz, level=1.0, seconds=0.1, rate=RATE):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.fixture(scope="module")
def tone(spark, tmp_path_factory):
    """Two seconds of a tone at 8 kHz, written once."""
    path = str(tmp_path_factory.mktemp("tone"))
    synthetic.series(spark, "tone", 2.0, 8000, synthetic.sine(440, 0.5)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# -- layout -------------------------------------------------------------------------------------


def test_index_in_two_levels_equals_one(spark):
    rows = spark.createDataFrame([(k, float((i * 37) % 50) // 2, i, float(i)) for k in "ab" for i in range(100)], "k string, t double, i long, v double")
    one = layout.index_samples(rows, "k", ["t", "i"], F.col("v"))
    two = layout.index_samples(rows, "k", ["t", "i"], F.col("v"), F.floor(F.col("t") / 7))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_blocks_see_their_neighbours(spark):
    values = np.random.default_rng(1).normal(size=500)
    rows = rows_of(spark, values)
    got = {r["pos"]: (r["a"], r["b"]) for r in layout.neighbours(rows, {"a": ("x", -3), "b": ("x", 2)}, block=16).collect()}
    assert got == {i: (values[i - 3] if i > 2 else None, values[i + 2] if i < 498 else None) for i in range(500)}


@pytest.mark.parametrize("size,hop", [(16, 8), (12, 5), (7, 7), (5, 8)])
def test_frames_and_hops(spark, size, hop):
    values = np.arange(50.0)
    rows = rows_of(spark, values)
    want = {i: values[i * hop : i * hop + size].tolist() for i in range((50 - size) // hop + 1)}
    assert {r["frame_idx"]: r["frame"] for r in layout.frames_of(rows, size, hop).collect()} == want
    arrays = arrays_of(spark, s=values)
    assert {r["frame_idx"]: r["frame"] for r in layout.frames_of_arrays(arrays, size, hop).collect()} == want
    sums = {r["window"]: r["t"] for r in layout.hopping_sums(rows, size, hop, {"t": F.col("x")}).where(F.col("n") == size).collect()}
    assert sums == {i: sum(w) for i, w in want.items()}


def test_short_signals_have_no_frames(spark):
    for n in (0, 1, 15):
        assert layout.frames_of(rows_of(spark, range(n)), 16, 8).count() == 0
    assert layout.frames_of_arrays(arrays_of(spark, s=range(15)), 16, 8).count() == 0


# -- spectra ------------------------------------------------------------------------------------


def test_spectra_have_their_peaks(spark):
    two = sine(440, seconds=2048 / RATE) + sine(880, 0.5, 2048 / RATE)
    mags = {r["signal_id"]: np.array(r["m"]) for r in arrays_of(spark, one=sine(440, seconds=1024 / RATE), two=two, dc=np.ones(512)).select("signal_id", spectral.spectrum("samples").alias("m")).collect()}
    assert abs(int(mags["one"].argmax()) * RATE / 1024 - 440) < RATE / 1024
    assert len(mags["two"]) == 1025 and mags["two"].max() > 10
    assert int(mags["dc"].argmax()) == 0
    assert spectral.stft(layout.frames_of_arrays(arrays_of(spark, z=np.zeros(4096)), 1024, 512)).count() == 7


def test_power_and_phase_go_with_magnitude(spark):
    x = np.random.default_rng(2).normal(size=64)
    got = arrays_of(spark, s=x).select(*[spectral.spectrum("samples", k, "rectangular").alias(k) for k in ("magnitude", "power", "phase")], spectral.spectrum("samples", "magnitude", "rectangular", 128).alias("padded")).first()
    want = np.fft.rfft(x)
    assert np.allclose(got["magnitude"], np.abs(want)) and np.allclose(got["power"], np.abs(want) ** 2) and np.allclose(got["phase"], np.angle(want))
    assert len(got["padded"]) == 65


def test_windows_are_symmetric():
    for kind in ("hann", "hamming", "blackman", "nuttall", "kaiser", "rectangular"):
        w = scalar.window_values(kind, 65)
        assert np.allclose(w, w[::-1]) and max(w) == pytest.approx(1.0, abs=1e-5)


@pytest.mark.parametrize("filters_,rate,size", [(6, 8000, 128), (26, 11025, 512), (64, 32000, 1024)])
def test_mel(spark, filters_, rate, size):
    ones = arrays_of(spark, s=np.ones(size // 2 + 1)).select("signal_id", F.lit(0).alias("frame_idx"), F.col("samples").alias("mag"))
    got = spectral.mel_energies(ones, filters_, rate, size).first()["mel"]
    bank = spectral.mel_bank(spark, filters_, rate, size).groupBy("filter").agg(F.sum("weight").alias("w")).collect()
    weights = {r["filter"]: r["w"] for r in bank}
    assert len(got) == filters_ and np.allclose(got, [weights.get(i, 0.0) for i in range(filters_)])


def test_rolloff_and_flux_against_numpy(spark):
    rng = np.random.default_rng(3)
    mags = rng.random((30, 9))
    rows = spark.createDataFrame([("s", i, m.tolist()) for i, m in enumerate(mags)], "signal_id string, frame_idx long, mag array<double>")
    got = spectral.frame_features(rows, 16, 16).orderBy("frame_idx").collect()
    assert [r["rolloff"] for r in got] == [float(np.flatnonzero(np.cumsum(m) >= 0.85 * m.sum())[0]) for m in mags]
    assert np.allclose([r["centroid"] for r in got], (mags * np.arange(9)).sum(1) / mags.sum(1))
    moved = spectral.flux(rows, block=4).orderBy("frame_idx").collect()
    up = np.maximum(np.diff(mags, axis=0), 0)
    assert np.allclose([r["flux_l1"] for r in moved[1:]], up.sum(1)) and np.allclose([r["flux_l2"] for r in moved[1:]], np.sqrt((up**2).sum(1)))
    assert moved[0]["flux_l1"] == 0 and moved[0]["flux_l2"] is None


# -- onsets, tempo, beats -----------------------------------------------------------------------


def brute_peaks(x, threshold=0.3):
    n, out = len(x), []
    for i in range(n):
        if max(x[max(i - 3, 0) : i + 4]) > x[i]:
            continue
        seen = list(x[max(i - 30, 0) : i]) or [x[i]]
        seen += list(x[i + 1 : i + 31]) or [x[i]]
        if x[i] > sum(seen) / len(seen) + threshold:
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_peaks_against_brute_force(spark, seed):
    x = np.round(np.random.default_rng(seed).exponential(0.3, 200), 1)
    got = sorted(r["pos"] for r in temporal.peak_pick(rows_of(spark, x), block=70).collect())
    assert got == brute_peaks(x.tolist())


@pytest.mark.parametrize("step,n,want,most", [(0.6, 12, 100, 4), (0.8, 7, 75, 4), (0.4, 15, 150, 7)])
def test_tempo_and_beats(spark, step, n, want, most):
    times = spark.createDataFrame([("s", 0.25 + i * step) for i in range(n)], "signal_id string, t double")
    found = temporal.tempo(times)
    assert abs(found.first()["tempo"] - want) <= most
    grid = temporal.beats(times, found)
    beats = grid.first()["beats"]
    assert abs(beats[0] - 0.25) < 0.1 and np.allclose(np.diff(beats), 60 / found.first()["tempo"])
    assert temporal.stability(grid).first()["tempo_stability"] == pytest.approx(1.0, abs=1e-6)


def test_no_tempo_outside_the_range(spark):
    times = spark.createDataFrame([("fast", i * 0.25) for i in range(20)] + [("slow", i * 2.0) for i in range(5)] + [("edge", i * 0.3) for i in range(8)] + [("one", 1.0)], "signal_id string, t double")
    assert temporal.tempo(times).count() == 0


# -- pitch --------------------------------------------------------------------------------------


@pytest.mark.parametrize("make,most", [(pitch.yin, 0.01), (pitch.pyin, 0.03)])
def test_pitch_of_tones(spark, make, most):
    tones = tuple(round(440 * 2 ** (k / 12), 2) for k in range(-27, 26, 7))
    rows = arrays_of(spark, **{str(f): sine(f, seconds=0.1)[:2048] for f in tones})
    for r in rows.select("signal_id", pitch.detect("samples", RATE, make()).alias("p")).collect():
        assert abs(r["p"]["frequency"] - float(r["signal_id"])) / float(r["signal_id"]) < most
        assert r["p"]["confidence"] > 0.8


def test_pitch_of_nothing(spark):
    rows = arrays_of(spark, zeros=np.zeros(2048), flat=np.full(10, 0.5), empty=[])
    assert {r["p"]["frequency"] for r in rows.select(pitch.detect("samples", RATE).alias("p")).collect()} == {0.0}


def test_track_leaves_out_the_last_frame(spark):
    rows = rows_of(spark, sine(440, seconds=0.2)[: 2048 + 512 * 4])
    got = pitch.track(rows, RATE).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in got] == [0, 1, 2, 3] and {r["note_name"] for r in got} == {"A4"}


def test_vibrato(spark):
    t = np.arange(60) * 512 / RATE
    rows = spark.createDataFrame([("v", i, float(440 * (1 + 0.03 * math.sin(2 * math.pi * 5.7 * x)))) for i, x in enumerate(t)] + [("flat", i, 440.0) for i in range(60)] + [("few", i, 440.0 + i) for i in range(19)], "signal_id string, frame_idx long, frequency double")
    got = {r["signal_id"]: r["vibrato"] for r in pitch.vibrato(rows, RATE).collect()}
    assert abs(got["v"]["rate"] - 5.7) < 1 and got["v"]["presence"] > 0.5 and got["flat"] is None and got["few"] is None


def test_notes(spark):
    names = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
    rows = spark.createDataFrame([(440 * 2 ** ((m - 69) / 12) * 1.01, f"{names[m % 12]}{m // 12 - 1}") for m in range(21, 109)], "hz double, want string")
    assert all(r["n"] == r["want"] for r in rows.select("want", scalar.note_name(scalar.midi_note("hz")).alias("n")).collect())


# -- loudness -----------------------------------------------------------------------------------


def test_weighting_in_blocks_equals_the_recurrence(spark):
    x = np.random.default_rng(4).normal(size=1000)
    system = filters.loudness_weighting(8000)
    state, want = np.zeros(4), []
    for v in x:
        want.append(float(system.c @ state + system.d * v))
        state = system.a @ state + system.b * v
    got = [r["x"] for r in loudness.weighted(rows_of(spark, x), 8000, block=137).orderBy("pos").collect()]
    assert np.allclose(got, want)


def test_loudness_of_silence_and_tones(spark, tone):
    silent = loudness.perceptual(rows_of(spark, np.zeros(8000)), 8000).first()
    assert silent["loudness_lufs"] < -60 and silent["energy_level"] == 0
    loud = loudness.perceptual(tone, 8000).first()
    assert -1e-6 < loud["true_peak_dbfs"] + 20 * math.log10(2) < 0.01 and loud["crest_factor"] > 1


# -- classes, keys, quality ---------------------------------------------------------------------


def test_silence_is_silence(spark):
    got = classify.scores(classify.features(layout.with_crossings(rows_of(spark, np.zeros(8000))), 8000)).first()
    assert got["content_type"] == "Silence" and got["confidence"] > 0.9


def test_key_of_a_chord(spark):
    rows = synthetic.series(spark, "c", 1.0, RATE, synthetic.chord())
    shares = musical.chroma(spectral.stft(layout.frames_of(rows, 4096, 2048)), RATE, 4096)
    got = musical.detect_key(shares).first()
    assert got["root"] in ("C", "A", "E") and got["tonality"] < 0.07
    assert {r["chord"] for r in musical.chord_progression(rows, RATE).collect()} <= {"C", "Em", "Am", "A", "E", "Cm"}


def test_complexity_of_chroma(spark):
    rows = spark.createDataFrame([("flat", [1 / 12] * 12), ("one", [1.0] + [0.0] * 11)], "signal_id string, chroma array<double>")
    got = {r["signal_id"]: r["harmonic_complexity"] for r in musical.detect_key(rows).collect()}
    assert got["flat"] > 0.9 and got["one"] < 0.1


def test_quality(spark):
    clean = sine(440, 0.5, 0.2)
    clipped = np.where(np.abs(sine(440, 1.2, 0.2)) > 0.99, np.sign(sine(440, 1.2, 0.2)), sine(440, 1.2, 0.2))
    rows = rows_of(spark, clean, "clean").unionByName(rows_of(spark, clipped, "clipped")).unionByName(rows_of(spark, clean * 0.6 + 0.1, "shifted")).unionByName(rows_of(spark, np.zeros(8820), "silent"))
    got = {r["signal_id"]: r for r in quality.assess(rows, RATE).collect()}
    kinds = {k: {i["issue_type"] for i in r["issues"]} for k, r in got.items()}
    assert got["clean"]["clipping_ratio"] < 0.001 and got["clean"]["snr_db"] > 30
    assert [i["time_ranges"] for i in got["clipped"]["issues"] if i["issue_type"] == "Clipping"][0][0]["start"] >= 0
    assert all(not i["time_ranges"] for i in got["shifted"]["issues"] if i["issue_type"] != "Clipping")
    assert "Clipping" in kinds["clipped"] and "DCOffset" in kinds["shifted"] and abs(got["shifted"]["dc_offset"] - 0.1) < 0.01
    assert got["silent"]["frequency_response_score"] is None and got["silent"]["overall_score"] is None


def test_clip_regions_touch_the_ends(spark):
    x = [1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    got = [(r["start"], r["end"]) for r in quality.clip_regions(rows_of(spark, x), 1.0).orderBy("region").collect()]
    assert got == [(0.0, 2.0), (3.0, 4.0), (6.0, 7.0)]


def test_thd_against_numpy(spark):
    x = sine(430.66, 0.5, 4096 / RATE) + sine(861.33, 0.05, 4096 / RATE)
    got = quality.spectral_metrics(rows_of(spark, x)).first()["thd_percent"]
    m = np.abs(np.fft.rfft(x * scalar.window_values("hann", 4096)))[1:2048]
    base = int(m.argmax()) + 1
    floor = np.sort([v for i, v in enumerate(m, 1) if all(abs(i - h * base) > 2 for h in range(1, 6))])
    floor = floor[len(floor) // 2]
    power = sum((m[h * base - 1] - floor) ** 2 for h in range(2, 6) if m[h * base - 1] > 3 * floor and m[h * base - 1] > 0.001 * m.max())
    assert got == pytest.approx(math.sqrt(power / (m.max() - floor) ** 2) * 100)


# -- segments -----------------------------------------------------------------------------------


def test_segments_and_their_tail(spark):
    crossed = layout.with_crossings(rows_of(spark, [0.1] * 100))
    dealt = segments.segment_samples(crossed, 40)
    got = {r["segment"]: r["n"] for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 40, 1: 40, 2: 40, 3: 40, 4: 20}
    profile = segments.energy_profile(segments.segments(crossed, 40, 8, 4)).first()
    assert profile["shape"] == "Flat" and profile["variance"] < 0.01
    short = segments.segment_samples(layout.with_crossings(rows_of(spark, [0.1] * 5)), 40)
    assert short.count() == 5


def test_repetitions_never_try_the_last_start(spark):
    rows = spark.createDataFrame([("s", i, i * 0.5, 1.0, e, 100.0, 0.1, "Music", "Verse", 1.0) for i, e in enumerate([0.1, 0.9] * 4)], "signal_id string, segment long, start_time double, duration double, energy double, spectral_centroid double, zcr double, content_type string, label string, dynamic_range double")
    got = {(r["length"], r["start_a"], r["start_b"]) for r in segments.repetitions(rows).collect()}
    assert (2, 0.0, 1.0) in got and (4, 0.0, 2.0) not in got and all(b < 3.0 for w, _, b in got if w == 2)


# -- fingerprints -------------------------------------------------------------------------------


def prints_of(spark, rows, rate=8000):
    crossed = layout.with_crossings(rows)
    return matching.Fingerprints.of(crossed, spectral.stft(layout.frames_of(rows, 512, 256)), rate, 512, 256, seconds=0.5, chunk=256)


def test_a_signal_is_identical_to_itself(spark, tone):
    other = synthetic.series(spark, "other", 2.0, 8000, synthetic.drums())
    copy = tone.withColumn("signal_id", F.lit("copy"))
    prints = prints_of(spark, tone.unionByName(copy).unionByName(other))
    found = {r["id_b"]: r for r in matching.search(spark.createDataFrame([("tone",)], "signal_id string"), prints, 0.0).collect()}
    assert found["copy"]["match_type"] == found["tone"]["match_type"] == "Identical" and found["copy"]["time_offset"] == 0.0
    assert found["copy"]["confidence"] == pytest.approx(1.0)
    assert "other" not in found or found["other"]["similarity"] < found["copy"]["similarity"]


def test_hash_step_is_a_32_bit_product(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 2**32, (200, 2))]
    got = spark.createDataFrame(pairs, "h long, v long").select("h", "v", scalar.hash_step(F.col("h"), F.col("v")).alias("r")).collect()
    assert all(r["r"] == ((r["h"] ^ r["v"]) * 0x9E3779B9) % 2**32 for r in got)


def test_greedy_segments_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [("a", "b", float(a), float(b), 2.0, float(q)) for a, b, q in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), np.round(rng.random(60), 1), strict=True)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[2], r[3])):
        if not any(k[2] <= r[2] < k[2] + 2 or k[3] <= r[3] < k[3] + 2 for k in kept):
            kept.append(r)
    got = matching.matched_segments(spark.createDataFrame(rows, "id_a string, id_b string, time_a double, time_b double, duration double, quality double"))
    assert sorted(map(tuple, got.collect())) == sorted(kept)


def test_near_hashes_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    values = base + [b ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for b in base] + [b ^ 7 for b in base]
    meta = spark.createDataFrame(list(enumerate(values)), "signal_id long, perceptual_hash long")
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert {tuple(r) for r in matching.near_hashes(meta, meta).collect()} == want


# -- reports, files, pictures -------------------------------------------------------------------


def test_full_report(spark, tone):
    record = report.with_insights(report.analyze(tone, 8000, "detailed", report.Settings(512, 256, chroma_size=1024)))
    got = record.first()
    assert got["summary"]["duration"] == 2.0 and abs(got["summary"]["peak_amplitude"] - 0.5) < 0.01
    assert abs(np.mean(got["spectral"]["spectral_centroid"]) - 440) < 60
    assert abs(got["pitch"]["mean_pitch"] - 440) < 10 and "tonality.vague" in {n["code"] for n in got["insights"]}
    assert [(i["measured"], i["limit"]) for i in got["quality"]["issues"] if i["issue_type"] == "LowSampleRate"] == [(8000.0, 44100.0)]
    lines = [r[0] for r in record.select(F.explode(F.transform("insights", report.note_text))).collect()]
    assert any(x.startswith("pitch.mean 4") for x in lines) and "raise_rate" in got["recommendations"]
    assert report.enhanced_summary(record).first()["fingerprint"]["unique_id"].startswith("audio_")
    assert report.ranked_insights(record).first()["info"] and report.short_summary(record).first()["energy"] == "medium"


def test_quick_profile_has_its_modules_alone(spark, tone):
    assert report.analyze(tone, 8000, "quick", report.Settings(512, 256)).columns == ["signal_id", "summary", "temporal"]


def test_wav_round_trip(spark, tmp_path):
    values = np.array([0.0, 0.5, -0.5, 1.0, -1.0, 0.25])
    (tmp_path / "a.wav").write_bytes(wav.encode(values, 8000, 2))
    pcm = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 4) + struct.pack("<hh", 32767, -32768)
    (tmp_path / "b.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(pcm)) + b"WAVE" + pcm)
    (tmp_path / "c.mp3").write_bytes(b"junk")
    (tmp_path / "d.wav").write_bytes(b"RIFFxxxxWAVE")
    audio = wav.read_audio(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in audio.collect()}
    assert got["a.wav"]["samples"] == values.tolist() and got["a.wav"]["duration"] == 3 / 8000
    assert got["b.wav"]["samples"][0] == 1.0 and got["b.wav"]["samples"][1] < -1.0
    assert got["c.mp3"]["error"] and got["d.wav"]["error"] and got["c.mp3"]["samples"] is None
    mono = {r["pos"]: r["x"] for r in wav.mono(audio).where("signal_id like '%a.wav'").collect()}
    assert mono == {0: 0.25, 1: 0.25, 2: -0.375}
    assert wav.channel(audio.where("path like '%a.wav'"), 1).first()["samples"] == [0.5, 1.0, 0.25]


def test_pictures(spark, tone):
    cells = spectral.stft(layout.frames_of(tone, 256, 256))
    for images in (render.waveform_png(tone, 40, 20), render.power_png(cells, 40, 20), render.spectrogram_png(cells, 40, 20, "plasma")):
        data = bytes(images.first()["png"])
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (40, 20)
    assert len(png.encode(np.zeros((2, 3, 3)))) > 40


def test_colour_maps(spark):
    rows = spark.createDataFrame([(v / 10,) for v in range(-1, 12)], "v double")
    for name in ("viridis", "plasma", "inferno", "grayscale"):
        got = [r["c"] for r in rows.select(scalar.colormap(name, "v").alias("c")).collect()]
        assert all(0 <= c <= 255 for x in got for c in x) and got[0] == got[1] and got[-1] == got[-2]
    assert tuple(rows.where("v = 0").select(scalar.colormap("viridis", "v").alias("c")).first()["c"]) == (68, 1, 84)


def test_cache(spark, tmp_path):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(10)], "cache_key string, v int")
    made = results.entries(rows, "cache_key", now).withColumn("accessed_at", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.expr("cast(substring(cache_key, 2) as int)"), F.lit(0), F.lit(0)))
    results.put(spark, str(tmp_path / "c"), made)
    cache = results.read_cache(spark, str(tmp_path / "c"))
    assert results.stats(cache).first()["entries"] == 10
    later = F.lit("2024-01-02 12:00:00").cast("timestamp")
    hits, rest = results.lookup(spark.createDataFrame([("k1",), ("new",)], "cache_key string"), cache, later)
    assert (hits.count(), [r[0] for r in rest.collect()]) == (1, ["new"])
    assert results.fresh(cache, F.lit("2024-01-04 00:00:00").cast("timestamp")).count() == 0
    size = cache.first()["size_bytes"]
    stay = results.evict(cache, size, 8 * size)
    assert sorted(r["cache_key"] for r in stay.collect()) == [f"k{i}" for i in range(3, 10)]
    results.clear(spark, str(tmp_path / "c"))
    assert results.stats(results.read_cache(spark, str(tmp_path / "c"))).first()["entries"] == 0
    assert results.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_formats_and_pages(spark):
    rows = spark.createDataFrame([("a/b.WAV", "Wav"), ("x.oga", "Ogg"), ("x.aac", "M4a"), ("noext", "Unknown"), ("a.b/c", "Unknown"), ("x.txt", "Unknown")], "p string, want string")
    assert all(r["f"] == r["want"] for r in rows.select("want", scalar.audio_format("p").alias("f")).collect())
    one = spark.range(1).select(F.sequence(F.lit(1), F.lit(10)).alias("a"))
    got = one.select(sinks.page(F.col("a"), 4, 3).alias("p"), sinks.next_cursor(F.col("a"), 4, 3).alias("n"), sinks.next_cursor(F.col("a"), 7, 3).alias("e")).first()
    assert (got["p"], got["n"], got["e"]) == ([5, 6, 7], "7", None)


def test_streaming_levels(spark, tmp_path):
    from tonegrid.streaming import levels

    rows = spark.createDataFrame([(1, f"2024-01-0{1 + i // 10} 0{i % 10}:00:00", float(i)) for i in range(30)], "user_id long, t string, value double").withColumn("ts", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = levels.windowed_levels(stream, "user_id", "ts", "value").writeStream.outputMode("append").format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["n"]: r["peak"] for r in spark.table("levels").collect()}
    assert got == {10: 19.0} or got == {10: 9.0}


def test_fingerprint_words(spark, tone):
    cells = spectral.stft(layout.frames_of(tone, 512, 256))
    hashes, marks = fingerprint.spectral_hashes(cells, 8000, 256), fingerprint.landmarks(cells, 8000, 512, 256)
    words = {(r["part"], r["word"]): r["value"] for r in fingerprint.compact(hashes, marks).collect()}
    rows = {r["frame_idx"]: r["hash"] for r in hashes.collect()}
    assert words[0, 0] & 0xFF == rows[0] & 0xFF and words[0, 0] >> 8 & 0xFF == rows[1] & 0xFF

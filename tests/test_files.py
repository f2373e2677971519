"""Files of rows, blocks of WAV files, and the command line's batch."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid import __main__ as cli
from tonegrid.sources import file_rows, results, sinks, wav


def test_a_file_cut_in_blocks_equals_the_whole(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {"one.wav": (1, 801), "two.WAV": (2, 1600), "odd.wave": (3, 1000), "none.wav": (2, 0)}
    for name, (channels, n) in made.items():
        (tmp_path / name).write_bytes(wav.encode(rng.normal(size=n), 8000, channels))
    pcm = rng.integers(-32768, 32768, 500).astype("<i2").tobytes()
    chunks = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", len(pcm) + 500)
    (tmp_path / "cut.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(chunks) + len(pcm)) + b"WAVE" + chunks + pcm[:-1])
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    (tmp_path / "deep.wav").write_bytes((tmp_path / "one.wav").read_bytes().replace(struct.pack("<HHI", 3, 1, 8000), struct.pack("<HHI", 9, 1, 8000)))
    (tmp_path / "other.txt").write_text("no sound")
    whole = wav.read_audio(spark, str(tmp_path), "*.[wW]*")
    want = {r["path"].rsplit("/", 1)[1]: r for r in whole.collect()}
    base = sorted((r["signal_id"].rsplit("/", 1)[1], r["pos"], r["x"]) for r in wav.mono(whole).collect())
    for block, most in ((64, 200), (100, 1 << 20), (1 << 20, 1 << 20)):
        found = file_rows.read_blocks(spark, str(tmp_path), block, most)
        got: dict[str, list] = {}
        for r in found.orderBy("path", "first").collect():
            name = r["path"].rsplit("/", 1)[1]
            if r["error"]:
                assert want[name]["error"] and r["samples"] is None
                continue
            assert (r["sample_rate"], r["channels"]) == (want[name]["sample_rate"], want[name]["channels"])
            assert r["first"] == len(got.setdefault(name, [])) and r["first"] % r["channels"] == 0
            got[name] += r["samples"]
        assert got == {n: list(r["samples"]) for n, r in want.items() if not r["error"]}
        mixed = sorted((r["signal_id"].rsplit("/", 1)[1], r["pos"], r["x"]) for r in wav.mono_blocks(found).collect())
        assert [m[:2] for m in mixed] == [b[:2] for b in base] and [m[2] for m in mixed] == pytest.approx([b[2] for b in base])
    assert file_rows.read_blocks(spark, str(tmp_path), 64, 200).rdd.getNumPartitions() > 8
    (tmp_path / "empty").mkdir()
    assert file_rows.read_blocks(spark, str(tmp_path / "empty")).count() == 0


def test_many_files_are_planned_by_name(tmp_path):
    """Planning opens no file and holds no block; small parts grow where tasks would be many, long files are cut."""
    for i in range(700):
        (tmp_path / f"{i:03d}.wav").write_bytes(b"" if i % 2 else wav.encode(np.arange(i % 5), 8000))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "long.wav").write_bytes(wav.encode(np.arange(3000), 8000, 2))
    reader = file_rows.WavReader(str(tmp_path), 16, 80)
    for name in os.listdir(tmp_path):
        os.chmod(tmp_path / name, 0o000) if name.endswith(".wav") else None
    parts = reader.partitions()
    for name in os.listdir(tmp_path):
        os.chmod(tmp_path / name, 0o644) if name.endswith(".wav") else None
    assert all(set(vars(p)) == {"folder", "parts"} for p in parts) and 100 < len(parts) <= 2 * file_rows.MOST_TASKS
    assert len({n for p in parts for n, _, _ in p.parts}) == 701 and sum(n == "x/long.wav" for p in parts for n, _, _ in p.parts) > 10
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sum(r["error"] is not None for r in rows) == 350 and len({r["path"] for r in rows}) == 701
    assert [x for r in rows if r["path"].endswith("long.wav") for x in r["samples"]] == list(range(3000))
    assert all(len(r["samples"] or []) <= 4 for r in rows) and len(parts) > sum(len(list(reader.read(p))) for p in parts) / 2


def test_files_appear_when_all_are_written(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{i}", f"body {i}".encode()) for i in range(20)] + [("none", None)], "name string, content binary").repartition(4)
    file_rows.write_files(rows, out)
    assert sorted(os.listdir(out)) == sorted(["_SUCCESS", "none", *[f"f{i}" for i in range(20)]])
    assert (tmp_path / "out" / "f7").read_bytes() == b"body 7"

    fails = F.udf(lambda n: 1 / 0 if n == "f13" else n)
    for bad in (rows.withColumn("name", fails("name")), rows.withColumn("name", F.lit("same")), rows.withColumn("name", F.lit("../up"))):
        fresh = str(tmp_path / "fresh")
        with pytest.raises(Exception):  # noqa: B017
            file_rows.write_files(bad, fresh)
        # a task that is still being killed may leave a temporary folder, never a file or _SUCCESS
        shown = lambda path: [n for n in os.listdir(path) if not n.startswith("_temporary")] if os.path.exists(path) else []
        assert shown(fresh) == []
        with pytest.raises(Exception):  # noqa: B017
            file_rows.write_files(bad, out)
        assert len(shown(out)) == 22  # what was there stays
    file_rows.write_files(rows.limit(0), out)
    assert shown(out) == ["_SUCCESS"]


def test_json_files_by_stem(spark, tmp_path):
    rows = [("/a/x.wav", 1), ("/b/x.mp3", 2), ("/b/y.tar.gz", 3), (".hid", None), ("/c/plain", 5)]
    out = tmp_path / "json"
    sinks.write_each(spark.createDataFrame(rows[:3] + rows[4:], "signal_id string, n int"), str(out))
    found = {n: json.loads((out / n).read_text()) for n in os.listdir(out) if n.endswith(".json")}
    assert {n for n in found if not n.startswith("x-")} == {"y.tar.json", "plain.json"}
    assert sorted(v["n"] for n, v in found.items() if n.startswith("x-")) == [1, 2] and len(found) == 4


def test_batch_writes_a_file_for_each_signal(spark, tmp_path):
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    for folder, name in (("in", "a.wav"), ("in", "b.wav"), ("in/sub", "a.wav")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(wav.encode(tone, 8000))
    cli.main(["batch", str(tmp_path / "in"), "--profile", "quick", "--output", str(tmp_path / "out")])
    names = sorted(os.listdir(tmp_path / "out" / "rate=8000"))
    assert "b.json" in names and "_SUCCESS" in names and sum(n.startswith("a-") for n in names) == 2
    assert json.loads((tmp_path / "out" / "rate=8000" / "b.json").read_text())["summary"]["sample_rate"] == 8000


# the cache


def test_cache_keeps_what_was_used(spark, tmp_path):
    """Puts and gets in turn against a plain model: last access, expiry, replacement, eviction, merging."""
    import datetime as dt
    import random

    rng, day = random.Random(3), dt.datetime(2024, 1, 1)
    cache, model = results.ResultCache(spark, str(tmp_path / "cache"), most=60, seconds=5 * 86400), {}
    at = lambda d: day + dt.timedelta(days=d)
    for d in range(6):
        new = [(f"k{rng.randrange(14)}", rng.randint(1, 9)) for _ in range(5)]
        new = list(dict(new).items())
        rows = spark.createDataFrame([(k, at(d), at(d), n, f"{k}:{d}") for k, n in new], results.SCHEMA)
        needed = sum(e[2] for e in model.values()) + sum(n for _, n in new) - 60
        gone, freed = set(), 0
        for k in sorted(model, key=lambda k: (model[k][1], k)):
            if freed >= needed:
                break
            gone.add(k)
            freed += model[k][2]
        assert {r["cache_key"] for r in cache.put(rows, F.lit(at(d - 0.25))).collect()} == gone
        model = {k: e for k, e in model.items() if k not in gone} | {k: (at(d), at(d), n, f"{k}:{d}") for k, n in new}
        asked = [(f"k{rng.randrange(16)}", at(d + 0.5 + i / 50)) for i in range(6)]
        want = [(k, t, model[k][3]) for k, t in asked if k in model and model[k][0] + dt.timedelta(days=5) > t]
        hits = cache.get(spark.createDataFrame(asked, "cache_key string, at timestamp"))
        assert sorted((r["cache_key"], r["at"], r["result"]) for r in hits.collect()) == sorted(want)
        for k, t, _ in want:
            model[k] = (model[k][0], max(model[k][1], t), *model[k][2:])
        if d == 3:
            cache.merge()
        held = {r["cache_key"]: (r["created_at"], r["accessed_at"], r["size_bytes"], r["result"]) for r in cache.entries().collect()}
        assert held == model


def test_frames_as_a_table_function(spark):
    from tonegrid.functions import table
    from tonegrid.operators import layout

    table.register_frames(spark)
    rows = spark.createDataFrame([("a", [float(i) for i in range(11)]), ("b", [1.0]), ("c", None), ("d", [])], "signal_id string, samples array<double>")
    got = spark.sql("SELECT signal_id, f.* FROM {rows}, LATERAL frames(samples, 4, 3) AS f", rows=rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.frames_of_arrays(rows, 4, 3).collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()

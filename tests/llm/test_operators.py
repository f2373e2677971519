"""Each operator against brute force, on texts that hold the awkward cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import (
    common,
    exact_dedup,
    graph,
    induced_sort,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    source_mixing,
    substring_dedup,
    text_stats,
    toxicity,
    url_filter,
    warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, id string, n int, key int, sha string, node int"


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(seed: int = 3) -> list[str | None]:
    """Nulls, empty and very long texts, exact and near copies, shared passages, short texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghiÄé", k=rng.randint(1, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, line = prose(90), prose(12)
    out: list[str | None] = [None, "", "   \n\t", "one", "two words", "ONE", prose(20_000), "a " * 900, "x" * 1500]
    for _ in range(25):
        out.append(prose(rng.randint(3, 300)))
    for i in range(30):
        out.append(f"{prose(rng.randint(0, 40))} {passage} {prose(rng.randint(0, 400))}\n{line}")
    base = prose(260).split(" ")
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    out += [out[12]] * 6 + [out[40].upper() if i % 2 else out[40] for i in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, [None, "a", "b", "B"][i % 4], "clash", 1, 2, "s", 3) for i, t in enumerate(texts())]
    rows += [rows[20], rows[20], (None, rows[25][1], "a", "clash", 1, 2, "s", 3), (None, "alone here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def plain(docs):
    """The rows with distinct ids."""
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"])


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 3: exact duplicates


def test_levels_and_filter(spark):
    """Merging by levels gives what one merge gives; the filter passes every digest of the index."""
    rng = random.Random(4)
    rows = [(i % 37, f"{rng.randrange(300):03x}", i, 1) for i in range(900)]
    runs = spark.createDataFrame(rows, "run int, digest string, best long, n long")
    count = collections.Counter(r[1] for r in rows)
    with common.Scratch(spark, "test") as scratch:
        for fan_in in (2, 64):
            index = exact_dedup.compact(runs, scratch, "max", fan_in)
            want = {d: (max(r[2] for r in rows if r[1] == d), n) for d, n in count.items() if n > 1}
            assert {r["digest"]: (r["keep_id"], r["n"]) for r in index.collect()} == want
        found = exact_dedup.may_hit(spark.createDataFrame([(f"{i:03x}",) for i in range(3000)], "digest string"), exact_dedup.filter_of(index, scratch)).collect()
    passed = {r["digest"] for r in found if r["hit"]}
    assert set(want) <= passed and len(passed) < 900


@pytest.mark.parametrize("keep,bits", [("min", 256), ("max", 256), ("max", 4)])
def test_exact_dedup(docs, keep, bits):
    rows, groups = rows_of(docs), collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    want = []
    for i, t in rows:
        ids = groups[lower(t or "")]
        best = (min if keep == "min" else max)((x for x in ids if x is not None), default=None)
        want.append((i, best, len(ids), i == best, hashlib.sha256(lower(t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs, keep=keep, bits=bits).collect()]
    if bits == 256:
        assert sorted(got, key=str) == sorted(want, key=str)
    else:  # colliding digests: rows of one id that lie in split groups are told apart by their text
        assert sorted((g for g in got if g[0] is not None), key=str) == sorted((w for w in want if w[0] is not None), key=str)


# 4: mixing


def test_mix_sources(docs):
    got = source_mixing.mix_sources(docs).collect()
    again = source_mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    total = sum(r["taken"] for r in got)
    assert total == pytest.approx(1.5 * sum(sizes.values()), rel=0.25)  # one text holds a third of all words
    for r in got:
        assert r["taken"] in {0, r["size"], 2 * r["size"]}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = budget / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * sizes[s]
            budget -= target[s]
        open_ -= full
    by_size = {(r["source_size"], round(r["target"], 3)) for r in got}
    assert by_size == {(sizes[s], round(target[s], 3)) for s in order}


def brute_times(rows, seed=17):
    """How often each (id, text, source) is taken: keys, order and prefix sums in plain Python."""
    import math

    size = lambda t: len(WORD.findall(t or ""))
    order = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in order}
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = budget / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weights[s]
        if not full:
            break
        budget -= sum(target[s] for s in full)
        open_ -= full
    out = []
    for s in order:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, upto, steps = target[s] - whole * sizes[s], 0, collections.defaultdict(int)
        named = lambda d, t: str(d) if d is not None else "text:" + hashlib.md5((t or "").encode()).hexdigest()
        for d, t, x in rows:
            if x == s:
                u = (int(hashlib.md5(f"{seed}:{named(d, t)}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                symbols = sum(c in "#*$%&|<>!" for c in t or "")
                steps[-math.log(u) * (1 + symbols / max(size(t), 1)), named(d, t), size(t), d, t] += 1
        for (*_, n, d, t), count in sorted(steps.items(), key=lambda kv: kv[0][:3]):
            upto += n * count
            extra = upto - n * count / 2 <= rest
            out += [(d, t, s, (whole + extra) if n else 0)] * count
    return out


def test_mix_rows_equal_brute_force(docs, spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = collections.Counter((d, len(WORD.findall(t or "")), times * len(WORD.findall(t or ""))) for d, t, _, times in brute_times(rows))
    assert collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in source_mixing.mix_sources(docs).collect()) == want
    # few rows are ordered at once, so ranges are narrowed several times
    with common.Scratch(spark, "test") as scratch:
        base = scratch.write(source_mixing.keyed(docs, "doc_id", "text", "source", 17), "keys")
        plan = source_mixing.plan_mix(base, scratch, (5.0, 2.0, 1.0), 1.5, 2.0, cells=16, sorted_rows=4)
        found = source_mixing.times_taken(base, plan).collect()
    assert collections.Counter((r["id"], r["size"], r["times"] * r["size"]) for r in found) == want


def test_mix_is_drawn_by_weight(spark):
    rows = [(i, "word " * 10 + ("# " * 40 if i % 2 else ""), "s") for i in range(4000)]
    got = source_mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5)
    taken = got.where("taken > 0").groupBy(F.col("doc_id") % 2).count().collect()
    count = {r[0]: r[1] for r in taken}
    assert count[0] > 1.4 * count.get(1, 0)  # symbols lower a document's weight


# 6: near duplicates


def brute_components(rows, percent=80):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("frequent,turns", [(2, 0), (24, 2)])
def test_ngram_join(plain, frequent, turns):
    """frequent=2 makes nearly every shared token frequent, so links rest on token pairs."""
    got = ngram_join.ngram_join(plain, frequent=frequent, turns=turns)
    assert sorted(map(tuple, got.collect())) == brute_components(rows_of(plain))


def test_ngram_join_repeated_and_null_ids(docs):
    got = ngram_join.ngram_join(docs)
    assert got.count() == docs.count()
    want = dict((d, c) for d, _, c in brute_components(rows_of(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))))
    assert {r["doc_id"]: r["component_id"] for r in got.where("doc_id is not null").collect()} == want


def test_ngram_join_goes_on_after_leaders_of_other_sizes(spark):
    """The one shared signature is led by a set too small for both others, which link."""
    rows = [(1, "c d e f g"), (2, "a b c d e f g h i"), (3, "a b c d e f g h")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows) == [(1, 1, 1), (2, 5, 2), (3, 4, 2)]


@pytest.mark.parametrize("frequent", [2, 5])
def test_signatures_lose_no_pair(frequent):
    """Sets at the very threshold share a signature, whatever classes their common tokens have."""
    rng = np.random.default_rng(0)
    plan = ngram_join.Plan(frequent=frequent)
    most = set()
    for n in [1, 2, 5, 23, 24, 30, 60, 200, 700]:
        for _ in range(30):
            base = np.unique(rng.integers(1, 1 << 32, n).astype(np.uint64))
            n = len(base)
            other = np.sort(base[rng.permutation(n)[: n - plan.errors(n)]])
            counts = {int(x): int(frequent ** rng.uniform(0.8, 4.5)) + 2 for x in base}
            classes = lambda x: plan.classes(np.array([counts[int(v)] for v in x]))
            most |= set(classes(base).tolist())
            assert set(plan.signatures(base, classes(base), 0, n)) & set(plan.signatures(other, classes(other), 0, len(other)))
    assert most >= {2, 3, 4}


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    for n in (5, 100, 3000):
        a = np.unique(rng.integers(1, 1 << 40, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 3 // 4], rng.integers(1, 1 << 40, n // 3 + 1).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        bits = lambda x, y: sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
        for longs in (8, 64):
            assert bits(ngram_join.sketch(a, longs), ngram_join.sketch(b, longs)) <= differ
        wide = ngram_join.sketch(a, 64)
        assert (wide[:32] ^ wide[32:]).tolist() == ngram_join.sketch(a, 32).tolist()


def test_ngram_join_long_texts(spark):
    """Sets beyond the wide sketch's limit, of neighbouring widths, on either side of the threshold."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1030)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:1020]))]
    for i, n in enumerate((5, 20, 22, 24, 26, 40), 2):
        copy = list(base)
        for j in range(n):
            copy[20 + j * 24] = f"x{i}y{j}"
        rows.append((i, " ".join(copy)))
    rows += [(i + 10, t) for i, t in rows]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), turns=0, frequent=2)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(1000, 1040)] + [(0, i) for i in range(1, 50)] + [tuple(sorted(rng.sample(range(2000, 2100), 2))) for _ in range(70)]
    with common.Scratch(spark, "test") as scratch:
        found = graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), scratch)
        got = {r["node"]: r["component"] for r in found.collect()}
    parent = {}
    for a, b in pairs:
        for x in (a, b):
            parent.setdefault(x, x)
    change = True
    while change:
        change = False
        for a, b in pairs:
            m = min(parent[a], parent[b])
            change |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert got == parent


# 8: repeated substrings


def brute_substrings(rows, length):
    count = collections.Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
    out = []
    for d, b in data:
        hit = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                hit[p] += 1
                hit[p + length] -= 1
        gone = np.cumsum(hit[:-1]) > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone]) if b else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"budget": 1000, "shard_bytes": 10_000, "split_from": 1}])
def test_substring_dedup(plain, options):
    short = plain.where("length(text) < 20000 or text is null")
    got = substring_dedup.dedup_substrings(short, length=200, **options)
    assert sorted(map(tuple, got.collect())) == brute_substrings(rows_of(short), 200)


@pytest.mark.parametrize("most,ways,length", [(1, 14, 200), (3, 2, 201), (20, 3, 64)])
def test_substring_dedup_crowds(plain, monkeypatch, most, ways, length):
    """Segments that agree on a side are cut into pieces, down to single windows; results stay exact."""
    monkeypatch.setattr(substring_dedup, "WAYS", ways)
    short = plain.where("length(text) < 20000 or text is null")
    got = substring_dedup.dedup_substrings(short, length=length, most=most)
    assert sorted(map(tuple, got.collect())) == brute_substrings(rows_of(short), length)


def test_substring_dedup_common_passage(spark, monkeypatch):
    """A passage of very many different texts doesn't bring them all to one shard."""
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choices("abcdefghijkl ", k=n))
    passage = prose(250)
    docs = spark.createDataFrame([(i, prose(30) + passage + prose(30)) for i in range(3000)], "doc_id long, text string").repartition(3)
    met, sort_shards = [0], substring_dedup.sort_shards

    def watched(dealt, *rest):
        met.append(dealt.groupBy("shard", "gram").count().agg(F.max("count")).first()[0] or 0)
        return sort_shards(dealt, *rest)

    monkeypatch.setattr(substring_dedup, "sort_shards", watched)
    got = substring_dedup.dedup_substrings(docs, length=100).collect()
    assert all(r["n_removed"] >= 250 and r["n_spans"] == 1 for r in got)
    assert sorted(map(tuple, got)) == brute_substrings(rows_of(docs), 100)
    assert max(met) <= 2000


def test_op8_passages_around_400_bytes(spark, tmp_path):
    """A repeated passage of over 50 words goes if it has 400 bytes and stays if it has 399; n_bytes is the input's length."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for size in (399, 400):
        passage = ("".join(rng.choice("abcdefgh") + rng.choice("ijkl") + " " for _ in range(200)))[:size]
        assert len(passage.split()) > 50
        rows += [(len(rows) + i, f"{prose(50)}{left}{passage}{right}{prose(70)}") for i, (left, right) in enumerate(("12", "34"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[:4] for r in queries.op8_substring_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 521, 0, 0), (1, 521, 0, 0), (2, 522, 400, 1), (3, 522, 400, 1)]


def test_substring_dedup_repeated_rows(docs):
    got = substring_dedup.dedup_substrings(docs)
    assert got.count() == docs.count()


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
@pytest.mark.parametrize("budget,block", [(200, 3), (1 << 20, 1 << 20)])
def test_suffix_array(letters, budget, block):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 8, 50, 700):
        for data in (rng.integers(0, letters, n).astype(np.uint8), np.tile(rng.integers(0, letters, n // 7 + 1), 8)[:n].astype(np.uint8)):
            raw = data.tobytes()
            want = sorted(range(n), key=lambda i: raw[i:])  # noqa: B023
            assert induced_sort.suffix_array(data, budget, block).tolist() == want
            assert induced_sort.order_names(data.astype(np.int64), budget, 3).tolist() == want
            for length in (2, 5, 40):
                marked = rng.random(n) < 0.7
                marked[max(0, n - length + 1) :] = False
                count = collections.Counter(raw[i : i + length] for i in range(n) if marked[i])
                got = induced_sort.repeated_starts(data, marked, length, budget, block)
                assert got.tolist() == [i for i in range(n) if marked[i] and count[raw[i : i + length]] > 1]


def test_carried_prefixes():
    """Every suffix comes with its common prefix with the one given out before it."""
    data = np.frombuffer(b"abracadabra-abracadabra-cadabra" * 3, dtype=np.uint8)
    raw, found = data.tobytes(), []
    induced_sort.fall(data, lambda part: found.extend(part[["pos", "lcp"]].tolist()), 9, 300, 4)
    for (p, _), (q, n) in zip(found, found[1:]):
        assert n == min(9, next((i for i in range(len(raw)) if raw[p : p + i + 1] != raw[q : q + i + 1] or max(p, q) + i >= len(raw)), 0))


def test_sorter_s_memory_is_bounded(tmp_path):
    """A text in a file, tuples forty times the budget: queues spill, and a task holds the orders of
    LMS names (some arrays of 8 bytes for each third character) but no tuples of the text."""
    import tracemalloc

    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 400_000).astype(np.uint8)
    data[300_000:300_900] = data[1000:1900]
    data.tofile(tmp_path / "text")
    mapped = np.memmap(tmp_path / "text", dtype=np.uint8, mode="r")
    marked = np.ones(len(data), dtype=bool)
    marked[-400:] = False
    tracemalloc.start()
    got = induced_sort.repeated_starts(mapped, marked, 400, budget=200_000, block=10_000)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got.tolist() == [*range(1000, 1501), *range(300_000, 300_501)]
    assert peak < 36 * len(data)
    unbounded = 3 * induced_sort.TUPLE.itemsize * len(data)
    tracemalloc.start()
    induced_sort.repeated_starts(mapped, marked, 400)
    _, whole = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert whole > peak + unbounded // 3


def test_anchors_across_chunks():
    """Windows have the anchor of the whole text wherever a chunk ends."""
    data = np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8)
    spread = lambda found: {start: (int(g), int(at)) for g, lo, hi, at in zip(*found) for start in range(lo, hi + 1)}
    want = spread(substring_dedup.anchors(data, 200))
    for chunk in (1, 7, 700, 4801):
        assert spread(substring_dedup.anchors(data, 200, chunk)) == want
    assert len(want) == 4801


# 9: packing


def test_packing(docs):
    got = packing.best_fit_pack(docs, capacity=256, slots=4, rows_per_task=40).collect()
    path, _ = packing.public_files()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t in rows_of(docs):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) % 256 or 256) if start == 0 else 256
            want[d, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start, piece = start + n, piece + 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) <= 1.1 * sum(r["length"] for r in got) / 256 + 2


def test_open_bins_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # the fullest bin that holds it
    assert bins.put(5) == (2, 0)  # bin 1 is full and closed, so a slot is free
    assert bins.put(9) == (3, 0)  # no slot: the fullest, bin 0, closes
    assert bins.put(4) == (2, 5)


def test_remembered_ids_equal_the_model_s():
    """Words, white space of every kind, marks, scripts and the added token's name."""
    encoder = packing.encoder(*packing.public_files())
    odd = ["<|endoftext|> a", "  two\n\n three\t", "日本語 😀 naïve", "don't it's we'll 'S", "\r\n \u00a0x", "a\x1cb\x85c\u2028d\u3000 e", "१२३ ½ x²", "e\u0301 \u200d\ufeff", "x" * 5000, " " * 3000 + "y", "\n" * 2000]
    rng = random.Random(6)
    odd += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x2000, 0x2100), rng.randrange(0xE000, 0x11000)])) for _ in range(200)) for _ in range(100)]
    for t in [x for x in texts() if x] + odd:
        assert encoder.ids(t) == encoder.whole(t)


# 10 and 7: counts


def test_text_counts():
    rng = random.Random(1)
    for _ in range(200):
        words = rng.choices("ab", k=rng.randint(0, 40)) if rng.random() < 0.5 else rng.choices("abcdefgh", k=rng.randint(0, 80))
        seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert text_stats.repeated_words(words) == len(hit)
    assert text_stats.duplicate_lines(["a", " ", "a", " ", "b", "a"]) == 2


def brute_viterbi(field, x):
    import itertools

    emit = x @ np.array(field.state)
    best = None
    for labels in itertools.product([False, True], repeat=len(x)):
        score = sum(e for e, junk in zip(emit, labels) if junk) - field.start * labels[0]
        score -= field.change * sum(a != b for a, b in zip(labels, labels[1:]))
        if best is None or score > best[0] + 1e-12:
            best = (score, labels)
    return list(best[1])


def test_viterbi():
    rng, field = np.random.default_rng(2), quality_rules.LineField()
    for n in (1, 2, 5, 9):
        for _ in range(20):
            x = rng.random((n, len(field.state)))
            assert field.decode(x).tolist() == brute_viterbi(field, x)


def test_field_likelihood_and_gradient():
    """Forward and backward sums against all labellings and against differences."""
    import itertools

    rng, d = np.random.default_rng(3), 3
    lengths = [1, 4, 2]
    x, on, y = np.zeros((3, 4, d)), np.zeros((3, 4), dtype=bool), np.zeros((3, 4), dtype=bool)
    for i, n in enumerate(lengths):
        x[i, :n], on[i, :n], y[i, :n] = rng.normal(size=(n, d)), True, rng.random(n) < 0.5
    theta = rng.normal(size=d + 2)

    def score(rows, labels):
        return sum(rows[t] @ theta[:d] for t, v in enumerate(labels) if v) - theta[-1] * labels[0] - theta[-2] * sum(a != b for a, b in zip(labels, labels[1:]))

    want = 0.0
    for i, n in enumerate(lengths):
        every = [score(x[i], c) for c in itertools.product([0, 1], repeat=n)]
        want += score(x[i], y[i, :n].astype(int)) - np.logaddexp.reduce(every)
    value, grad = quality_rules.likelihood(theta, x, y, on)
    assert value == pytest.approx(want)
    for j in range(d + 2):
        step = np.zeros(d + 2)
        step[j] = 1e-5
        slope = (quality_rules.likelihood(theta + step, x, y, on)[0] - quality_rules.likelihood(theta - step, x, y, on)[0]) / 2e-5
        assert grad[j] == pytest.approx(slope, abs=1e-5)


def test_field_is_learned(spark, labelled):
    docs, labels = labelled
    field = quality_rules.fit_field(docs, labels, per_class=150)
    got = quality_rules.quality_rules(docs, field=field, least_words=0).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in got) > 0.95 * len(got) > 0
    assert quality_rules.fit_field(docs, labels.where("quality = 1")) == quality_rules.LineField()


def best_labels(field, x):
    """Most probable labels by keeping the best sequence that ends in each label."""
    best = {False: (0.0, [False]), True: (float(x[0] @ np.array(field.state)) - field.start, [True])}
    for row in x[1:]:
        e = float(row @ np.array(field.state))
        best = {b: max(((v + e * b - field.change * (a != b), [*seq, b]) for a, (v, seq) in best.items()), key=lambda c: c[0]) for b in (False, True)}
    return max(best.values(), key=lambda c: c[0])[1]


def test_quality_rules(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == docs.count()
    by, field = collections.Counter(), quality_rules.LineField()
    for d, t in rows_of(docs):
        w, lines = WORD.findall(t or ""), (t or "").split("\n")
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = len({j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        twice = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        failed = len(w) < 20 or 100 * again > 30 * len(w)
        x, sizes = quality_rules.line_rows(t or "")
        junk = best_labels(field, x) if len(x) else []
        kept = not failed and 2 * sum(n for n, j in zip(sizes, junk) if not j) >= sum(sizes)
        by[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), twice, again, failed, kept] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert collections.Counter(tuple(r[c] for c in names) for r in got) == by
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    junk = " ".join(f"{w}***" for w in "many words in this line are followed by symbols which nobody would ever read as prose text at all".split())
    prose = "These are plain sentences, with some words in each of them. They are what a reader would want to keep, so they stay in the corpus."
    field = quality_rules.LineField()
    assert not quality_rules.judge(junk, field, 10, 30, 0.5)[6] and quality_rules.judge(prose, field, 10, 30, 0.5)[6]


# 1 and 7: models


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        words = rng.choices(vocabulary, k=rng.randint(10, 120))
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "qzuk" + rng.choice(vocabulary)]))
        if not good:
            words = [w + rng.choice(["***", "%%%", "$$"]) for w in words]
        rows.append((i, ". ".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9))))
        labels.append((i, good, toxic))
    rows += [(10_000, None), (10_001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    return sum(r["predicted"] == r[column] for r in rows) / len(rows)


def test_toxicity(labelled):
    docs, labels = labelled
    grammar = toxicity.fit(docs, labels)
    assert any("qzuk".startswith(s[:4]) for s in grammar.stems)
    scored = toxicity.score_documents(docs, grammar)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").isEmpty()
    assert accuracy(scored, labels, "toxic") > 0.97
    for r in scored.where("doc_id < 50").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_toxicity_reads_joined_words():
    grammar = toxicity.seed_grammar()
    found = lambda t: [[y for y, _ in path] for _, path in grammar.clauses(t)]
    assert found("All is fine.Idiot") == found("a total-idiot") == found("an idiot2") == [["i"]]
    assert found("you/idiot") == [["I"]] and found("it isn't_stupid") == [["i-"]]


def test_toxicity_grammar_composes():
    grammar = toxicity.seed_grammar()
    found = lambda t: [(round(w, 3), [y for y, _ in path]) for w, path in grammar.clauses(t)]
    assert found("You are an idiot. All is well.") == [(5.5, ["I"])]
    assert found("An idiot, you see") == [(5.5, ["I"])]  # the target may follow
    assert found("You all went home and then met one more idiot") == [(4.0, ["i"])]  # out of reach
    assert found("He is not an idiot but a moron") == [(2.5 + 4.0, ["I-", "i"])]  # a negation reaches three words
    assert found('Someone said "what an idiot"') == found('"What an idiot", someone said') == [(1.5, ["i~"])]
    assert found("I will kill time") == [(2.5, ["h"])] and found("I will kill you") == [(5.5, ["H"])]
    assert found("you kill time") == [(2.5, ["h"])]  # a target before a threat isn't what it is aimed at
    assert found("") == [] and grammar.features(None) == grammar.features("")


def test_toxicity_best_path_equals_enumeration():
    """Every path through every machine in turn, for all short clauses."""
    import itertools

    def runs(machine, symbols):
        live = [(0, (), 0.0)]
        for x in symbols:
            live = [(nxt, (*out, y), w + v) for state, out, w in live for y, v, nxt in machine.step(state, x)]
        return [(out, w) for state, out, w in live if state in machine.final]

    weights = {"i": 4.0, "h": 3.0}
    clauses = [c for n in range(5) for c in itertools.product("oihtnr", repeat=n)]
    rng = random.Random(0)
    clauses += [tuple(rng.choices("ooihtnr", k=8)) for _ in range(150)]
    for clause in clauses:
        paths = [(clause, 0.0)]
        for machine in toxicity.machines():
            paths = [(out, w + v) for symbols, w in paths for out, v in runs(machine, symbols)]
        own = sum(weights.get(x, 0.0) for x in clause)
        best = toxicity.best_path(toxicity.composition(), list(clause), [weights.get(x, 0.0) for x in clause])
        assert best[0] == pytest.approx(max(w for _, w in paths) + own)
        assert sum(w for _, w in best[1]) == pytest.approx(best[0])


def test_quality_classifier(labelled):
    docs, labels = labelled
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score_documents(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").isEmpty()
    assert accuracy(scored, labels, "quality") > 0.97


def test_models_score_every_row_by_its_text(docs, labelled):
    """The queries' rows against each row scored alone: nulls, repeated rows, long texts, clashing columns."""
    sample, labels = labelled
    grammar, ranking = toxicity.fit(sample, labels), quality_classifier.fit(sample, labels)
    rank = lambda t: float(ranking.score(np.array([quality_classifier.features(t)]))[0])
    for found, score, folds, fold, least in (
        (toxicity.score_documents(docs, grammar), grammar.score, 3, 1, 0.7),
        (quality_classifier.score_documents(docs, ranking), rank, 5, 0, 0.3),
    ):
        held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % folds == fold  # noqa: E731, B023
        want = collections.Counter((d, held(d), round(score(t), 9), int(score(t) >= least)) for d, t in rows_of(docs))
        assert collections.Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in found.collect()) == want


def test_pairwise_ranking_is_the_optimum():
    """The gradient of the penalised logistic loss of the differences vanishes."""
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.5, 1, (60, 4)), rng.normal(0, 1, (50, 4))
    mean, scale, weights = quality_classifier.bradley_terry(good, bad, 3000, 1, l2=1e-2)
    both = np.random.default_rng(1)
    i, j = both.integers(60, size=3000), both.integers(50, size=3000)
    diff = (good[i] - bad[j]) / scale
    loss = lambda w: np.logaddexp(0, -diff @ w).mean() + 0.005 * w @ w
    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        assert abs(loss(weights + step) - loss(weights - step)) / 2e-4 < 1e-5


def test_quality_ranking_takes_all_pairs(labelled):
    """Weights, cut and gain against all pairs of the training rows in memory: 40,000 drawn ones give other weights."""
    from tonegrid.llm import logistic

    docs, labels = labelled
    model = quality_classifier.fit(docs, labels)
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(label[i], quality_classifier.features(t)) for i, t in rows_of(docs) if i in label and zlib.crc32(str(i).encode()) % 5]
    good, bad = (np.array([x for y, x in rows if y == one]) for one in (1, 0))
    both = np.concatenate([good, bad])
    assert len(good) * len(bad) > 80_000
    assert model.mean == pytest.approx(both.mean(0)) and model.scale == pytest.approx(both.std(0) + 1e-6)
    diff = ((good[:, None] - bad[None]) / model.scale).reshape(-1, both.shape[1])
    want = logistic.fit(diff, np.ones(len(diff)), l2=1e-3)
    assert model.weights == pytest.approx(want, abs=1e-3)
    strength = np.sort(model.strength(both))
    assert model.cut == pytest.approx(strength[len(bad) - 1 : len(bad) + 1].mean(), abs=1e-12)
    assert model.gain == pytest.approx(8 / (np.median(model.strength(good)) - np.median(model.strength(bad))))


def test_quality_ranking_reads_all_labelled_rows(spark):
    """More than 4,000 training rows a label, equal texts under both labels, equal strengths at the cut."""
    rows = [(i, "word " * (5 + i % 7) + "$" * (i % 3), int((i % 7 + i % 5) > 4)) for i in range(15_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    x = {t: quality_classifier.features(t) for t in {t for _, t, _ in rows}}
    train = [(x[t], y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    z, y = np.array([a for a, _ in train]), np.array([b for _, b in train])
    assert min(y.sum(), len(y) - y.sum()) > 4000
    assert model.mean == pytest.approx(z.mean(0)) and model.scale == pytest.approx(z.std(0) + 1e-6)
    strength, low = np.sort(model.strength(z)), int(len(y) - y.sum())
    assert model.cut == (strength[low - 1] + strength[low]) / 2
    found = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    for i, t, _ in rows[:200]:
        assert found[i]["score"] == pytest.approx(float(model.score(np.array([x[t]]))[0]), abs=1e-9)


def test_quality_classes_of_odd_rows(spark, docs, labelled):
    """The query's way, each text read once, against fit and score: nulls, repeated rows, no labels, one label, no rows."""
    sample, labels = labelled
    both = docs.select("doc_id", "text").unionByName(sample)
    rows = lambda df: collections.Counter((r["doc_id"], r["held_out"], round(r["score"], 6), r["predicted"]) for r in df.collect())
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 2)], "doc_id long, quality int")
    for known in (labels.select("doc_id", "quality").unionByName(odd), labels.limit(0), labels.where("quality = 1")):
        got = quality_classifier.classify(both, known)
        assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        assert rows(got) == rows(quality_classifier.score_documents(both, quality_classifier.fit(both, known)))
        assert got.count() == both.count()
    assert quality_classifier.classify(both.limit(0), labels).collect() == []


def test_pairs_on_a_coarser_grid(spark, monkeypatch):
    """Where more grid points than the driver takes have rows, the step doubles and all pairs still count."""
    monkeypatch.setattr(quality_classifier, "MOST_POINTS", 100)
    rng, n = np.random.default_rng(6), quality_classifier.N_FEATURES
    good, bad = rng.normal(0.3, 1, (70, n)), rng.normal(0, 1, (60, n))
    rows = [(1, x.tolist()) for x in good] + [(0, x.tolist()) for x in bad]
    model = quality_classifier.Ranking(np.zeros(n), np.ones(n), np.full(n, 0.2), 0.0, 1.0, 0.5)
    few, many, step = quality_classifier.sides(spark.createDataFrame(rows, "label int, x array<double>"), model, 1 / 64)
    assert step > 1 / 64 and len(few.points) + len(many.points) <= 100
    assert few.rows.sum() == pytest.approx(60) and many.rows.sum() == pytest.approx(70)
    lead = model.strength(good)[:, None] - model.strength(bad)[None]
    assert quality_classifier.sum_pairs(few, many, step)[0] / 4200 == pytest.approx(np.logaddexp(0, -lead).mean(), abs=step**2 / 10)
    assert many.wrong @ many.rows / 4200 == pytest.approx((1 / (1 + np.exp(lead))).mean(), abs=step**2 / 40)


def test_values_at_ranks(spark):
    """Ties, zeros of both signs and neighbouring doubles; a few cells, so that ranges narrow many times."""
    rng = np.random.default_rng(8)
    values = [0.0, -0.0, 1.0, np.nextafter(1.0, 2), -1e300, 1e300, *rng.normal(size=60).tolist(), *([0.25] * 40)]
    rows = spark.createDataFrame([(int(i % 3 == 0), float(v)) for i, v in enumerate(values)], "label int, s double")
    for cells in (2, 4096):
        asked = [(F.lit(True), r) for r in range(0, len(values), 9)] + [(F.col("label") == 1, r) for r in (0, 5, 20)]
        some = sorted(v for i, v in enumerate(values) if i % 3 == 0)
        assert quality_classifier.values_at(rows, asked, cells) == [sorted(values)[r] for r in range(0, len(values), 9)] + [some[r] for r in (0, 5, 20)]


def test_models_without_labels(labelled):
    docs, labels = labelled
    none = labels.limit(0)
    assert toxicity.score_documents(docs, toxicity.fit(docs, none)).count() == docs.count()
    assert quality_classifier.score_documents(docs, quality_classifier.fit(docs, none)).count() == docs.count()


# 2: urls


def brute_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        domain, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == domain or host.endswith("." + domain)) and path.startswith(start):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return best


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    hosts = [f"{a}.example.{b}" for a in ("x", "WWW.y", "spam", "good") for b in ("com", "net", "org")] + ["example.net", "net", "bad.test", "far.test"]
    rows = []
    for i in range(200):
        links = "".join(f'<a class="x" href="https://{rng.choice(hosts)}/q">l</a>' for _ in range(rng.randint(0, 4)))
        body = rng.choice(["same", "same", "", None, f"page {i} ü {links}", links])
        rows.append((i, rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(["", "/", "/en/1", "/de/2?x=/fr/", "/fr/3#a", "?q=1", "#z", "/a://b/c"]), body, 7))
    rows += [(1000, None, None, 1), (1001, "no scheme", "x", 1), (1002, "://", "x", 1), (None, "http://a.org/fr/", "same", 1), rows[3]]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host int")


def test_url_filter(pages):
    got = url_filter.filter_urls(pages)
    assert got.count() == pages.count()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    verdicts = collections.defaultdict(set)
    for r in got.collect():
        url = urls[r["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        assert (r["host"], r["path"]) == (lower(host), path)
        rule = brute_rule(lower(host), path)
        assert r["rule"] == (rule[0] if rule else None)
        if rule:
            assert r["verdict"] == rule[1]
        else:
            verdicts[r["host"]].add(r["verdict"])
    assert all(len(v) == 1 for v in verdicts.values()) and verdicts[""] == {"allow"}


def test_propagation_is_personalised_pagerank(spark):
    """A cycle, a host that links nowhere, one that nothing links to: against the fixed point."""
    edges = [("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("c", "a", 1), ("d", "c", 3), ("b", "e", 4)]
    hosts = [("a", 1, 0), ("b", 0, 0), ("c", 0, 2), ("d", 0, 0), ("e", 0, 1), ("f", 0, 0)]
    with common.Scratch(spark, "test") as scratch:
        found = url_filter.propagate(
            spark.createDataFrame(hosts, "host string, seed_trust int, seed_block int"), spark.createDataFrame(edges, "src string, dst string, n int"), scratch, tolerance=1e-4
        )
        got = found.collect()
    names = "abcdef"
    flow = np.zeros((6, 6))
    for s, d, n in edges:
        flow[names.index(s), names.index(d)] = n

    def ranks(m, seed):
        m = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        seed = np.array(seed, dtype=float) / sum(seed)
        x = seed
        for _ in range(400):
            moved = 0.85 * x @ m
            x = moved + (1 - moved.sum()) * seed
        return x

    trust, distrust = ranks(flow, [1, 0, 0, 0, 0, 0]), ranks(flow.T, [0, 0, 2, 0, 1, 0])
    assert len(got) == 6
    for r in got:
        i = names.index(r["host"])
        assert r["trust"] == pytest.approx(trust[i], abs=1e-3) and r["distrust"] == pytest.approx(distrust[i], abs=1e-3)


def test_url_filter_takes_extreme_urls(spark):
    dots, path = "a." * 50_000 + "net", "/x" * 100_000
    rows = [(1, f"http://{dots}/", None), (2, f"http://example.net{path}?q", "<a href='http://" + "b" * 70_000 + ".org/'>x</a>")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["host"] == dots and got[1]["rule"] == "net/" and got[2]["path"] == path and got[2]["rule"] == "net/"


def test_url_filter_equals_its_sql(spark, pages, tmp_path):
    import duckdb

    from tonegrid.llm.queries import ORACLES

    pages.where("page_id is not null").dropDuplicates(["page_id"]).write.parquet(f"{tmp_path}/p")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    want = con.execute(ORACLES["op2_url_filter"]).fetchall()
    got = url_filter.filter_urls(spark.read.parquet(f"{tmp_path}/p")).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_link_graph_blocks_neighbours(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/'>x</a>" for h in hosts)
    rows = [
        (1, "http://seed.org/fr/a", link("friend.test")),
        (2, "http://friend.test/", ""),
        (3, "http://farm.test/", link("evil.net", "evil.net")),
        (4, "http://evil.net/x", None),
        (5, "http://apart.test/", ""),
    ]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow"}


# 5: WARC


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(pages, least):
    got = warc.warc_round_trip(pages, least=least, archive_bytes=2000).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in rows:
        if len(b) >= least and i is not None:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, b in rows:
        f = first.get(b)
        again = f is not None and i != f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_warc_file_is_standard_zstd(pages, tmp_path):
    import glob
    import struct

    import zstandard

    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=4000)
    files = glob.glob(str(tmp_path / "w" / "part-*"))
    assert len(files) > 1
    for f in files:
        raw = open(f, "rb").read()
        magic, n = struct.unpack_from("<II", raw)
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True)
        assert stream.read().startswith(b"WARC/1.1\r\n")


def test_archives_end_by_bytes(spark, tmp_path):
    """Pages far beyond an archive's size have one of their own; no archive holds much more than its limit."""
    import glob
    import os

    rng = random.Random(8)
    noise = lambda n: "".join(chr(rng.randrange(32, 0x3000)) for _ in range(n))
    rows = [(i, f"http://h/{i}", noise(400_000 if i == 3 else rng.randrange(0, 3000))) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=30_000, sample_bytes=20_000)
    sizes = sorted(os.path.getsize(f) for f in glob.glob(str(tmp_path / "w" / "part-*")))
    assert len(sizes) > 2 and sizes[-1] > 400_000 and sizes[-2] < 30_000 + 70_000
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert {r["page_id"]: r["payload_bytes"] for r in got} == {i: len(t.encode()) for i, _, t in rows}


# ids and settings


BIG = 1 << 60


def test_large_ids_beside_nulls(spark):
    """64-bit ids beyond what a double holds, beside a null in one partition, come back as they went in."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(BIG + 1, words), (None, "none at all " + words), (BIG + 3, words.upper() + " end"), (BIG + 5, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", t) for i, t in rows], "page_id long, url string, html string").coalesce(1)
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 3, 0, 1)], "doc_id long, quality int, toxic int")
    want = sorted((i for i, _ in rows), key=str)
    for out in (
        toxicity.score_documents(docs, toxicity.fit(docs, labels)),
        exact_dedup.exact_dedup(docs),
        source_mixing.mix_sources(docs.withColumn("source", F.lit("s"))),
        ngram_join.ngram_join(docs),
        quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels)),
        substring_dedup.dedup_substrings(docs, length=40),
        packing.best_fit_pack(docs),
        quality_rules.quality_rules(docs),
    ):
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == want
    for out in (warc.warc_round_trip(pages), url_filter.filter_urls(pages)):
        assert sorted((r["page_id"] for r in out.collect()), key=str) == want
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs).where("doc_id is not null").collect()}
    assert found == {BIG + 1: BIG + 1, BIG + 3: BIG + 1, BIG + 5: BIG + 5}
    assert {r["page_id"] for r in warc.warc_round_trip(pages).collect() if r["refers_to"] is not None} == {None}


def test_operators_leave_settings_and_folders_alone(spark, labelled):
    import os

    docs, labels = labelled
    docs = docs.withColumn("source", F.lit("s"))
    shared = common.shared_dir(spark)
    before = {k: v for k, v in spark.sparkContext._conf.getAll()}, spark.sql("SET").collect()
    for out in (ngram_join.ngram_join(docs), source_mixing.mix_sources(docs), packing.best_fit_pack(docs), substring_dedup.dedup_substrings(docs)):
        out.count()
    assert before == ({k: v for k, v in spark.sparkContext._conf.getAll()}, spark.sql("SET").collect())
    left = os.listdir(shared)
    assert not [x for x in left if x.startswith(("jaccard-", "mix-")) and "result" not in x and "plan" not in x]


# empty tables


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        exact_dedup.exact_dedup(docs),
        source_mixing.mix_sources(docs),
        ngram_join.ngram_join(docs),
        substring_dedup.dedup_substrings(docs),
        packing.best_fit_pack(docs),
        quality_rules.quality_rules(docs),
        toxicity.score_documents(docs, toxicity.fit(docs, labels)),
        quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels)),
        url_filter.filter_urls(pages),
        warc.warc_round_trip(pages),
    ):
        assert out.collect() == []


def test_lower_az(spark):
    row = spark.createDataFrame([("ABCz ÄÉİ",), ("ABC",), (None,)], "t string").select(common.lower_az(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in row] == ["abcz ÄÉİ", "abc", ""]


def test_rounds_of_ranks_grow_in_line(spark):
    """A round adds the same number of exchanges to a plan, however many came before; ranks pass along thirty hosts."""
    names = [f"h{i:02d}.test" for i in range(31)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in zip(names, names[1:], strict=False)], "src string, dst string, n int")
    hosts = spark.createDataFrame([(h, int(i == 0), int(i == 30)) for i, h in enumerate(names)], "host string, seed_trust int, seed_block int")
    sizes = {}

    class Watched(common.Scratch):
        def write(self, df, name):
            if name == "score":
                sizes.setdefault(every, []).append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
            return super().write(df, name)

    for every in (4, 8, 16):
        with Watched(spark, "test") as scratch:
            got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(hosts, edges, scratch, every=every).collect()}
    per_round = [max(sizes[n]) / (n - 1) for n in (4, 8, 16)]
    assert max(per_round) <= 1.3 * min(per_round) and max(per_round) < 8
    shares = np.array([0.85**i for i in range(31)])
    shares /= shares.sum()
    for i, h in enumerate(names):
        assert got[h][0] == pytest.approx(shares[i], abs=1e-4) and got[h][1] == pytest.approx(shares[30 - i], abs=1e-4)


def test_links_of_every_kind(spark):
    html = "<a href='//b.test/x'>x</a><area shape=rect href=https://C.test><A\nHREF = \"ftp://d.test/\"><a href='/local'><a href='mailto:x@e.test'><link href='//f.test/'><abbr href='//g.test/'>"
    pages = spark.createDataFrame([("http://a.test/", html)], "url string, html string")
    got = url_filter.host_edges(pages, url_filter.host_of(F.col("url")), "html").collect()
    assert sorted((r["dst"], r["n"]) for r in got) == [("b.test", 1), ("c.test", 1), ("d.test", 1)]

"""The filter audit, vector codes and BPE against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import bpe, common, filter_audit, vector_codes
from tonegrid.llm import queries as llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11: filter audit


def audit_docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n, some=400: " ".join(rng.choices(words[:some], k=n))
    texts = [None, "", " \t\n", "A" * 50, "a\x1cb", prose(20_000), prose(120, 3), prose(99), prose(100) + " #", "É" * 9 + "A", "ÉA"]
    texts += [rng.choice([str, str.upper])(prose(rng.randint(80, 130), rng.choice([3, 400]))) + rng.choice(["", " 50%", " a|b"]) for _ in range(60)]
    texts += rng.choices(texts, k=60) + [texts[20]] * 40
    rows = [(i * 2, t, rng.choice(["en", "de", None, ""]), 0, "x", 7) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[3], rows[3], (None, texts[20], "en", 0, "x", 7), (None, None, "de", 0, "x", 7), (None, texts[20], "en", 0, "x", 7)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 3)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int, sha string, turn int").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def brute_audit(rows, labels):
    """Every order of the filters applied row by row."""
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, lang, *_ in rows:
        t, w = t or "", WORD.findall(t or "")
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        parts[lang or ""].append((frozenset(f for f in fails if fails[f]), i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, docs in parts.items():
        share, found = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(gone)
                failing = [d for d in docs if f in d[0]]
                found.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r, share[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def test_filter_audit(spark):
    docs, labels, rows, marks = audit_docs(spark)
    got = sorted(map(tuple, filter_audit.audit_filters(docs, labels).collect()))
    assert got == brute_audit(rows, marks)
    other = docs.toDF("key", "body", "kind", "mask", "sha", "turn")
    assert sorted(map(tuple, filter_audit.audit_filters(other, labels.withColumnRenamed("doc_id", "key"), "key", "body", "kind").collect())) == got
    assert filter_audit.audit_filters(docs.limit(0), labels).collect() == []
    assert filter_audit.audit_filters(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("n", [1, 3, 5])
def test_removal_polynomial(n):
    rng = random.Random(n)
    counts = [rng.randint(0, 9) for _ in range(1 << n)]
    poly = filter_audit.Removal(counts, n)
    removed = lambda s: sum(c for m, c in enumerate(counts) if m & s)
    for s in range(1 << n):
        assert (poly.removed(s), poly.survivors(s)) == (removed(s), sum(counts) - removed(s))
    for i in range(n):
        orders = list(itertools.permutations(range(n)))
        marginal = sum(removed(sum(1 << j for j in o[: o.index(i) + 1])) - removed(sum(1 << j for j in o[: o.index(i)])) for o in orders)
        assert poly.shapley(i) == Fraction(marginal, len(orders))
        assert sum(poly.partial(i).values()) == removed((1 << n) - 1) - removed((1 << n) - 1 ^ 1 << i)


# 12: vector codes


def brute_codes(rows, n_parts, size, rounds, scale):
    """(codes and errors in the rows' order, codebooks) by plain integers."""
    points = [[math.floor(scale * float(x)) for x in v] for v in rows]
    width = len(points[0]) // n_parts
    cut = [[p[i * width : (i + 1) * width] for i in range(n_parts)] for p in points]
    books = [[c[i] for c in cut[:size]] for i in range(n_parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(c[i], e), j) for j, e in enumerate(books[i])) for i in range(n_parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for i in range(n_parts):
            for j in range(len(books[i])):
                own = [c[i] for c, f in zip(cut, found, strict=True) if f[i][1] == j]
                if own:
                    books[i][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [([j for _, j in f], sum(d for d, _ in f)) for f in assign()], books


@pytest.mark.parametrize("size,spread", [(256, 1.0), (16, 0.004), (7, 4e5), (7, 4e9)])
def test_vector_codes(spark, monkeypatch, size, spread):
    """Ties (a small spread), fewer rows than entries, components beyond what doubles hold exactly."""
    rng = random.Random(size)
    vec = lambda: [rng.gauss(0, spread) for _ in range(8)]
    rows = [(i * 3, vec(), rng.choice([1, 2, None])) for i in range(150)]
    rows += [rows[4], rows[4], (9, vec(), 2), (None, vec(), 1), (None, vec(), None), (1000, [-0.0] * 8, 1)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    bad = [(5, None, 1), (6, [1.0] * 7 + [None], 1), (7, [math.nan] * 8, 2), (8, [math.inf] + [0.0] * 7, 2), (11, [-math.inf] + [0.0] * 7, None)]
    odd = [(2000, [1.0] * 4, 2), (2001, [], 2), (2002, [1e300] + [0.0] * 7, 1)]
    table = [(*r, 9, b"", 3) for r in rows + bad + odd]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, error int, code binary, v int").repartition(3)
    found, books = vector_codes.compress_vectors(df, size=size)
    want, entries = brute_codes([v for _, v, _ in order], 4, size, 4, 1024)
    code = lambda c: None if c is None else np.frombuffer(bytes(c), "<u2").tolist()
    got = [(r["vec_id"], code(r["code"]), r["error"], r["label"]) for r in found.collect()]
    wanted = [(i, c, e if e < 2**63 else None, label) for (i, _, label), (c, e) in zip(order, want, strict=True)]
    assert sorted(got, key=str) == sorted(wanted + [(i, None, None, label) for i, _, label in odd], key=str)
    assert books.digest() == hashlib.sha256(",".join(str(x) for b in entries for e in b for x in e).encode()).hexdigest()
    sums = collections.defaultdict(list)
    for _, _, e, label in got:
        sums[label].append(e)
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        for r in vector_codes.with_label_error(found).collect():
            held = [e for e in sums[r["label"]] if e is not None]
            assert r["label_error"] == (sum(held) if held and sum(held) < 2**63 else None)
    monkeypatch.undo()
    assert vector_codes.with_label_error(found).count() == len(got)


def test_vector_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    found, books = vector_codes.compress_vectors(empty)
    assert found.collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()


def test_exponion_search():
    """Every start gives the nearest entry of lowest index, among equal entries and equal distances."""
    rng = np.random.default_rng(5)
    entries = rng.integers(-3, 4, (60, 3))
    points = np.concatenate([rng.integers(-5, 6, (400, 3)), entries])
    far = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    for big in (1, 1 << 30):
        search = vector_codes.Exponion(entries * big)
        for start in (np.zeros(len(points), dtype=np.int64), rng.integers(0, 60, len(points)), far.argmin(1)):
            code, best = search.nearest(points * big, start)
            assert code.tolist() == far.argmin(1).tolist()
            assert [int(b) for b in best] == [int(f) * big * big for f in far.min(1)]


# 13: BPE


TRICKY = [
    None, "", " \t\r\n", "Hello, World's it'LL", "a<|endoftext|>b <|startoftext|><|endoftext|>c", "<|endoftext", "x" * 5000, "ab" * 3000, "1234 ½ ٣٤",
    "Été ẹ́ ẛ̣", "ΑΣ ΣΑΣ.", "İstanbul ǅ ß ﬁ", "a b c\u0085d\u001ce​f", "漢字 かな 👩‍👩‍👧 \U0001f600️", "   “quoted” – €5…", "##**  %%%--->", "\x00\x07 \x7f", "'s't're 've'", "naïve façade", "﻿bom",
]


def brute_merge(symbols, rules):
    """One word by the lowest rank, leftmost first."""
    symbols = list(symbols)
    while True:
        found = [(rules[p][0], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in rules]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i : i + 2] = [rules[symbols[i], symbols[i + 1]][1]]


def test_pair_index_equals_word_by_word():
    """Also for rules whose products merge at lower ranks than they are made at."""
    for seed in range(60):
        rng = random.Random(seed)
        rules, made = {}, 4
        for rank in rng.sample(range(40), 12):
            pair = (rng.randrange(made), rng.randrange(made))
            if pair not in rules:
                rules[pair] = (rank, made)
                made += 1
        words = [rng.choices(range(4), k=rng.randint(1, 14)) for _ in range(30)] + [[0] * 30, []]
        coded = {(a << 6) | b: r for (a, b), r in rules.items()}
        got = [np.frombuffer(w, "<u4").tolist() for w in bpe.PairIndex(words, coded, 6).merge()]
        assert got == [brute_merge(w, rules) for w in words]
    assert bpe.PairIndex([], {}, 6).merge() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_bpe_equals_the_library(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = TRICKY + [" ".join(t for t in TRICKY if t) * 30]
    rows = [(i if i % 5 else None, t, 0, "x") for i, t in enumerate(texts)] + [(7, TRICKY[7], 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, id string").repartition(3)
    got = bpe.decode(bpe.encode(docs, path=path), path=path).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.decode(bpe.encode(docs.limit(0))).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [tuple(r) for r in bpe.decode(nulls).orderBy("doc_id").collect()] == [(1, None, ""), (2, [], "")]


def test_memory_of_words_is_bounded(monkeypatch):
    held = bpe.Codec(bpe.public_file())
    monkeypatch.setattr(bpe.Codec, "MOST", 5)
    texts = ["one two three four", "five six seven two", "x" * 200, "eight nine ten eleven twelve thirteen fourteen"]
    for t in [*texts, *texts]:
        ids = np.frombuffer(held.encode([t])[0], "<u4").tolist()
        assert ids == held.tokenizer.encode(t, add_special_tokens=False).ids and len(held.known) <= 5


def test_op13_over_the_whole_table(spark):
    from tokenizers import Tokenizer

    library, data = Tokenizer.from_file(bpe.public_file()), "/root/testdata/sf0.001"
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in common.read(spark, data, "documents").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, llm_queries.op13_bpe(spark, data).collect())) == sorted(want)


def test_new_operators_leave_only_results(spark):
    """Tables of a run go with it; what an operator returns stays."""
    import os

    shared = common.shared_dir(spark)
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, 2.0, -i * 0.5], 1) for i in range(40)], "vec_id long, embedding array<float>, label int")
    before = set(os.listdir(shared))
    found, _ = vector_codes.compress_vectors(df, size=4)
    assert found.where(F.col("code").isNull()).count() == 0
    assert {x.split("-")[1] for x in set(os.listdir(shared)) - before} == {"result"}

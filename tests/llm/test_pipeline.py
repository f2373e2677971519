"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tonegrid.llm import packing, quality_rules, source_mixing

from .test_operators import SCHEMA, WORD, brute_components, brute_times, lower, texts


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows, and the folder of the corpus."""
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i * 3, t, "abc"[i % 3], "clash", 1, 2, "s", 3) for i, t in enumerate(texts(8))]
    rows += [rows[15], rows[16], (None, rows[20][1], None, None, None, None, None, None), (5000, rows[9][1] * 2, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(folder))
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()], docs.columns, after.columns)
        docs = after
    return out, str(folder)


def test_stage_order_and_columns(stages):
    out, _ = stages
    assert list(out) == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]
    for name in list(out)[:-1]:
        assert out[name][3] == SCHEMA.replace(",", "").split(" ")[::2]


def test_quality_stage(stages):
    before, after, *_ = stages[0]["quality_rules"]
    field = quality_rules.LineField()
    want = [r for r in before if quality_rules.judge(r[1], field, 20, 30, 0.5)[6]]
    assert collections.Counter(after) == collections.Counter(want) and 0 < len(want) < len(before)


def test_exact_stage(stages):
    before, after, *_ = stages[0]["exact_dedup"]
    least = {}
    for r in before:
        if r[0] is not None:
            least[lower(r[1])] = min(r[0], least.get(lower(r[1]), r[0]))
    assert sorted(r[0] for r in after if r[0] is not None) == sorted(least.values())
    assert len(after) < len(before)


def test_near_stage(stages):
    before, after, *_ = stages[0]["ngram_jaccard_join"]
    classes = brute_components([(r[0], r[1]) for r in before if r[0] is not None])
    assert sorted(r[0] for r in after if r[0] is not None) == sorted({c for _, _, c in classes})
    assert len(after) < len(before)


def test_mix_stage(stages):
    """Every row as often as brute force takes it."""
    before, after, *_ = stages[0]["mix_sources"]
    want = collections.Counter()
    for d, t, source, times in brute_times([r[:3] for r in before]):
        want[d, t, source] += times
    assert collections.Counter(r[:3] for r in after) == +want


def test_rows_without_an_id(spark):
    """Exact keeps one of a text, none where an id has it; the mix repeats each as often as it takes it."""
    word = lambda i: " ".join(f"w{i}x{j}" for j in range(10))
    rows = [(i, word(i), "ab"[i % 2]) for i in range(6)] + [(None, word(i).upper() if i % 3 else word(i), "ab"[i % 2]) for i in (4, 5, 6, 6, 6, 7, 8, 8, 9)]
    docs = spark.createDataFrame(rows + [(None, word(7), "b")], "doc_id long, text string, source string")
    kept = corpus_pipeline.exact(spark, docs, "")
    got = [(r["doc_id"], lower(r["text"])) for r in kept.collect()]
    assert collections.Counter(got) == collections.Counter([(i, word(i)) for i in range(6)] + [(None, word(i)) for i in range(6, 10)])
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    taken = source_mixing.mix_sources(kept).collect()
    mixed = corpus_pipeline.mix(spark, kept, "").collect()
    for named in (True, False):
        words = sum(len(WORD.findall(r["text"])) for r in mixed if (r["doc_id"] is not None) == named)
        assert words == sum(r["taken"] for r in taken if (r["doc_id"] is not None) == named) > 0


def test_pack_stage(stages):
    """The pieces of every row by the tokenizer itself, in sequences without gaps."""
    before, after, *_ = stages[0]["best_fit_packing"]
    model = Tokenizer.from_file(packing.public_files()[0])
    want = collections.Counter()
    for r in before:
        ids = np.array([*model.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want[r[0], piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter(r[:5] for r in after) == want
    used = collections.defaultdict(list)
    for *_, n, _, sequence, offset in after:
        used[sequence].append((offset, n))
    for items in used.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))] and sum(n for _, n in items) <= 2048


def test_run_equals_the_stages(spark, stages):
    out, folder = stages
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert collections.Counter(r[:5] for r in got) == collections.Counter(r[:5] for r in out["best_fit_packing"][1])


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

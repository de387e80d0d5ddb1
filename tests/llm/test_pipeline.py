from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from quernstone.llm import jaccard, pipeline

from .helpers import ODD, clashing, docs
from .test_tokens_packing_dac import check_packing


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    passage, base = text(80), text(300)
    rows = [(k, text(100), "en" if k % 2 else "de", "s", 1) for k in range(20)]
    rows += [(30, base), (31, base), (32, base.replace(" a", " b", 1)), (33, f"{text(40)} {bench} {text(40)}"), (34, f"{text(60)} {passage} {text(20)}"), (35, f"{text(10)} {passage} {text(70)}"), (36, passage), (37, "123 !!"), (38, None)]
    return rows


def test_stages(spark, sf_dir, planted):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    df, kept = clashing(docs(spark, planted)), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns
        df = pipeline.materialize(out, name)
        kept[name] = {r.doc_id: r.text for r in df.collect()}
    clean = set(range(20))
    assert set(kept["language_id"]) == {d for d, *_ in planted} - {37, 38}
    assert {31} & set(kept["simhash_near_dedup"]) == set() and 30 in kept["simhash_near_dedup"]
    texts = kept["suffix_array_dedup"]
    passage = planted[-3][1]
    assert passage in texts[34] and passage not in texts[35] and 36 not in texts
    assert set(kept["simhash_near_dedup"]) - set(texts) == {36}
    assert set(texts) - set(kept["benchmark_decontamination"]) == {33}
    assert clean <= set(kept["benchmark_decontamination"])
    assert all(kept["benchmark_decontamination"][d] == t for d, t, *_ in planted if d in clean)
    check_packing(pipeline.packing_stage(spark, df, sf_dir).collect(), 1024)


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_tables(spark, sf_dir, rows):
    df = docs(spark, rows)
    for name, stage in pipeline.STAGES:
        df = pipeline.materialize(stage(spark, df, sf_dir), name)
    df.count()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and check_packing(rows, 1024) > 0


@pytest.mark.parametrize(("run", "block"), [(64, 1024), (2, 3)])
def test_near_duplicates_are_all_pairs_of_five_word_jaccard(spark, sf_dir, monkeypatch, run, block):
    monkeypatch.setattr(jaccard, "RUN", run)  # the second compares all keys within tasks, in small blocks
    monkeypatch.setattr(jaccard, "BLOCK", block)
    draw = random.Random(3)
    text = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    line, rows = text(30), []
    for _ in range(30):
        base = text(draw.randrange(5, 300))
        for _ in range(4):
            copy = list(base)
            for _ in range(draw.randrange(1 + len(base) // 20)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(5000)}"
            rows.append((len(rows), " ".join(copy + line if draw.random() < 0.3 else copy)))
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    df = docs(spark, rows)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == dict(enumerate(root))
    assert {r.doc_id for r in pipeline.near_duplicate_stage(spark, df, sf_dir).collect()} == set(root)
    assert 30 <= len(set(root)) < len(rows) - 10


def test_signatures_never_part_similar_sets():
    draw = np.random.default_rng(6)
    for n in (5, 40, 300, 3000):
        for _ in range(60):
            both = draw.integers(0, 2**64, n, dtype=np.uint64, endpoint=False)
            own = [draw.integers(0, 2**64, n // 8, dtype=np.uint64, endpoint=False) for _ in range(2)]
            x, y = (np.unique(np.concatenate((both, o))) for o in own)
            assert jaccard.similar(x, y)
            assert jaccard.may_link(jaccard.signature(x)[None], jaccard.signature(y)[None])[0]
    x, y = (np.unique(draw.integers(0, 2**64, 1000, dtype=np.uint64, endpoint=False)) for _ in range(2))
    assert not jaccard.may_link(jaccard.signature(x)[None], jaccard.signature(y)[None])[0]


def test_links_across_components_equal_all_pairs():
    draw = np.random.default_rng(9)
    base = draw.integers(0, 2**64, (4, 60), dtype=np.uint64, endpoint=False)
    sets = [np.unique(np.concatenate((b[draw.random(60) < 0.95], draw.integers(0, 2**64, 3, dtype=np.uint64, endpoint=False)))) for b in base for _ in range(12)]
    root = draw.integers(0, 30, len(sets))
    a, b = jaccard.linked_across(sets, root)

    def classes(pairs):
        label = list(range(len(sets)))
        for i, j in pairs:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        return label

    same = [(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j]]
    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.similar(sets[i], sets[j])]
    assert classes(same + list(zip(a.tolist(), b.tolist(), strict=True))) == classes(same + [p for p in every if root[p[0]] != root[p[1]]])
    assert 4 < len(a) < len(sets)


def test_near_duplicates_leave_by_row(spark, sf_dir):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (5, text(1)), (5, text(2)), (None, text(1)), (None, text(3)), (None, text(3)), (7, text(4)), (None, text(4) + " more")]
    df = clashing(docs(spark, rows))
    out = pipeline.near_duplicate_stage(spark, df, sf_dir)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, text(1)), (5, text(2)), (None, text(3)), (7, text(4))], key=str)

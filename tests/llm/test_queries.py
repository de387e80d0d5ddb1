from __future__ import annotations

import random
import zlib

import pytest

from quernstone.llm import decontam, queries, simhash
from tests.oracle import assert_same, connect

from .helpers import docs
from .test_dedup import brute_fingerprint, brute_spans, roots


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], connect(sf_dir))


def test_op3_equals_brute_force(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in queries.op3_suffix_array(spark, sf_dir).collect()}
    assert got == brute_spans(table) and got


def test_op9_equals_brute_force(spark, sf_dir):
    table = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    root = roots(len(table), [(a, b) for a in range(len(table)) for b in range(a) if (table[a][1] ^ table[b][1]).bit_count() <= simhash.RADIUS])
    least = {r: min(d for (d, _), x in zip(table, root, strict=True) if x == r) for r in set(root)}
    want = sorted((d, f"{fp:016x}", least[r]) for (d, fp), r in zip(table, root, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, sf_dir).collect()) == want


def test_op8_deals_every_row_once(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op8_sharding(spark, sf_dir).collect()
    raw = lambda t: (t or "").encode()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((r.doc_id, len(raw(r.text)) + 16, zlib.crc32(raw(r.text))) for r in table)
    by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(40)}
    assert all(s == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def brute_leaks(rows, items):
    """By definition: an item laid along a text at any place, equal words counted one by one."""
    import re

    words = lambda t: re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (t or "").lower())
    out = {}
    for d, t in rows:
        w = words(t)
        for i, x in items:
            v = words(x)
            size = min(decontam.WINDOW, len(v))
            for start in range(-len(v) + 1, len(w)) if v else ():
                equal = [0 <= start + k < len(w) and w[start + k] == v[k] for k in range(len(v))]
                if max(sum(equal[k : k + size]) for k in range(len(v) - size + 1)) >= decontam.SHARE * size:
                    out[d, i] = max(out.get((d, i), 0), sum(equal))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_op2_equals_brute_force(spark, seed):
    """Items of 1 to 20 words, some with repeated words, planted with up to a fifth of their words replaced, whole or in part."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20])] + [(50, "go go go stop go go"), (51, "no " * 12)]
    rows = []
    for d in range(60):
        v = draw.choice(items)[1].split()
        for k in draw.sample(range(len(v)), draw.randrange(0, 1 + len(v) // 5)):
            v[k] = "other"
        rows.append((d, " ".join([word() for _ in range(draw.randrange(20))] + v + [word() for _ in range(draw.randrange(20))]), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.find_leaks(docs(spark, rows), bench).collect()}
    want = brute_leaks([(d, t) for d, t, *_ in rows], items)
    # of a window of 13 words three may differ only within two that are sure to be found; what is found is right, and shorter items are all found
    assert set(got) <= set(want) and all(want[k] >= n for k, n in got.items())
    sure = {(d, i) for d, i in want if len(dict(items)[i].split()) < decontam.WINDOW or want[d, i] >= len(dict(items)[i].split()) - 2}
    assert sure <= set(got) and len(sure) > 30

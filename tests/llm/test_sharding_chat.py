from __future__ import annotations

import hashlib
import itertools
import json
import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import chat, sharding

from .helpers import ODD, clashing, docs


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation_is_a_bijection(n, key):
    assert sorted(sharding.permuted(np.arange(n), n, key)) == list(range(n))


def test_permutation_is_about_uniform():
    hits = np.zeros((8, 8))
    for key in range(4000):
        hits[np.arange(8), sharding.permuted(np.arange(8), 8, key)] += 1
    assert abs(hits / 4000 - 1 / 8).max() < 0.03


def matrix(parts, shards, seed):
    before = np.concatenate(([0], np.cumsum(np.array(parts, np.int64)))).astype(np.int64)
    return np.stack([sharding.matrix_row(before, k, shards, seed)[0] for k in range(len(parts))]), before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 12), st.integers(0, 9))
def test_matrix_has_exact_sums(parts, shards, seed):
    m, before = matrix(parts, shards, seed)
    assert m.sum(1).tolist() == parts and (m >= 0).all()
    assert m.sum(0).tolist() == sharding.shard_sizes(sum(parts), shards).tolist()
    for k in range(len(parts)):
        assert sharding.matrix_row(before, k, shards, seed)[1].tolist() == m[:k].sum(0).tolist()


def test_matrix_of_huge_parts():
    m, _ = matrix([3 * 10**11, 7 * 10**11, 10**9, 5], 3, 1)
    assert m.sum(1).tolist() == [3 * 10**11, 7 * 10**11, 10**9, 5] and m.sum(0).max() - m.sum(0).min() <= 1


def test_matrix_of_a_million_parts():
    before = np.concatenate(([0], np.cumsum(np.random.default_rng(2).integers(1, 10**6, 10**6))))
    for k in (0, 1, 499_999, 777_777, 999_998):
        (row, at), (_, after) = (sharding.matrix_row(before, p, 40, 3) for p in (k, k + 1))
        assert row.sum() == before[k + 1] - before[k] and at.sum() == before[k] and (after == at + row).all() and (row >= 0).all()
    row, at = sharding.matrix_row(before, 10**6 - 1, 40, 3)
    assert (row + at == sharding.shard_sizes(int(before[-1]), 40)).all()


def test_matrix_follows_the_law():
    parts, tries = [3, 2, 2], 6000
    want: dict[tuple, int] = {}
    for order in set(itertools.permutations([0] * 3 + [1] * 2 + [2] * 2)):  # part of each row in order of arrival, shards of 4 and 3
        key = tuple(sum(p == k for p in order[:4]) for k in range(3))
        want[key] = want.get(key, 0) + 1
    got: dict[tuple, int] = {}
    for seed in range(tries):
        key = tuple(matrix(parts, 2, seed)[0][:, 0].tolist())
        got[key] = got.get(key, 0) + 1
    total = sum(want.values())
    assert set(got) == set(want)
    assert sum((got[k] - tries * n / total) ** 2 / (tries * n / total) for k, n in want.items()) < len(want) + 5 * (2 * len(want)) ** 0.5


def test_large_draws_follow_the_law():
    draw, good, bad, n, tries = np.random.default_rng(8), 60, 45, 30, 30_000
    got = np.bincount([sharding.ratio_of_uniforms(draw, good, bad, n) for _ in range(tries)], minlength=n + 1)
    want = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) * tries for k in range(n + 1)])
    many = want > 10
    assert ((got - want)[many] ** 2 / want[many]).sum() < many.sum() + 5 * (2 * many.sum()) ** 0.5 and got[~many].sum() < 60


def test_log_probabilities_do_not_cancel():
    for good, bad, n in ((10**12, 3 * 10**12 + 7, 2 * 10**12), (10**13, 10**10, 10**12), (30, 25, 20)):
        k = n * good // (good + bad)
        for step in (1, 5, 4000):
            to = min(k + step, good, n)
            exact = math.fsum(math.log((good - j) / (j + 1)) + math.log((n - j) / (bad - n + j + 1)) for j in range(k, to))
            assert abs(sharding.log_probability(to, good, bad, n) - sharding.log_probability(k, good, bad, n) - exact) < 1e-6


def test_shards_hold_each_row_once(spark):
    rows = sharding.digest(sharding.shard(clashing(docs(spark, ODD)).repartition(3), 4)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {len(s) for s in by.values()} <= {len(ODD) // 4, len(ODD) // 4 + 1}
    raw = lambda t: t.encode() if t else b""
    want = sorted((str(d), len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert "holder" in sharding.shard(clashing(docs(spark, ODD)), 4).columns
    assert sharding.shard(docs(spark, []), 4).count() == 0


TEXT = st.text(alphabet="ab\\#</turn> \n:É", max_size=25)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\", "### x", ""]), TEXT), max_size=5))
def test_render_and_parse(turns):
    out, spans = chat.render(turns)
    assert chat.parse(out) == turns
    assert "".join(chat.unescape(out[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_layouts_are_told_apart_by_their_paths():
    turns = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"turns": [{"author": {"role": "user"}, "content": {"text": "q"}}, {"author": {"role": "assistant"}, "content": {"text": "a"}}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a"},
    ):
        assert chat.canonical_turns(json.dumps(record))[1] == turns
    assert chat.canonical_turns('{"instruction": "q", "input": "x", "output": "a", "system": "s"}')[1] == [("system", "s"), ("user", "q\n\nx"), ("assistant", "a")]
    assert chat.canonical_turns('{"messages": []}') == ("messages", [])
    for odd in (None, "", "[1]", "{", '{"other": 1}', '{"prompt": "q"}'):
        assert chat.canonical_turns(odd) == ("unknown", [])


def test_conversations_read_back(spark):
    rows = [
        (1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, "system", None), (2, 1, "user", "\\### </turn>"), (2, 2, "assistant", "x\\"),
        (3, None, None, None), (3, 0, "gpt", "g"), (4, 0, "user", "é" * 5), (4, 0, "user", "é" * 5), (5, 0, "human", ""), (None, 0, "user", "lone"), (None, 1, "user", "other"),
    ]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", sharding.F.lit(1))
    got = {(r.conv_id, r.turns_sha256): r for r in chat.read_back(chat.format_records(chat.records_from_turns(t))).collect()}

    def key(conv, *turns):
        return conv, hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()

    r = got[key(1, ("user", "one"), ("assistant", "two"))]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, 3, hashlib.sha256(b"two").hexdigest())
    assert got[key(2, ("system", ""), ("user", "\\### </turn>"), ("assistant", "x\\"))].loss_chars == 2
    assert key(3, ("", ""), ("gpt", "g")) in got and key(4, ("user", "ééééé"), ("user", "ééééé")) in got and key(5, ("human", "")) in got
    assert key(None, ("user", "lone")) in got and key(None, ("user", "other")) in got and len(got) == 7
    assert chat.read_back(chat.format_records(chat.records_from_turns(t.limit(0)))).count() == 0

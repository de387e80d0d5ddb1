from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from quernstone.llm import components, decontam, embedding, simhash, suffix, words

from .helpers import ODD, clashing, docs


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    draw = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(draw.randrange(100, 160), draw.randrange(100, 160)) for _ in range(35)] + [(300, 300 + k) for k in range(1, 50)] + [(7, 7)]
    want = roots(400, pairs)
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- vectors


def brute_vectors(rows):
    ok = [(i, np.array(v, float)) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    lab = {id(v): None for _, v in ok}
    del lab
    idx = [k for k, (i, v, la) in enumerate(rows) if la is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = []
    for p, a in enumerate(idx):
        for b in idx[p + 1 :]:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                pairs.append((a, b))
    root = roots(len(rows), pairs)
    n = [sum(k in p for p in pairs) for k in range(len(rows))]
    return sorted((rows[k][0], n[k], min(rows[j][0] for j in range(len(rows)) if root[j] == root[k])) for k in range(len(rows)))


@pytest.mark.parametrize("bucket", [2048, 6])
def test_vectors_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(embedding, "BUCKET", bucket)
    monkeypatch.setattr(embedding, "BLOCK", 4)
    draw = np.random.default_rng(1)
    rows, centre = [], draw.standard_normal((6, 24))
    for k in range(110):
        c = centre[k % 6] * draw.choice([1.0, 3.0])
        noise = 0.0 if k % 7 == 0 else draw.choice([0.05, 0.13, 0.18])
        rows.append((k, (c + noise * np.linalg.norm(c) / 5 * draw.standard_normal(24)).tolist(), int(k % 2)))
    rows += [(200, None, 1), (201, rows[0][1], None), (202, [0.0] * 24, 0), (203, [float("nan")] + [1.0] * 23, 0), (204, [None] + [1.0] * 23, 0), (205, [float("inf")] * 24, 0), (206, rows[0][1], rows[0][2]), (207, rows[0][1], rows[0][2]), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [], 0)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = embedding.near_duplicates(df)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert embedding.near_duplicates(df.where("false")).count() == 0


def test_hashing_finds_pairs_at_the_threshold():
    draw = np.random.default_rng(5)
    x = embedding._units(draw.standard_normal((3000, 64)))
    y = draw.standard_normal((3000, 64))
    y = embedding._units(y - (x * y).sum(1, keepdims=True) * x)
    z = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    shared = (embedding.probes(x)[:, :, :, None] == embedding.probes(z)[:, :, None, :]).any((1, 2, 3))
    assert shared.mean() > 0.995


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(embedding.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embedding.hadamard(embedding.hadamard(x)), x)


# ---- fingerprints


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [t for _, t, *_ in ODD if t is None or len(t) < 1000] + ["one", "One TWO", "a b c d É　e"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def near_fingerprints(draw, n):
    base = [draw.getrandbits(64) for _ in range(n // 8)]
    out = set(base)
    for b in base:
        for _ in range(7):
            x = draw.choice([b, *list(out)[-3:]])
            for bit in draw.sample(range(64), draw.randrange(1, 6)):
                x ^= 1 << bit
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = near_fingerprints(random.Random(bucket), 400)
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    index = {f: k for k, f in enumerate(fps)}
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    assert roots(len(fps), [(index[a], index[b]) for a, b in got]) == want


def test_linked_pairs_in_a_large_run():
    fps = np.array(near_fingerprints(random.Random(9), 800), np.uint64)
    a, b = simhash.linked_pairs(fps, np.array([0, len(fps)]), step=5000)
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3])
    assert roots(len(fps), list(zip(a.tolist(), b.tolist(), strict=True))) == want


def test_pivots_never_discard_a_link():
    draw = np.random.default_rng(2)
    x = draw.integers(0, 2**64, 2000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << draw.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 2000).astype(np.uint64))
    both = np.concatenate((x, y))
    a, _ = simhash._survivors(both, simhash.pivot_table(both), np.arange(2000), np.arange(2000, 4000))
    assert len(a) == 2000


def test_near_duplicates_cases(spark):
    got = simhash.near_duplicates(clashing(docs(spark, ODD))).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[1] + by[2]} == {1} and {by[7][0].component_id} == {7}
    assert 7 in {r.component_id for r in by[8]}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    alone = simhash.near_duplicates(docs(spark, [(None, "some words of a text")])).collect()
    assert alone[0].component_id is None


# ---- passages


def brute_spans(rows):
    texts = {(d, t or ""): re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t, *_ in rows if d is not None}
    least, where = {}, {}
    for d, t in texts:
        least[t] = min(d, least.get(t, d))
    for (d, t), w in texts.items():
        if d == least[t]:  # of equal texts the first
            for s in range(len(w) - 49):
                where.setdefault(b" ".join(w[s : s + 50]), set()).add(d)
    out = set()
    for (d, t), w in texts.items():
        cur = None
        for s in range(len(w) - 49):
            own = where[b" ".join(w[s : s + 50])]
            if len(own) < 2:
                continue
            if cur and s <= cur[1] + 50 and (cur[2] == least[t]) == (min(own) == least[t]):
                cur = [cur[0], s, min(cur[2], *own)]
            else:
                if cur:
                    out.add((d, cur[0], cur[1] + 50 - cur[0], cur[2]))
                cur = [s, s, min(own)]
        if cur:
            out.add((d, cur[0], cur[1] + 50 - cur[0], cur[2]))
        same = {e for (e, _), x in texts.items() if x == w}
        if len(same) > 1 and len(w) >= 50:
            out.add((d, 0, len(w), min(same)))
    return out


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randrange(1, 7)))
    passages = [[word() for _ in range(draw.choice([49, 50, 51, 75, 200]))] for _ in range(8)]
    out = []
    for d in range(40):
        text = [word() for _ in range(draw.randrange(0, 120))]
        for _ in range(draw.randrange(0, 4)):
            p = draw.choice(passages)
            cut = draw.choice([0, 0, 5])
            text += p[cut:] + [word() for _ in range(draw.randrange(0, 60))]
        out.append((d, draw.choice([" ", "\n"]).join(text), "en", "s", 0))
    out += [(100 + k, out[k][1], "en", "s", 0) for k in (0, 3, 3, 7)]
    # ids that occur again: with another text, short, null or with passages of others
    out += [(k, " ".join([word() for _ in range(30)] + draw.choice(passages) + [word() for _ in range(300)]), "en", "s", 0) for k in (1, 2, 2, 9, 103)]
    out += [(k, t, "en", "s", 0) for k, t in ((1, "a few words of it"), (3, None), (9, ""), (4, out[4][1].replace(" ", "  ")), (120, out[0][1].replace(" ", "  ")))]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_spans_equal_brute_force(spark, monkeypatch, seed):
    if seed:
        monkeypatch.setattr(suffix, "BROADCAST_SPANS", 0)  # the shuffle join
    rows = corpus(seed)
    got = suffix.repeated_passages(clashing(docs(spark, rows)).repartition(5)).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in got} == brute_spans(rows)
    assert all(r.is_first == (r.first_doc_id == r.doc_id) for r in got)


def passages_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [" ".join(w[s : s + 50]) for s in range(len(w) - 49)]


def test_cutting_leaves_each_passage_to_its_holder(spark):
    rows = corpus(4)
    out = suffix.without_repeats(clashing(docs(spark, rows)))
    assert out.columns == clashing(docs(spark, [])).columns
    holder = {}
    for d, t, *_ in rows:
        for p in passages_of(t):
            holder[p] = min(d, holder.get(p, d))
    want = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {k for s, p in enumerate(passages_of(t)) if holder[p] < d for k in range(s, s + 50)}
        left = [x for k, x in enumerate(w) if k not in gone]
        if left or not gone:
            want.append((d, left))
    got = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out.collect()]
    assert sorted(got) == sorted(want) and len(want) < len(rows)


def test_a_reused_id_loses_nothing_of_its_other_texts(spark):
    draw = random.Random(1)
    text = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    p, other = text(60), text(400)
    rows = [(0, p), (1, f"{text(80)} {p} {text(40)}"), (1, "a text of six words only"), (1, None), (1, other)]
    left = sorted((r.doc_id, r.text or "") for r in suffix.without_repeats(docs(spark, rows)).collect())
    assert left == sorted([(0, p), (1, rows[1][1].replace(p + " ", "")), (1, rows[2][1]), (1, ""), (1, other)])


def test_passage_cases(spark):
    df = clashing(docs(spark, ODD + [(50, "word " * 80, "en", "s", 1)]))
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in suffix.repeated_passages(df).collect()}
    assert got == {(5, 0, 60_000, 5), (50, 0, 80, 5)}  # one word over and over: the same passage at each place
    left = suffix.without_repeats(df).collect()
    assert len(left) == len(ODD) and 50 not in {r.doc_id for r in left}
    assert suffix.repeated_passages(docs(spark, [])).count() == 0 and suffix.without_repeats(docs(spark, [])).count() == 0


def test_each_text_is_cut_once(spark):
    """A filter on the cut text must not run the cutting again: each run takes a Python worker of its own in every task."""
    text = " ".join(f"w{k}" for k in range(80))
    out = suffix.without_repeats(clashing(docs(spark, [(1, text, "en", "s", 0), (2, f"a {text} b", "en", "s", 0)])))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(1, text, 0), (2, "a b", 3)]


def test_cut_keeps_the_rest_of_a_text():
    assert suffix.cut("a b  c\nd e", [(1, 2)]) == "a d e"
    assert suffix.cut("é b", [(0, 1)]) == "b" and suffix.cut("a b", [(1, 1)]) == "a " and suffix.cut("a", [(0, 1)]) == ""


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    raw = b"some words of a text, again some words " * 30
    a = words.hashed_words(raw, words.VISIBLE)
    runs = words.run_hashes(a[0], 5)
    monkeypatch.setattr(words, "BLOCK", 16)
    b = words.hashed_words(raw, words.VISIBLE)
    assert all((x == y).all() for x, y in zip(a, b, strict=True)) and (words.run_hashes(a[0], 5) == runs).all()
    assert [raw[s:e] for s, e in zip(a[1], a[2], strict=True)] == raw.split()
    assert len(set(a[0][:6].tolist())) == 6 and a[0][0] == a[0][6]


# ---- leaks


@pytest.mark.parametrize("seed", range(5))
def test_two_replaced_words_in_thirteen_are_found(seed):
    draw = random.Random(seed)
    item = [f"w{draw.randrange(10**6)}" for _ in range(13)]
    seeds = decontam.Seeds([(1, " ".join(item))])
    for a in range(13):
        for b in range(a):
            t = list(item)
            t[a], t[b] = "x", "y"
            found = seeds.leaks("Before. " + ", ".join(t).upper() + " after")
            assert found and found[0][2] == 11
    t = list(item)
    for k in (1, 4, 8, 11):
        t[k] = "x"
    assert not seeds.leaks(" ".join(t))


@pytest.mark.parametrize("blocks", [2_000_000, 60])
def test_leaks(spark, monkeypatch, blocks):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", blocks)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "one two three four five"), (3, "too few"), (4, None), (None, "no id item of seven words here"), (6, "")], "item_id long, text string")
    rows = [*ODD, (20, f"x {item} y"), (21, f"x {item.replace('gamma', 'other').upper()} y"), (22, "one two three four five"), (23, "one two four five three"), (24, "no id item of seven words here"), (25, item[: len(item) // 2])]
    got = sorted((r.doc_id, str(r.item_id), r.matched) for r in decontam.find_leaks(clashing(docs(spark, rows)), bench).collect())
    assert got == [(20, "1", 14), (20, "1", 14), (21, "1", 13), (21, "1", 13), (22, "2", 5), (24, "None", 7)]
    assert decontam.find_leaks(docs(spark, rows), bench.where("false")).count() == 0
    assert decontam.find_leaks(docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("n", range(1, 13))
def test_a_fifth_of_a_short_item_replaced_is_found(n):
    item = [f"w{k}" for k in range(n)]
    seeds = decontam.Seeds([(1, " ".join(item))])
    for gone in itertools.combinations(range(n), n // 5):
        t = ["x" if k in gone else w for k, w in enumerate(item)]
        for text in (t, ["before", *t, "after"], [w for k, w in enumerate(t) if k or w != "x"]):
            found = seeds.leaks(" ".join(text))
            assert found and found[0][2] == n - n // 5
    assert not seeds.leaks(" ".join(["x"] * (n // 5 + 1) + item[n // 5 + 1 :]))

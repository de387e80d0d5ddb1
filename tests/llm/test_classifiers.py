from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.llm import langid, quality, queries

from .helpers import ODD, clashing, docs


def test_backpropagation_gives_the_gradient():
    draw = np.random.default_rng(0)
    h, k = 3, 2
    p = {"wf": draw.standard_normal((257, 3 * h)), "uf": draw.standard_normal((h, 3 * h)), "wb": draw.standard_normal((257, 3 * h)), "ub": draw.standard_normal((h, 3 * h)), "v": draw.standard_normal((2 * h, k)), "c": draw.standard_normal(k)}
    x, n = langid._padded([b"abc", b"ca"])
    y = np.array([0, 1])

    def loss(q):
        prob = langid._softmax(langid._logits(q, x)[0])
        return -(np.log(prob[:, np.arange(2), y]) * (x != 256)).sum() / n.sum()

    logits, (s, past_f, past_b) = langid._logits(p, x, keep=True)
    d = langid._softmax(logits)
    d[:, np.arange(2), y] -= 1
    d *= (x != 256)[:, :, None] / n.sum()
    g = {a: np.zeros_like(b) for a, b in p.items()}
    ds = d @ p["v"].T
    langid._back(x, p["uf"], past_f, ds[:, :, :h], g["wf"], g["uf"])
    langid._back(x[::-1], p["ub"], past_b, ds[::-1, :, h:], g["wb"], g["ub"])
    for name, at in (("uf", (1, 4)), ("uf", (0, 8)), ("wf", (97, 2)), ("wf", (99, 7)), ("ub", (2, 1)), ("wb", (98, 5)), ("wb", (97, 6))):
        moved = {a: b.copy() for a, b in p.items()}
        moved[name][at] += 1e-3
        up = loss(moved)
        moved[name][at] -= 2e-3
        assert abs((up - loss(moved)) / 2e-3 - g[name][at]) < 1e-6, (name, at)


def naive_states(word, w, u):
    """The gated layer a byte and a unit at a time."""
    k = len(u)
    h, out = [0.0] * k, []
    squash = lambda x: 1 / (1 + math.exp(-x))
    for byte in word:
        a = [float(v) for v in w[byte]]
        b = [sum(h[i] * float(u[i][j]) for i in range(k)) for j in range(3 * k)]
        z = [squash(a[j] + b[j]) for j in range(k)]
        r = [squash(a[k + j] + b[k + j]) for j in range(k)]
        n = [math.tanh(a[2 * k + j] + r[j] * b[2 * k + j]) for j in range(k)]
        h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(k)]
        out.append(h)
    return out


def naive_distribution(model, text):
    """Mean over all bytes of words with a letter, a word of up to WORD_BYTES bytes at a time."""
    total, n = [0.0] * len(model.langs), 0
    for word in text.split():
        if not any(c.isalpha() for c in word):
            continue
        raw = word.encode()
        for at in range(0, len(raw), langid.WORD_BYTES):
            piece = raw[at : at + langid.WORD_BYTES]
            forward = naive_states(piece, model.params["wf"], model.params["uf"])
            backward = naive_states(piece[::-1], model.params["wb"], model.params["ub"])[::-1]
            for f, b in zip(forward, backward, strict=True):
                e = [math.exp(float(c) + sum(x * float(v[k]) for x, v in zip(f + b, model.params["v"], strict=True))) for k, c in enumerate(model.params["c"])]
                total = [t + x / sum(e) for t, x in zip(total, e, strict=True)]
                n += 1
    return [t / n for t in total]


def test_predictions_equal_a_network_read_byte_by_byte():
    model = langid.train([(w.encode(), k) for k, ws in enumerate(("the cat and dog", "der hund und die katze")) for w in ws.split()], ["en", "de"], epochs=1)
    texts = ["the hund", "naïve 漢字 12 !! " + "x" * 70, "die katze " * 50]
    for text, (lang, score) in zip(texts, langid.Predictor(model).predict(texts), strict=True):
        want = naive_distribution(model, text)
        assert lang == model.langs[int(np.argmax(want))] and abs(score - max(want)) < 1e-4


def test_words_of_the_whole_text_are_learned_and_bounded():
    drawn = langid._drawn("early " * 50_000 + "late words 12 " * 3, 1)
    assert drawn == [b"early", b"late", b"words"]
    many = langid._drawn(" ".join(f"w{k}" for k in range(5000)) + " often" * 4000, 1)
    assert len(many) == langid.WORDS_OF_TEXT and b"often" in many
    assert len({w[-1] for w in many}) > 5


def test_all_languages_are_learned(spark):
    rows = [(k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 2} word", f"l{k:02}", "s", 1) for k in range(70)]
    assert langid.fit(docs(spark, rows), F.lit(True)).langs == [f"l{k:02}" for k in range(70)]


def test_language_of_held_out_documents(spark, sf_dir):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").toPandas()
    want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got[got.held_out].merge(want, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_cases(spark):
    good = [(100 + k, f"the cat and dog number {w} in the house", "en", "s", 1) for k, w in enumerate("abcdefgh")] + [(200 + k, f"der hund und die katze {w} im haus", "de", "s", 1) for k, w in enumerate("abcdefgh")]
    df = clashing(docs(spark, ODD + good))
    model = langid.fit(df, ~langid.held_out())
    out = langid.identify(df, model)
    rows = out.collect()
    assert len(rows) == len(ODD + good) and set(out.columns) == set(df.columns)
    by = [(r.text, r.lang_pred, r.score) for r in rows]
    assert all((p == "und" and s == 0) == (t is None or not any(c.isalpha() for c in t)) for t, p, s in by)
    assert {p for t, p, _ in by if t and t.startswith("der hund")} == {"de"}
    none = langid.fit(df.where("false"), ~langid.held_out())
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0


def test_quality_of_held_out_documents(spark):
    got = queries.op7_quality(spark, "/root/testdata/sf0.01").toPandas()
    want = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").toPandas()
    both = got[got.held_out].merge(want, on="doc_id")
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert (both.predicted == both.quality).mean() > 0.95
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_cases(spark):
    df = clashing(docs(spark, ODD))
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (7, 1), (8, 0), (9, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.fit(df, labels, F.lit(True))
    out = quality.score(df, model).toPandas()
    assert len(out) == len(ODD) and out.score.between(0, 1).all()
    assert quality.fit(df, labels.where("false"), F.lit(True)).intercept == 0.0
    one = quality.fit(df, labels.where("quality = 1"), F.lit(True))
    assert quality.probability(quality.features("anything"), one) > 0.99
    assert quality.score(df.where("false"), model).count() == 0


def test_the_whole_of_a_labelled_text_is_learned(spark):
    head = "plain words of no account " * 3000
    rows = [(k, head + ("!!@@ zzqx" if k % 2 else "fine ending"), "en", "s", 1) for k in range(40)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int")
    model = quality.fit(docs(spark, rows), labels, F.lit(True))
    p = [quality.probability(quality.features(t), model) for _, t, *_ in rows[:2]]
    assert p[0] > 0.7 > 0.3 > p[1]


def test_one_text_of_a_reused_id_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, labels, **_: seen.append((len(rows), labels.tolist())))
    rows = [(1, f"text {k}", "en", "s", 1) for k in range(50)] + [(2, "other", "en", "s", 1)] * 9
    quality.fit(docs(spark, rows), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    assert seen == [(2, [1, 0])]


@pytest.mark.parametrize("n", [3, 5000])
def test_packed_features(n):
    found = np.sort(np.random.default_rng(n).choice(quality._SIZE, n, replace=False))
    assert (quality._unpacked(quality._packed(found)) == found).all() and len(quality._packed(found)) <= quality._SIZE // 8


def naive_grams(text):
    """Byte n-grams as (n, bytes), and word shapes, without hashing tricks: only how many differ matters."""
    raw = text.encode()
    return {(n, raw[k : k + n]) for n in range(1, 5) for k in range(len(raw) - n + 1)}


def test_features_equal_the_naive_grams():
    for text in ("abcabc", "a", "naïve café"):
        slots = {int(quality._slot(np.array([int.from_bytes(g, "big")], np.uint32), n * 0x9E3779B1 & 0xFFFFFFFF)[0]) for n, g in naive_grams(text)}
        found = set(quality.features(text).tolist())
        assert slots <= found and len(found) - len(slots) <= 2 * len(text.split()) + 1


def test_ratios_and_dual_objective_equal_the_naive_ones():
    draw = np.random.default_rng(4)
    rows = [np.sort(draw.choice(np.arange(k % 2 * 10, 40 + k % 2 * 10), 12, replace=False)) for k in range(30)]
    y = np.array([k % 2 for k in range(30)])
    m = quality.train(rows, y, epochs=500)
    aside = np.random.default_rng(5).random(30) < 0.2
    aside[[0, 1]] = False
    fit = [k for k in range(30) if not aside[k]]
    count = {(c, f): 1 + sum(f in rows[k] for k in fit if y[k] == c) for c in (0, 1) for f in range(quality._SIZE)}
    total = {c: sum(count[c, f] for f in range(quality._SIZE)) for c in (0, 1)}
    want = [math.log(count[1, f] / total[1]) - math.log(count[0, f] / total[0]) for f in range(60)]
    assert np.allclose(m.ratios[:60], want)
    # the fitted weights reach the least hinge loss that plain subgradient descent finds
    n_own = [sum(y[k] == c for k in fit) for c in (0, 1)]
    x = np.zeros((len(fit), 61))
    for i, k in enumerate(fit):
        x[i, rows[k]] = [want[f] for f in rows[k]]
        x[i] /= np.linalg.norm(x[i])
        x[i, 60] = 1
    sign, cost = np.array([1.0 if y[k] else -1.0 for k in fit]), np.array([len(fit) / (2 * n_own[y[k]]) for k in fit])
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    w, best = np.zeros(61), np.inf
    for step in range(1, 20_000):
        w -= (w - ((cost * sign * (sign * (x @ w) < 1))[:, None] * x).sum(0)) / (step + 10)
        best = min(best, loss(w))
    own = np.append(np.divide(m.weights[:60], m.ratios[:60], out=np.zeros(60), where=m.ratios[:60] != 0), m.bias)
    assert loss(own) <= best * 1.005


def test_blocks_lose_no_gram(monkeypatch):
    text = "abcdefghij" * 40
    whole = quality.features(text)
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert (quality.features(text) == whole).all()


def test_dual_coordinate_descent_separates():
    texts = ["good fine text", "nice good words", "fine nice day"] * 5 + ["BAD!!! JUNK!!!", "JUNK@@ BAD@@", "@@!! BAD"] * 5
    m = quality.train([quality.features(t) for t in texts], np.array([1] * 15 + [0] * 15))
    p = pd.Series([quality.probability(quality.features(t), m) for t in texts])
    assert p[:15].min() > p[15:].max()


@pytest.mark.parametrize("text", ["", None])
def test_no_features(text):
    assert len(quality.features(text)) == 0

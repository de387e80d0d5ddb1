"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads the bytes of a word (a run without white space, in pieces of at
most :data:`WORD_BYTES`) in both directions, gives each byte a distribution over the
learned languages, and a text's distribution is the mean over all its bytes in words
that hold a letter. The state starts anew with each word, so equal words give equal
sums and each different word is read once per worker's memo; every byte counts.

It is trained in numpy by backpropagation through time on the driver. For each learned
language there are at most :data:`SAMPLE_DOCS` documents, whose words are counted on the
executors over their whole texts, and of each at most :data:`WORDS_OF_TEXT` words, drawn by
how often they occur; of all these :data:`SAMPLE_WORDS`. All values of lang are learned.

Cases: ``und`` with score 0 for a null text or one without a letter, and for all if
no language can be learned. A null doc_id counts as the empty text in crc32 and isn't
learned from. Repeated rows are predicted each. Other input columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_crc, map_small, only_one, with_text_columns

WORD_BYTES = 32
SAMPLE_DOCS = 120
WORDS_OF_TEXT = 400
SAMPLE_WORDS = 24_000
HIDDEN = 16
#: Steps of the fit at least, however small the sample.
LEAST_STEPS = 400
MEMO_WORDS = 120_000
#: Words that are split off texts at once, or those of one text if it has more.
GROUP_WORDS = 20_000



class Model(NamedTuple):
    langs: list[str]
    params: dict[str, np.ndarray]


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def word_bytes(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "surrogatepass")
    return [raw[i : i + WORD_BYTES] for i in range(0, len(raw), WORD_BYTES)]


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """bytes x words, 256 beyond a word's end; lengths."""
    n = np.array([len(w) for w in words])
    out = np.full((n.max(), len(words)), 256, np.int16)
    flat = np.frombuffer(b"".join(words), np.uint8)
    col = np.repeat(np.arange(len(words)), n)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), col] = flat
    return out, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """A gated layer over the rows of x; the state stays where x is 256."""
    h = np.zeros((x.shape[1], u.shape[0]), u.dtype)
    k, states, past = u.shape[0], np.empty((x.shape[0], x.shape[1], u.shape[0]), u.dtype), []
    for t in range(x.shape[0]):
        a, b = w[x[t]], h @ u
        gates = _sigmoid(a[:, : 2 * k] + b[:, : 2 * k])
        z, r, inner = gates[:, :k], gates[:, k:], b[:, 2 * k :]
        n = np.tanh(a[:, 2 * k :] + r * inner)
        there = (x[t] != 256)[:, None]
        new = np.where(there, n + z * (h - n), h)
        if keep:
            past.append((h, z, r, n, inner, there))
        states[t] = h = new
    return states, past


def _back(x: np.ndarray, u: np.ndarray, past: list, d_states: np.ndarray, dw: np.ndarray, du: np.ndarray) -> None:
    dh = np.zeros_like(d_states[0])
    for t in range(x.shape[0] - 1, -1, -1):
        h, z, r, n, inner, there = past[t]
        total = dh + d_states[t]
        d = np.where(there, total, 0)
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        da = np.concatenate([dz, dr, dn], 1)
        db = np.concatenate([dz, dr, dn * r], 1)
        np.add.at(dw, x[t], da)
        du += h.T @ db
        dh = np.where(there, d * z, total) + db @ u.T


def _logits(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    f, past_f = _run(x, p["wf"], p["uf"], keep)
    b, past_b = _run(x[::-1], p["wb"], p["ub"], keep)
    s = np.concatenate([f, b[::-1]], 2)
    return s @ p["v"] + p["c"], (s, past_f, past_b)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(words: list[tuple[bytes, int]], langs: list[str], hidden: int = HIDDEN, epochs: int = 4, batch: int = 256, seed: int = 11) -> Model:
    """Backpropagation through time, Adam, on (bytes of a word, language number)."""
    draw, k = np.random.default_rng(seed), len(langs)
    new = lambda *s, scale: (draw.standard_normal(s) * scale).astype(np.float32)
    p = {"wf": new(257, 3 * hidden, scale=0.3), "uf": new(hidden, 3 * hidden, scale=hidden**-0.5), "wb": new(257, 3 * hidden, scale=0.3), "ub": new(hidden, 3 * hidden, scale=hidden**-0.5), "v": new(2 * hidden, k, scale=hidden**-0.5), "c": np.zeros(k, np.float32)}
    m, v, step = {a: np.zeros_like(b) for a, b in p.items()}, {a: np.zeros_like(b) for a, b in p.items()}, 0
    words = sorted(words, key=lambda x: len(x[0]))
    starts = np.arange(0, len(words), batch)
    epochs = max(epochs, -(-LEAST_STEPS // len(starts)))
    for _ in range(epochs):
        for at in draw.permutation(starts):
            own = words[at : at + batch]
            x, n = _padded([w for w, _ in own])
            y = np.array([lang for _, lang in own])
            logits, (s, past_f, past_b) = _logits(p, x, keep=True)
            d = _softmax(logits)
            d[:, np.arange(len(y)), y] -= 1
            d *= (x != 256)[:, :, None] / np.float32(n.sum())
            g = {a: np.zeros_like(b) for a, b in p.items()}
            g["v"], g["c"] = s.reshape(-1, s.shape[2]).T @ d.reshape(-1, k), d.sum((0, 1))
            ds = d @ p["v"].T
            _back(x, p["uf"], past_f, ds[:, :, :hidden], g["wf"], g["uf"])
            _back(x[::-1], p["ub"], past_b, ds[::-1, :, hidden:], g["wb"], g["ub"])
            step += 1
            rate = 0.02 * (1 - step / (epochs * len(starts) + 1))
            for a in p:
                m[a] = 0.9 * m[a] + 0.1 * g[a]
                v[a] = 0.99 * v[a] + 0.01 * g[a] ** 2
                p[a] -= rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.99**step)) + 1e-7)
    return Model(langs, {a: b.astype(np.float32) for a, b in p.items()})


def byte_sums(model: Model, words: list[bytes]) -> np.ndarray:
    """Sums over a word's bytes of their distributions."""
    out = np.zeros((len(words), len(model.langs)))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        # words of about one length, so that little of a step is padding
        stop, most = at + 1, len(words[order[at]]) * 5 // 4 + 1
        while stop < min(len(order), at + 2048) and len(words[order[stop]]) <= most:
            stop += 1
        own, at = order[at:stop], stop
        x, _ = _padded([words[i] for i in own])
        prob = _softmax(_logits(model.params, x)[0])
        out[own] = (prob * (x != 256)[:, :, None]).sum(0)
    return out


class Predictor:
    """Distributions of texts, with a memo of words."""

    def __init__(self, model: Model):
        self.model = model
        self._new()
        self.before, self.sums_before = {}, self.sums

    def _new(self, words: int = MEMO_WORDS) -> None:
        self.memo: dict[str, int] = {}
        self.sums = np.zeros((words, len(self.model.langs) + 1))

    def _recall(self, words: set[str]) -> None:
        """All of ``words`` into the memo; a full one becomes the one before, so frequent words stay."""
        missing = words.difference(self.memo)
        if len(self.memo) + len(missing) > len(self.sums):
            self.before, self.sums_before = self.memo, self.sums
            self._new(max(MEMO_WORDS, len(words)))
            missing = words
        known = sorted(missing.intersection(self.before))
        at = len(self.memo)
        self.sums[at : at + len(known)] = self.sums_before[[self.before[w] for w in known]]
        self.memo.update(zip(known, range(at, at + len(known)), strict=True))
        if len(known) < len(missing):
            self._learn(sorted(missing.difference(self.before)))

    def _learn(self, words: list[str]) -> None:
        pieces, owner = [], []
        for k, w in enumerate(words):
            if has_letter(w):
                for piece in word_bytes(w):
                    pieces.append(piece)
                    owner.append(k)
        start = len(self.memo)
        self.sums[start : start + len(words)] = 0
        if pieces:
            np.add.at(self.sums[:, :-1], np.array(owner) + start, byte_sums(self.model, pieces))
            np.add.at(self.sums[:, -1], np.array(owner) + start, [len(x) for x in pieces])
        self.memo.update(zip(words, range(start, start + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            # the words of a few texts at a time, not of a whole batch
            split, n = [], 0
            while at < len(texts) and n < GROUP_WORDS:
                split.append(texts[at].split() if texts[at] else [])
                n += len(split[-1])
                at += 1
            self._recall(set().union(*split))
            for words in split:
                total = self.sums[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))].sum(0) if words else np.zeros(self.sums.shape[1])
                if total[-1] and self.model.langs:
                    k = int(total[:-1].argmax())
                    out.append((self.model.langs[k], float(min(1.0, total[k] / total[-1]))))
                else:
                    out.append(("und", 0.0))
        return out


def _drawn(text: str, seed: int) -> list[bytes]:
    """At most WORDS_OF_TEXT different pieces of a text's words, by how often they occur in all of it."""
    counts: Counter[bytes] = Counter()
    for w, n in Counter(text.split()).items():
        if has_letter(w):
            for piece in word_bytes(w):
                counts[piece] += n
    found = sorted(counts)
    if len(found) <= WORDS_OF_TEXT:
        return found
    n = np.array([counts[x] for x in found], float)
    return [found[i] for i in np.random.default_rng(seed).choice(len(found), WORDS_OF_TEXT, replace=False, p=n / n.sum())]


def fit(docs: DataFrame, learnable, seed: int = 11) -> Model:
    """Train on rows where ``learnable`` holds: text and lang not null. Only hashes and ids pass through the choice of the sample."""
    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("th"), text.alias("text"), learnable.alias("ok"))
    named = named.where(F.col("ok") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th")
    chosen = named.select("lang", "doc_id", "th").withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE_DOCS).select("lang", "doc_id", "th").distinct()
    rows = named.join(F.broadcast(chosen), ["lang", "doc_id", "th"]).dropDuplicates(["lang", "doc_id", "th"])  # SAMPLE_DOCS texts of a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_drawn(t, seed + (th & 0xFFFFFFFF)) for t, th in zip(b["text"], b["th"], strict=True)]
            yield pd.DataFrame({"lang": b["lang"], "doc_id": b["doc_id"], "th": b["th"], "pieces": found})

    own: dict[str, list[bytes]] = {}
    for r in sorted(map_small(rows.select("lang", "doc_id", "th", "text"), run, "lang string, doc_id long, th long, pieces array<binary>", 16).collect()):
        if r["pieces"]:
            own.setdefault(r["lang"], []).extend(map(bytes, r["pieces"]))
    langs, draw = sorted(own), np.random.default_rng(seed)
    chosen_words = [(own[lang][i], k) for k, lang in enumerate(langs) for i in draw.permutation(len(own[lang]))[:SAMPLE_WORDS]]
    return train(chosen_words, langs) if langs else Model([], train([(b"a", 0)], ["-"], epochs=1).params)


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds columns ``lang`` and ``score`` to all rows of ``docs``, from its text alone; such columns of its own are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on HIDDEN and the number of languages alone
    key = uuid.uuid4().hex

    def compute():
        predictor = only_one("language", key, lambda: Predictor(held.value))
        return lambda texts: list(zip(*predictor.predict(texts), strict=True))

    return with_text_columns(docs.drop(lang, score), compute, f"`{lang}` string, `{score}` double")


def held_out():
    return F.pmod(doc_crc(), F.lit(4)) == 2

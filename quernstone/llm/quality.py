"""Quality of a text by a support vector machine over naive Bayes features.

Features are indicators of n-grams: of 1 to 4 bytes, and of 1 and 2 word shapes with
marks of repeated words, hashed to 2**HASH_BITS numbers. An indicator's value is the
log-ratio of its smoothed counts in the two classes; a text's vector is scaled to
length one. A linear hinge-loss model is fitted by dual coordinate descent, then a
logistic curve from margin to probability on the fifth of the sample kept aside.

The fit reads at most SAMPLE_DOCS labelled texts of each class. Every text, learned or
scored, is read as a whole on the executors, in blocks of BLOCK bytes that overlap so that
no n-gram is lost; of learned ones only the numbers of their n-grams come to the driver,
2**HASH_BITS bits each at most.

Cases: null and empty texts have no feature and get the score of the intercept. An id
labelled more than once has the mean label, 0.5 counting as 1; of an id with several texts
the one with the least hash is learned. Null ids or labels teach
nothing. Without both classes the score is the share of label 1, or 0.5 without labels.
Repeated rows are scored each. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc, map_small, release, with_text_columns

HASH_BITS = 17
SAMPLE_DOCS = 2000
BLOCK = 1 << 20
_SIZE = 1 << HASH_BITS


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    return ((x + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def features(text: str | None, seen: np.ndarray | None = None) -> np.ndarray:
    """Sorted numbers of the n-grams in a text."""
    if not text:
        return np.zeros(0, np.int64)
    seen = np.zeros(_SIZE, bool) if seen is None else seen
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), BLOCK):
            b = raw[at : at + BLOCK + 3].astype(np.uint32)
            own, gram = min(BLOCK, len(raw) - at), b
            for n in range(1, 5):
                seen[_slot(gram[:own], n * 0x9E3779B1 & 0xFFFFFFFF)] = True
                if n < 4:
                    gram = (gram[:-1] << np.uint32(8)) | b[n:]
    words = text.split()
    if words:
        shape = np.fromiter(map(_shape, words), np.uint32, len(words))
        same = np.zeros(len(words), np.uint32)
        same[1:] += np.fromiter(map(eq, words[1:], words), bool, len(words) - 1)
        same[2:] += np.fromiter(map(eq, words[2:], words), bool, max(0, len(words) - 2)) * np.uint32(2)
        shape += same * np.uint32(64)
        with np.errstate(over="ignore"):
            seen[_slot(shape, 0x51ED270B)] = True
            seen[_slot(shape[:-1] * np.uint32(4096) + shape[1:], 0x2545F491)] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def _shape(word: str) -> int:
    """Case, ending and length class of a word."""
    case = 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() else 3
    return case * 16 + (0 if word[-1].isalpha() else 1 if word[-1].isdigit() else 2 if word[-1] in ".," else 3) * 4 + min(3, len(word) // 4)


class Model(NamedTuple):
    weights: np.ndarray  # log-ratio x hinge-loss weight
    ratios: np.ndarray
    bias: float
    slope: float
    intercept: float


def margin(found: np.ndarray, model: Model) -> float:
    if not len(found):
        return model.bias
    length = float(np.sqrt((model.ratios[found] ** 2).sum()))
    return float(model.weights[found].sum()) / length + model.bias if length else model.bias


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, draw: np.random.Generator) -> tuple[np.ndarray, float]:
    """Dual coordinate descent of the hinge loss; the bias is the weight of a constant feature."""
    w, bias, alpha = np.zeros(_SIZE), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                bias += step
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def train(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 5, share: float | None = None) -> Model:
    """From the :func:`features` of texts; ``share``: of label 1 among all labelled rows, which the sample needn't have."""
    labels = np.asarray(labels, int)
    share = float(labels.mean()) if share is None and len(labels) else 0.5 if share is None else share
    if len(set(labels.tolist())) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(_SIZE), np.zeros(_SIZE), 0.0, 1.0, float(np.log(p / (1 - p))))
    draw = np.random.default_rng(seed)
    aside = draw.random(len(rows)) < 0.2
    for k in (0, 1):  # both parts need both classes
        own = np.flatnonzero(labels == k)
        aside[own[0]] = False
    fit = np.flatnonzero(~aside)
    counts = np.ones((2, _SIZE))
    for i in fit:
        counts[labels[i], rows[i]] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    unit = lambda x: ratios[x] / max(1e-12, float(np.sqrt((ratios[x] ** 2).sum())))
    sign = np.where(labels == 1, 1.0, -1.0)
    n_own = np.array([(labels[fit] == 0).sum(), (labels[fit] == 1).sum()])
    w, bias = _descend([rows[i] for i in fit], [unit(rows[i]) for i in fit], sign[fit], cost * len(fit) / (2 * n_own[labels[fit]]), epochs, draw)
    model = Model(w * ratios, ratios, bias, 1.0, 0.0)
    check = np.flatnonzero(aside) if len(set(labels[aside].tolist())) == 2 else fit
    slope, intercept = _logistic(np.array([margin(rows[i], model) for i in check]), labels[check], share)
    return model._replace(slope=slope, intercept=intercept)


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Newton's method; classes weigh as in the whole, targets are pulled in as Platt does."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, share / max(1, n1), (1 - share) / max(1, n0)) * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - target)
        h = weight * p * (1 - p)
        gradient = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 3.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def probability(found: np.ndarray, model: Model) -> float:
    x = model.slope * margin(found, model) + model.intercept
    return float(1 / (1 + np.exp(-min(max(x, -700), 700))))


def fit(docs: DataFrame, labels: DataFrame, learnable, label: str = "quality") -> Model:
    """Train on documents whose label isn't null where ``learnable`` (over doc_id) holds."""
    known = (
        labels.where(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return train([], np.zeros(0))
    first = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.where(F.col("y") == y).orderBy(*first).limit(SAMPLE_DOCS) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 x SAMPLE_DOCS rows
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).join(chosen, "doc_id").withColumn("th", F.xxhash64("text"))
    least = F.broadcast(texts.groupBy("doc_id").agg(F.min("th").alias("th")))  # a row for each of these
    rows = texts.join(least, ["doc_id", "th"]).dropDuplicates(["doc_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(_SIZE, bool)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "found": [_packed(features(t, seen)) for t in b["text"]]})

    learned = sorted((r["doc_id"], r["y"], bytes(r["found"])) for r in map_small(rows.select("doc_id", "y", "text"), run, "doc_id long, y int, found binary", 64).collect())
    return train([_unpacked(f) for _, _, f in learned], np.array([y for _, y, _ in learned], int), share=sizes.get(1, 0) / sum(sizes.values()))


def _packed(found: np.ndarray) -> bytes:
    """Numbers below 2**HASH_BITS in 4 bytes each, or as bits if that is shorter."""
    if 4 * len(found) < _SIZE // 8:
        return found.astype("<u4").tobytes()
    bits = np.zeros(_SIZE, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) < _SIZE // 8:
        return np.frombuffer(data, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score to all rows of ``docs``, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2**HASH_BITS

    def compute():
        release()
        model, seen = held.value, np.zeros(_SIZE, bool)
        return lambda texts: [[probability(features(t, seen), model) for t in texts]]

    return with_text_columns(docs.drop("score"), compute, "score double")


def held_out():
    return F.pmod(doc_crc(), F.lit(5)) == 0

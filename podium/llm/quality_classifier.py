"""Quality classifier by positive-unlabelled learning.

Positives are trusted (labelled good), everything else is unlabelled web text, good
and bad mixed. A small network minimises the non-negative unbiased risk: with class prior pi,
pi * risk(P as good) + max(0, risk(U as bad) - pi * risk(P as bad)); when the second part goes
negative, the step goes the other way on it. Logistic loss, so the output estimates the
probability of being good. Labels of bad documents are not used.

The prior is estimated from the data: a first classifier tells positives from unlabelled, and the share of
unlabelled documents in its top bin, over the share of held-back positives there, is
smallest where the bin holds positives only (best bin, with a deviation bound).

Features are counts over the whole text. ``train`` uses about ``max_positive`` positives and
``max_unlabelled`` unlabelled documents; only their feature vectors reach the driver. ``score``
reads every text.

Defined results: a null text counts as empty, with the features of an empty text. Null labels are not
positives. Without positives every score is 0.5; without unlabelled documents the labelled ones serve, their
labels unread. Repeated rows are scored each. Only ``doc_id``, ``text`` and the label are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import bounded_sample, fold_of, texts_of

MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
SYMBOLS = "#*$%&|<>"
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"\d")
SYMBOL_END = re.compile(r"[#*$%&|<>!]+(?:\s|$)")


def text_features(text: str | None) -> list[float]:
    """Shares between 0 and 1 that tell prose from junk, and the length."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 15
    per_word, per_char = 1 / n, 1 / chars
    lines = [x for x in text.split("\n") if x.strip()]
    triples = max(1, n - 2)
    return [
        sum(map(text.count, SYMBOLS)) * per_char,
        len(UPPER.findall(text)) * per_char,
        sum(map(str.isupper, words)) * per_word,
        text.count("!") * per_char,
        sum(w == "|" for w in words) * per_word,
        len(set(words)) * per_word,
        min(1.0, len(set(words)) / (2 * n ** 0.75)),
        sum(map(eq, words, words[1:])) * per_word,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        min(1.0, sum(map(len, words)) * per_word / 20),
        len(DIGIT.findall(text)) * per_char,
        len(SYMBOL_END.findall(text)) * per_word,
        (text.count(".") + text.count(",")) * per_char * 10,
        np.log1p(n) / 10,
    ]


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [text_features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64()))], ["x"])


@dataclass
class Network:
    """One hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise_risk(p: np.ndarray, u: np.ndarray, prior: float, non_negative: bool = True, steps: int = 1500,
                  hidden: int = 24, batch: int = 256, rate: float = 5e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the non-negative unbiased risk (or, with ``non_negative`` off and prior 0.5, on plain
    positives against unlabelled)."""
    rng = np.random.default_rng(seed)
    both = np.vstack([p, u])
    net = Network(both.mean(0), both.std(0) + 1e-3, rng.normal(0, 0.3, (p.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, 0.3, hidden), np.zeros(1))
    names = ("w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    for t in range(1, steps + 1):
        xp, xu = p[rng.integers(len(p), size=batch)], u[rng.integers(len(u), size=batch)]
        x = (np.vstack([xp, xu]) - net.mean) / net.scale
        h = np.maximum(x @ net.w1 + net.b1, 0)
        z = h @ net.w2 + net.b2[0]
        zp, zu = z[:batch], z[batch:]
        loss_bad = lambda v: np.logaddexp(0, v)
        if non_negative:
            rest = loss_bad(zu).mean() - prior * loss_bad(zp).mean()
            good = prior * (_sigmoid(zp) - 1)  # gradient of the positives' loss as good
            gp, gu = (good - prior * _sigmoid(zp), _sigmoid(zu)) if rest >= 0 else (prior * _sigmoid(zp), -_sigmoid(zu))
        else:
            gp, gu = _sigmoid(zp) - 1, _sigmoid(zu)
        g = np.concatenate([gp, gu]) / batch
        back = (g[:, None] * net.w2) * (h > 0)
        grads = {"w1": x.T @ back + decay * net.w1, "b1": back.sum(0), "w2": h.T @ g + decay * net.w2, "b2": np.array([g.sum()])}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            step = rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
            setattr(net, k, getattr(net, k) - step)
    return net


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, by the best bin on held-back rows."""
    half_p, half_u = len(p) // 2, len(u) // 2
    net = minimise_risk(p[:half_p], u[:half_u], 0.5, non_negative=False, steps=600)
    sp, su = np.sort(net.logits(p[half_p:])), np.sort(net.logits(u[half_u:]))
    cuts = sp[:: max(1, len(sp) // 200)]
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    ok = qp > 0.05
    best = np.argmin(((qu + slack) / np.maximum(qp, 1e-9))[ok])
    return float(np.clip((qu / np.maximum(qp, 1e-9))[ok][best], 0.02, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> tuple[Network | None, float]:
    """The network and the estimated prior."""
    if len(p) < 4 or len(u) < 4:
        return None, 0.5
    prior = class_prior(p, u)
    return minimise_risk(p, u, prior), prior


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> tuple[Network | None, float]:
    """From positives whose crc32 fold (of 5) is not 0, and documents without a label."""
    usable = labels.select("doc_id", "quality").where(fold_of("doc_id", 5) != 0)
    good = bounded_sample(usable.where(F.col("quality") == 1).select("doc_id").distinct(), "doc_id", max_positive)
    free = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(labels.select("doc_id"), "doc_id", "left_anti")
    if free.limit(1).count() == 0:
        free = usable.select("doc_id")
    mixed = bounded_sample(free.distinct(), "doc_id", max_unlabelled)

    def vectors(ids: DataFrame) -> np.ndarray:
        got = texts_of(docs, ids).select("text").mapInArrow(_feature_batches, "x array<double>").toPandas()["x"]
        rows = sorted(map(tuple, got))
        return np.random.default_rng(1).permutation(np.array(rows).reshape(len(rows), -1)) if rows else np.zeros((0, 15))
    return fit(vectors(good), vectors(mixed))


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column("text")]).reshape(-1, 15)
            s = net.scores(x) if net is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")

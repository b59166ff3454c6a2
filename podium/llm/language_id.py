"""Language of words and texts by a linear-chain conditional random field.

A text's words (runs of letters, lower case) form a chain of labels, the languages. Emission
features of a word are its affixes, its inner n-grams and the learned lexicons that hold it;
transitions between languages are learned weights too. Forward-backward gives each word's label
distribution, so code-switched text is labelled word by word; a text's language is the one with the largest
share over its words, and its score is that share.

``train`` fits on up to ``per_language`` labelled documents of each language, so a rare language is
learned at every table size. Training chains are
made of segments of documents of different languages, so that switches are seen. ``identify``
labels every row over its whole text: the chains of a batch are run as one, in blocks, with
each document's first step independent of what stands before it; blocks are exact, not windows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text
if nothing could be learned. Rows with a null lang are not learned from. Repeated rows are labelled
each. On equal shares the language first in alphabetical order wins. Only ``doc_id``,
``text`` and (for learning) ``lang`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import fold_of

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
PER_LANGUAGE = 400
MAX_FEATURES = 60_000
LEXICON = 400
BATCH_WORDS = 100_000


def letter_words(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter."""
    return [w for w in LETTERS.findall((text or "").lower()) if w.isascii() or any(map(str.isalpha, w))]


def affixes_and_grams(word: str) -> list[str]:
    """Prefixes and suffixes up to four letters, inner bigrams and trigrams."""
    n = len(word)
    out = ["^" + word[:k] for k in range(1, min(4, n) + 1)]
    out += [word[n - k:] + "$" for k in range(1, min(4, n) + 1)]
    out += [word[i:i + 2] for i in range(n - 1)]
    out += [word[i:i + 3] for i in range(n - 2)]
    return out


@dataclass
class Model:
    """languages (sorted), feature numbers, lexicon of each language, weights."""

    languages: list[str]
    features: dict[str, int]
    lexicon: dict[str, list[int]]  # word -> languages whose lexicon holds it
    emission: np.ndarray  # features and lexicon features, by language
    transition: np.ndarray
    start: np.ndarray

    def numbers(self, word: str) -> list[int]:
        """Feature numbers of a word; the lexicon features come after the others."""
        known = self.features
        out = [known[f] for f in affixes_and_grams(word) if f in known]
        return out + [len(known) + k for k in self.lexicon.get(word, ())]

    def word_scores(self, word: str) -> np.ndarray:
        at = self.numbers(word)
        return self.emission[at].sum(0) if at else np.zeros(len(self.languages), np.float32)


def _segments(rng, docs_of: list[list[list[str]]], batch: int, length: int) -> tuple[list[list[str]], np.ndarray]:
    """Chains of ``length`` words made of segments of random languages, with their labels."""
    chains, labels = [], np.zeros((batch, length), np.int64)
    for b in range(batch):
        chain: list[str] = []
        while len(chain) < length:
            k = int(rng.integers(len(docs_of)))
            doc = docs_of[k][int(rng.integers(len(docs_of[k])))]
            size = min(int(rng.geometric(1 / 12)) + 2, length - len(chain), len(doc))
            at = int(rng.integers(len(doc) - size + 1))
            labels[b, len(chain):len(chain) + size] = k
            chain += doc[at:at + size]
        chains.append(chain)
    return chains, labels


def _posteriors(scores: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals [batch, length, k] and summed edge marginals [k, k] of equally long chains."""
    b, n, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    t = np.exp(transition)
    alpha, beta = np.empty((b, n, k)), np.ones((b, n, k))
    alpha[:, 0] = e[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, n):
        a = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    for i in range(n - 2, -1, -1):
        a = (beta[:, i + 1] * e[:, i + 1]) @ t.T
        beta[:, i] = a / a.sum(1, keepdims=True)
    node = alpha * beta
    node /= node.sum(2, keepdims=True)
    edges = np.zeros((k, k))
    for i in range(n - 1):
        x = alpha[:, i, :, None] * t * (beta[:, i + 1] * e[:, i + 1])[:, None, :]
        edges += (x / x.sum((1, 2), keepdims=True)).sum(0)
    return node, edges


def fit(texts: list[str], langs: list[str], steps: int = 160, batch: int = 64, length: int = 32,
        rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Gradient ascent (Adagrad) on the chains' conditional log-likelihood."""
    words = [letter_words(t) for t in texts]
    languages = sorted({la for la, w in zip(langs, words) if w})
    docs_of = [[w for la, w in zip(langs, words) if w and la == one] for one in languages]
    counts = [Counter(w for doc in docs for w in doc) for docs in docs_of]
    k = len(languages)
    if not k:
        return Model([], {}, {}, np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    seen: Counter[str] = Counter()
    for c in counts:
        for w in c:
            seen.update(affixes_and_grams(w))
    features = {f: i for i, (f, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_FEATURES]) if n > 1}
    lexicon: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    m = Model(languages, features, lexicon, np.zeros((len(features) + k, k)), np.zeros((k, k)), np.zeros(k))
    past_e, past_t, past_s = np.full(m.emission.shape, 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)
    rng = np.random.default_rng(seed)
    numbers: dict[str, np.ndarray] = {}
    for _ in range(steps):
        chains, labels = _segments(rng, docs_of, batch, length)
        at = [numbers[w] if w in numbers else numbers.setdefault(w, np.array(m.numbers(w), np.int64)) for c in chains for w in c]
        sizes = np.array([len(a) for a in at])
        flat, row = np.concatenate(at), np.repeat(np.arange(len(at)), sizes)
        scores = np.stack([np.bincount(row, m.emission[flat, j], minlength=len(at)) for j in range(k)], 1)
        node, edges = _posteriors(scores.reshape(batch, length, k), m.transition, m.start)
        gold = np.eye(k)[labels]
        diff = (gold - node).reshape(-1, k)[row] / batch
        grad_e = np.stack([np.bincount(flat, diff[:, j], minlength=len(m.emission)) for j in range(k)], 1) - decay * m.emission
        gold_edges = np.zeros((k, k))
        np.add.at(gold_edges, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
        grad_t, grad_s = (gold_edges - edges) / batch, (gold[:, 0] - node[:, 0]).sum(0) / batch
        for value, grad, past in ((m.emission, grad_e, past_e), (m.transition, grad_t, past_t), (m.start, grad_s, past_s)):
            past += grad ** 2
            value += rate * grad / np.sqrt(past)
    m.emission = m.emission.astype(np.float32)
    return m


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """text and lang of up to ``per_language`` rows of each lang, picked by a hash of id and text, from the
    rows with a lang and a letter whose crc32 fold (of 3) is not 1. A lang's share of its rows is kept
    first, with room to spare and its least hash always, so that only few texts are ranked."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ((fold_of("doc_id", 3) != 1) | F.col("doc_id").isNull()))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    upto = F.greatest(F.col("least"), (F.lit(2.0 * per_language) / F.col("n") * F.lit(1 << 30)).cast("long"))
    near = rows.join(F.broadcast(sizes.select("lang", upto.alias("upto"))), "lang").where(F.col("h") <= F.col("upto"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("doc_id", "text", "lang")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the ``training_rows`` of ``docs``."""
    got = training_rows(docs, per_language).toPandas().sort_values(["lang", "doc_id", "text"])
    return fit(list(got["text"]), list(got["lang"]))


def chain_marginals(scores: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label distribution of every word of many chains laid end to end; ``first`` marks the
    chains' first words. Work goes block by block for all blocks at once: block products,
    then messages across blocks, then messages inside them."""
    n, k = scores.shape
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = blocks * size - n
    e = np.exp(scores - scores.max(1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, size, k)
    begin = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, size)
    t, s = np.exp(transition), np.broadcast_to(np.exp(start), (k, k))
    step = lambda i: np.where(begin[:, i, None, None], s, t) * e[:, i, None, :]
    product = np.broadcast_to(np.eye(k), (blocks, k, k))
    for i in range(size):
        product = product @ step(i)
        product = product / product.sum((1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    a = np.full(k, 1 / k)
    for b in range(blocks):
        into[b] = a
        a = a @ product[b]
        a = a / a.sum()
    a = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out[b] = a
        a = product[b] @ a
        a = a / a.sum()
    alpha = np.empty((blocks, size, k))
    a = into
    for i in range(size):
        a = (a[:, None, :] @ step(i))[:, 0]
        a = a / a.sum(1, keepdims=True)
        alpha[:, i] = a
    a = out
    for i in range(size - 1, -1, -1):
        alpha[:, i] *= a
        a = (step(i) @ a[:, :, None])[:, :, 0]
        a = a / a.sum(1, keepdims=True)
    node = alpha.reshape(-1, k)[:n]
    return node / node.sum(1, keepdims=True)


class WordScores:
    """Word to row of a table of emission scores, filled on demand and bounded."""

    def __init__(self, model: Model, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        if len(rows) > self.limit:
            rows.clear()
        for w in set(words).difference(rows):
            if len(rows) == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(rows)] = self.model.word_scores(w)
            rows[w] = len(rows)
        return self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))].astype(np.float64)


def label_texts(texts: list[str | None], model: Model, scores: WordScores) -> list[tuple[str, float, list[dict]]]:
    """For each text: language, score, and the runs of equally labelled words."""
    words = [letter_words(t) for t in texts]
    flat = [w for doc in words for w in doc]
    none = (UNKNOWN, 0.0, [])
    if not flat or not model.languages:
        return [none] * len(texts)
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    first = np.zeros(len(flat), bool)
    first[(ends - sizes)[sizes > 0]] = True
    node = chain_marginals(scores.of(flat), first, model.transition, model.start)
    best = node.argmax(1)
    run_at = np.flatnonzero(first | np.append(True, best[1:] != best[:-1]))
    run_size = np.diff(np.append(run_at, len(flat)))
    out = []
    for end, size in zip(ends, sizes):
        if not size:
            out.append(none)
            continue
        share = node[end - size:end].sum(0) / size
        k = int(share.argmax())
        lo, hi = np.searchsorted(run_at, [end - size, end])
        runs = [{"lang": model.languages[best[run_at[r]]], "words": int(run_size[r])} for r in range(lo, hi)]
        out.append((model.languages[k], float(min(1.0, share[k])), runs))
    return out


SCHEMA = "doc_id long, lang_pred string, score double, runs array<struct<lang:string,words:long>>"


def _label_batches(shared, with_runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "") // 6
                if size >= BATCH_WORDS:
                    got += label_texts(part, model, scores)
                    part, size = [], 0
            got += label_texts(part, model, scores)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                pa.array([g[2] if with_runs else [] for g in got], kind)], ["doc_id", "lang_pred", "score", "runs"])
    return run


def identify(docs: DataFrame, model: Model, with_runs: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and (if asked for) runs of word labels of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_label_batches(shared, with_runs), SCHEMA)


def keep_known(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` with a language that covers at least ``min_score`` of the text, columns as
    they came. A text in one language scores near 1; ``und`` texts and mixtures without a main language go."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = WordScores(shared.value)
        for texts in batches:
            out: list[bool] = []
            for i in range(0, len(texts), 64):
                part = [None if pd.isna(t) else t for t in texts.iloc[i:i + 64]]
                out += [lang != UNKNOWN and score >= min_score for lang, score, _ in label_texts(part, shared.value, scores)]
            yield pd.Series(out, dtype=bool)
    return docs.where(known("text"))

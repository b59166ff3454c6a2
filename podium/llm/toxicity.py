"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes (insults of three strengths, threats, targets, negations, words of
reporting, function words); a clause is a string of classes (single words in a row are one, one alone belongs to the clause after it). Eight small weighted transducers are composed, each reading
what the one before wrote; weights add along a path. An insult becomes a match only in a pattern: as a predicate or
in a noun phrase (a function word soon before or behind it), after another insult of its clause, near a target before or
behind it, which adds weight. A threat becomes a match at its target. A match soon after a negation loses more weight
than it can have, a match in reported speech (from a word of reporting to the clause's end, over a colon or quotation
marks) loses part of it. A match counts with what weight is left. Words outside a
pattern do not count, however strong.

A document's evidence is the weight of its matches by strength, in total and per word. Learned from labels by logistic
regression, no kind of evidence can count against toxicity, so undoing or quoting a match never raises a score.

Insults are learned: words and word stems that stand in far more toxic than other labelled texts
(likelihood ratio), besides a short list that is given. A word seen often has its own
class; others fall back to their longest stem. Function words are a given list and the words of up to four letters that a fifth of the texts or more have. The weights are fitted on texts that the lexicon was not
learned from (two halves, crosswise).

``train`` uses about ``max_docs`` toxic and as many other labelled documents. ``score`` reads every
text in full.

Defined results: null and empty texts have no matches and get the score of an empty text. Null labels are not
learned from; without both kinds of label the given lists and fixed weights hold. Repeated rows are scored
each. Only ``doc_id`` and ``text`` (and for learning the label) are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import bounded_sample, fold_of, texts_of

MAX_DOCS = 2500
STEMS = range(3, 9)
COMMON = 0.2
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n\"“”«»]")

# The given word lists.
INSULTS = "idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash".split()
THREATS = "kill hurt destroy beat burn shoot stab punish töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he she him her they them people du dich ihr euch sie vous toi ils elles ustedes ellos tú".split()
NEGATIONS = "not no never without isn't aren't wasn't don't nicht kein keine nie pas jamais sans nunca sin jamás".split()
REPORTING = "said says say called quoted wrote reported claims sagte sagt dit écrit dijo dice según selon laut".split()
FUNCTION = (
    "a an the this that such so is are was were be been and or as of by with der die das dem den ein eine einen ist sind war und so "
    "le la les un une des est sont était et si el los las una unos es son era y tan").split()
JOINTS = frozenset(':"“”«»')


@dataclass
class Transducer:
    """Deterministic and weighted: (state, input) -> (state, output, weight). Unlisted inputs go by ``other``, are
    copied and weigh nothing; a joint (K) leads to the start unless it is listed."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    other: dict[int, int] = field(default_factory=dict)
    start: int = 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (self.start if symbol == "K" else self.other.get(state, state), symbol, 0.0))


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The transducer that gives ``second`` what ``first`` writes, weights added; states reachable over ``symbols``."""
    numbers = {(first.start, second.start): 0}
    arcs, todo = {}, [(first.start, second.start)]
    while todo:
        a, b = todo.pop()
        for x in symbols:
            a2, y, v = first.step(a, x)
            b2, z, w = second.step(b, y)
            if (a2, b2) not in numbers:
                numbers[(a2, b2)] = len(numbers)
                todo.append((a2, b2))
            arcs[(numbers[(a, b)], x)] = (numbers[(a2, b2)], z, v + w)
    return Transducer(arcs)


# Input classes: 1 2 3 insults by strength, H threat, T target, N negation, R reporting, D function word, K joint, O other.
# Written: a b c insults outside of a pattern, A B C matches by strength, X threat match.
CLASSES = "123HTNRDKO"
MATCHES = "ABCX"
BARE = dict(zip("abc", "ABC"))
AIMED, NEGATED, REPORTED = 0.5, -4.0, -0.75


def _insults() -> Transducer:
    return Transducer({(0, k): (0, letter, 1.0) for k, letter in zip("123", "abc")})


def _phrases() -> Transducer:
    """An insult at most three words after a function word is a match, farther ones a little lighter."""
    arcs = {(s, "D"): (3, "D", 0.0) for s in range(4)}
    arcs |= {(s, x): (s, m, 0.1 * (s - 3)) for s in (1, 2, 3) for x, m in BARE.items()}
    return Transducer(arcs, other={3: 2, 2: 1, 1: 0})


def _repeats() -> Transducer:
    """An insult that follows another one in its clause is a match."""
    letters = [*BARE, *BARE.values()]
    return Transducer({(s, x): (1, BARE.get(x, x) if s else x, 0.0) for s in (0, 1) for x in letters})


def _threats() -> Transducer:
    """A target at most two words after a threat makes the threat a match."""
    arcs = {(s, "H"): (2, "H", 0.0) for s in range(3)} | {(s, "T"): (0, "X", 1.5) for s in (1, 2)}
    return Transducer(arcs, other={2: 1, 1: 0})


def _targets() -> Transducer:
    """An insult at most three words after a target is an aimed match."""
    arcs = {(s, "T"): (3, "T", 0.0) for s in range(4)}
    arcs |= {(s, x): (s, m, AIMED) for s in (1, 2, 3) for x in [*BARE, *BARE.values()] for m in x.upper()}
    return Transducer(arcs, other={3: 2, 2: 1, 1: 0})


def _heads() -> Transducer:
    """An insult outside of a pattern so far is a match when a target (aimed) or a function word follows, at most three words on."""
    arcs, other = {}, {}
    for n, (x, m) in enumerate(BARE.items()):
        after = range(1 + 3 * n, 4 + 3 * n)
        arcs |= {(s, x): (after[0], x, 0.0) for s in range(10)}
        arcs |= {(s, y): (0, m, w) for s in after for y, w in (("T", 1 + AIMED), ("D", 0.8))}
        other |= {after[0]: after[1], after[1]: after[2], after[2]: 0}
    return Transducer(arcs, other)


def _negations() -> Transducer:
    """A match at most three words after a negation is undone."""
    arcs = {(s, "N"): (3, "N", 0.0) for s in range(4)}
    arcs |= {(s, m): (s - 1, m, NEGATED) for s in (1, 2, 3) for m in MATCHES}
    return Transducer(arcs, other={3: 2, 2: 1, 1: 0})


def _reporting() -> Transducer:
    """From a word of reporting to the clause's end, matches are lighter."""
    return Transducer({(0, "R"): (1, "R", 0.0), (1, "K"): (1, "K", 0.0), **{(1, m): (1, m, REPORTED) for m in MATCHES}})


def parts() -> list[Transducer]:
    return [_insults(), _phrases(), _repeats(), _threats(), _targets(), _heads(), _negations(), _reporting()]


def grammar() -> Transducer:
    """The composition of the parts."""
    out, *rest = parts()
    for nxt in rest:
        out = compose(out, nxt, CLASSES)
    return out


class Lexicon:
    """Word to class, by own statistics, then by the longest listed stem, then by the given lists."""

    def __init__(self, words: dict[str, str] | None = None, stems: dict[str, str] | None = None, limit: int = 400_000):
        self.words, self.stems, self.limit = dict(words or {}), dict(stems or {}), limit
        for names, kind in ((INSULTS, "3"), (THREATS, "H"), (TARGETS, "T"), (NEGATIONS, "N"), (REPORTING, "R"), (FUNCTION, "D")):
            for w in names:
                if kind in "TNRD" or self.words.get(w, "O") in "OD":
                    self.words[w] = kind
        self.known: dict[str, str] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def classify(self, token: str) -> str:
        if not token[0].isalpha():
            return "K" if token in JOINTS else "B"
        if token in self.words:
            return self.words[token]
        for k in reversed(STEMS):
            if len(token) >= k and token[:k] in self.stems:
                return self.stems[token[:k]]
        return "O"

    def classes(self, text: str) -> str:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        tokens = TOKEN.findall(text.lower())
        for t in set(tokens).difference(known):
            known[t] = self.classify(t)
        return "".join(map(known.__getitem__, tokens))


def _strength(log_odds: float) -> str:
    return "3" if log_odds >= 4 else "2" if log_odds >= 2.5 else "1" if log_odds >= 1.2 else "O"


def learn_lexicon(texts: list[str], toxic: list[int], least: float = 20.0) -> Lexicon:
    """Words and stems whose presence in a text tells toxic ones: log odds for the strength, and a
    likelihood ratio G of at least ``least`` against chance."""
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    if not n1 or not n0:
        return Lexicon()
    seen = (Counter(), Counter()), (Counter(), Counter())  # [word or stem][label]
    for text, y in zip(texts, toxic):
        words = {t for t in TOKEN.findall(text.lower()) if t[0].isalpha()}
        seen[0][y].update(words)
        seen[1][y].update({w[:k] for w in words for k in STEMS if len(w) >= k})

    def judge(k1: int, k0: int) -> tuple[str, float]:
        odds = math.log((k1 + 0.3) / (n1 + 0.6)) - math.log((k0 + 0.3) / (n0 + 0.6))
        share = (k1 + k0) / (n1 + n0)
        g = 2 * sum(k * math.log(k / (n * share)) for k, n in ((k1, n1), (k0, n0)) if k)
        g += 2 * sum((n - k) * math.log((n - k) / (n * (1 - share))) for k, n in ((k1, n1), (k0, n0)) if n > k)
        return (_strength(odds) if odds > 0 and g >= least else "O"), odds

    words = {}
    for w in set(seen[0][1]) | set(seen[0][0]):
        kind, _ = judge(seen[0][1][w], seen[0][0][w])
        n = seen[0][1][w] + seen[0][0][w]
        if kind != "O" or n >= max(8, 0.02 * len(texts)):
            words[w] = "D" if kind == "O" and len(w) <= 4 and n >= COMMON * len(texts) else kind
    stems = {s: k for s in seen[1][1] if (k := judge(seen[1][1][s], seen[1][0][s])[0]) != "O"}
    return Lexicon(words, stems)


def clauses(classes: str) -> Iterator[str]:
    """The parts between clause ends. Single words in a row are one clause, one alone belongs to the clause after it."""
    ones = ""
    for part in classes.split("B"):
        if len(part) < 2:
            ones += part
            continue
        if len(ones) > 1:
            yield ones
            ones = ""
        yield ones + part
        ones = ""
    yield ones


def events(text: str | None, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """Weight of the matches over all clauses by their letter, their number, and the number of words."""
    total, matches = dict.fromkeys(MATCHES, 0.0), 0
    classes = lexicon.classes(text or "")
    arcs = machine.arcs
    for clause in clauses(classes):
        if clause.strip("OTNRDK"):
            state = machine.start
            for x in clause:
                state, y, weight = arcs[(state, x)]
                if y in total and weight > 0:
                    total[y] += weight
                    matches += 1
    return np.array([*total.values(), matches, len(classes) - classes.count("B") - classes.count("K")], float)


def features(rows: np.ndarray) -> np.ndarray:
    """Per letter: log of its weight, and its rate per word (root); then the log of the length."""
    weights, words = rows[:, :len(MATCHES)], rows[:, -1:]
    return np.hstack([np.log1p(weights), np.sqrt(weights / np.maximum(words, 1)), np.log1p(words) / 10])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(rows) @ self.weights + self.bias, -30, 30)))


#: without labels
FIXED = Model(Lexicon(), np.array([0.5, 1.0, 2.0, 2.0, *[2.0] * 4, -0.5]), -2.5)


def _fit_weights(x: np.ndarray, y: np.ndarray, bounded: int) -> np.ndarray:
    """Logistic regression with a ridge, the first ``bounded`` weights at least 0: Newton steps over the free
    weights; a weight that would fall below 0 is held there until the gradient frees it."""
    ridge = np.append(np.full(x.shape[1] - 1, 0.5), 1e-6)
    w = np.zeros(x.shape[1])
    inner = np.arange(len(w)) < bounded
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        free = ~(inner & (w <= 0) & (slope <= 0))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], slope[free])
        w = w + step
        w[inner] = np.maximum(w[inner], 0)
    return w


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """Lexicon from all texts; weights from the evidence that each half's other half's lexicon finds."""
    y = np.array(toxic, float)
    if not 0 < y.sum() < len(y):
        return FIXED
    machine = grammar()
    half = np.random.default_rng(seed).permutation(len(texts)) % 2
    rows = np.zeros((len(texts), len(MATCHES) + 2))
    for side in (0, 1):
        other = [i for i in range(len(texts)) if half[i] != side]
        lexicon = learn_lexicon([texts[i] for i in other], [toxic[i] for i in other])
        for i in np.flatnonzero(half == side):
            rows[i] = events(texts[i], lexicon, machine)
    w = _fit_weights(np.hstack([features(rows), np.ones((len(y), 1))]), y, 2 * len(MATCHES))
    return Model(learn_lexicon(texts, toxic), w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model from about ``max_docs`` documents of each label whose crc32 fold (of 5) is not 0."""
    usable = labels.select("doc_id", "toxic").where((fold_of("doc_id", 5) != 0) & F.col("toxic").isin(0, 1))
    got = [texts_of(docs, bounded_sample(usable.where(F.col("toxic") == y).distinct(), "doc_id", max_docs)).toPandas() for y in (1, 0)]
    rows = {(t or "", int(y)) for part in got for t, y in zip(part["text"], part["toxic"])}  # copies count once
    rows = sorted(rows)
    return fit([t for t, _ in rows], [y for _, y in rows])


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        machine = grammar()
        for batch in batches:
            rows = np.array([events(t.as_py(), model.lexicon, machine) for t in batch.column("text")]).reshape(-1, len(MATCHES) + 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(rows)), pa.array(rows[:, -2].astype(np.int64))],
                ["doc_id", "score", "n_matches"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and n_matches (those with weight left) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score_batches(shared), "doc_id long, score double, n_matches long")

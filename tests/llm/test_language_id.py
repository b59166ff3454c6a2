import itertools
import random

import numpy as np
import pytest

from podium.llm.common import read_table
from podium.llm.language_id import UNKNOWN, Model, WordScores, chain_marginals, fit, identify, keep_known, label_texts, letter_words, train, training_rows
from podium.llm.queries import QUERIES
from tests.conftest import SF_CHECK


def enumerated(scores, transition, start):
    """Marginals of one chain by summing over all label sequences."""
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        for i, p in enumerate(path):
            out[i, p] += w
    return out / out.sum(1, keepdims=True)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    t, s = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [1, 5, 2, 7, 4]
    chains = [rng.normal(size=(n, 3)) * 3 for n in sizes]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got = chain_marginals(np.concatenate(chains), first, t, s)
    want = np.concatenate([enumerated(c, t, s) for c in chains])
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    say = {"aa": ["lolo", "lomi", "loka", "lo"], "bb": ["trez", "zemz", "kez", "ezz"]}
    texts = [(" ".join(rng.choice(say[k]) for _ in range(30)), k) for k in ("aa", "bb") for _ in range(40)]
    return fit([t for t, _ in texts], [k for _, k in texts], steps=60)


def test_switched_text_is_labelled_word_by_word(model):
    (lang, score, runs), = label_texts(["lolo lomi loka lo trez zemz kez lolo lomi loka"], model, WordScores(model))
    assert lang == "aa" and 0.5 < score < 0.9
    assert [(r["lang"], r["words"]) for r in runs] == [("aa", 4), ("bb", 3), ("aa", 3)]


def test_defined_results(spark, docs_of, model):
    rows = [(1, None), (2, ""), (3, "123 $%"), (4, "²½"), (5, "trez " * 5000), (6, "lolo"), (6, "lolo"), (None, "kez")]
    docs = docs_of(rows, extra=("lang_pred", "score_", "runs"))
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in identify(docs, model).collect()), key=lambda x: x[:2])
    assert [x[:2] for x in got] == [(0, "bb"), (1, UNKNOWN), (2, UNKNOWN), (3, UNKNOWN), (4, UNKNOWN), (5, "bb"), (6, "aa"), (6, "aa")]
    assert all(0 <= x[2] <= 1 for x in got)
    nothing = fit([], [])
    assert nothing.languages == [] and isinstance(nothing, Model)
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {UNKNOWN}
    assert identify(docs_of([]), model).count() == 0


def test_empty_training_and_filter(docs_of):
    assert train(docs_of([])).languages == []
    rows = [(i, "lolo lomi loka", "aa") for i in range(30)] + [(100 + i, "trez zemz kez", "bb") for i in range(30)] + [(200, None), (201, "")]
    docs = docs_of(rows, extra=("known",))
    kept = keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 60


def test_a_rare_language_is_learned_at_every_size(docs_of):
    rows = [(i, f"wort und satz {i}", "de") for i in range(6000)] + [(None, "same words", "en")] * 300 + [(7003, "harvinainen kieli", "fi")]
    got = training_rows(docs_of(rows), 100).toPandas()["lang"].value_counts()
    assert got["fi"] == 1 and got["de"] == 100 and got["en"] == 100
    assert train(docs_of(rows), 20).languages == ["de", "en", "fi"]


def test_held_out_accuracy(spark):
    got = QUERIES["op4_language_id"](spark, SF_CHECK).join(read_table(spark, SF_CHECK, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_words_are_letter_runs():
    assert letter_words("It's 2 naïve_Tests ½²") == ["it", "s", "naïve", "tests"]

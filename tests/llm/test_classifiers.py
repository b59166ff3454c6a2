import numpy as np
import pytest

from podium.llm import quality_classifier as quality
from podium.llm import toxicity
from podium.llm.common import bounded_sample, read_table, texts_of
from podium.llm.queries import QUERIES
from tests.conftest import SF_CHECK

LABEL = "doc_id long, quality int, toxic int"


def matches_of(text):
    got = toxicity.events(text, toxicity.Lexicon(), toxicity.grammar())
    return {k: round(float(n), 2) for k, n in zip(toxicity.MATCHES, got) if n}


def test_grammar_on_clauses():
    assert matches_of("He sat. Moron") == matches_of("moron") == matches_of("lights, moron, lights") == {}  # a word outside a pattern
    assert matches_of("He sat. A moron") == {"C": 1.0}
    assert matches_of("A filthy moron") == {"C": 0.9}
    assert matches_of("moron and loser") == {"C": 1.8}
    assert matches_of("Moron is here") == {"C": 0.8}
    assert matches_of("You are a moron") == matches_of("Morons, you") == {"C": 1.5}
    assert matches_of("That is not a moron") == matches_of("You are never a moron") == {}
    assert matches_of("She said he is a moron") == matches_of('She said: "he is a moron"') == {"C": 0.75}
    assert matches_of("She said so. He is a moron") == {"C": 1.5}  # the clause ended
    assert matches_of("We will kill you") == {"X": 1.5} and matches_of("We will not kill you") == {}
    assert matches_of("Kill the lights") == {}
    assert matches_of("you and only you but then some words moron") == {}
    assert matches_of("The! Moron! Here! And! Loser!") == {"C": 2.0}  # marks after every word end no clause
    assert matches_of(None) == matches_of("") == {}


def test_composition_equals_running_one_after_the_other():
    machine = toxicity.grammar()
    rng = np.random.default_rng(0)
    for _ in range(300):
        clause = "".join(rng.choice(list(toxicity.CLASSES), 12))
        now, total = list(clause), np.zeros(12)
        for t in toxicity.parts():
            state, out = t.start, []
            for i, x in enumerate(now):
                state, y, w = t.step(state, x)
                out.append(y)
                total[i] += w
            now = out
        state, got, weights = machine.start, [], []
        for x in clause:
            state, y, w = machine.step(state, x)
            got.append(y)
            weights.append(w)
        assert got == now and np.allclose(weights, total)


def labelled_texts():
    """Insults of an unknown word in phrases (toxic), the same words of the clean texts alone in their clauses."""
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]

    def text(clauses):
        return ". ".join(" ".join(rng.choice(words, 8)) if c is None else c for c in clauses)
    toxic = [text([None, f"you are a {rng.choice(['zorgle', 'moron'])}", None]) for _ in range(120)]
    clean = [text([None, f"you are a {rng.choice(words)}", None]) for _ in range(360)]
    return toxic + clean, [1] * 120 + [0] * 360


def test_scores_follow_the_clauses():
    texts, y = labelled_texts()
    model, machine = toxicity.fit(texts, y), toxicity.grammar()

    def score(*texts):
        return model.scores(np.array([toxicity.events(t, model.lexicon, machine) for t in texts]))
    plain, quoted, undone, alone, none = score("you are a zorgle", "she said you are a zorgle", "you are not a zorgle", "zorgle", "wab wac wad wae")
    assert plain > quoted > undone and plain > 0.5 > alone and abs(undone - none) < 0.05
    assert (model.weights[:2 * len(toxicity.MATCHES)] >= 0).all()
    # without the clause patterns nothing is left to tell the texts
    rows = np.array([toxicity.events(t, model.lexicon, machine) for t in texts])
    rows[:, :len(toxicity.MATCHES)] = 0
    s, y = model.scores(rows), np.array(y)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() < 0.8 < (score(*texts)[y == 1][:, None] > score(*texts)[y == 0][None]).mean()


def test_stems_are_learned():
    texts = [f"zorgle{s} and more" for s in "abcdefghijklmnop"] * 2 + [f"plain words {i}" for i in range(200)]
    lexicon = toxicity.learn_lexicon(texts, [1] * 32 + [0] * 200)
    assert lexicon.classify("zorglezzz") == "3" and lexicon.classify("plain") == "O"


def test_toxicity_defined_results(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "you moron. " * 2000), (3, "you moron"), (None, "fine")], extra=("score", "n_matches"))
    model = toxicity.train(docs, spark.createDataFrame([], LABEL))
    assert model is toxicity.FIXED
    got = {(r.doc_id, r.n_matches): r.score for r in toxicity.score(docs, model).collect()}
    assert got[(1, 0)] == got[(2, 0)] and got[(3, 2000)] > 0.5 > got[(1, 0)]
    assert toxicity.score(docs_of([]), model).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 1)], LABEL)
    assert toxicity.train(docs, nulls) is toxicity.FIXED


def auc(rows):
    s = np.array([r.score for r in rows])
    y = np.array([r.y for r in rows])
    return (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()


def test_samples_stay_bounded_under_a_hot_id(spark, docs_of):
    docs = docs_of([(7, f"text {i}") for i in range(300)] + [(i, "other") for i in range(10, 20)])
    ids = bounded_sample(spark.createDataFrame([(7, 1)] * 500 + [(i, 1) for i in range(10, 20)], "doc_id long, toxic int").distinct(), "doc_id", 100)
    rows = texts_of(docs, ids).collect()
    assert len(rows) == 11 and [r.text for r in rows if r.doc_id == 7] == ["text 0"]


@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.8), ("op7_quality_classifier", "quality", 0.95)])
def test_held_out_ranking(spark, name, label, least):
    labels = read_table(spark, SF_CHECK, "labels").selectExpr("doc_id", f"{label} AS y")
    rows = QUERIES[name](spark, SF_CHECK).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and auc(rows) >= least


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (1500, 4))
    p, u = good[:1500], np.vstack([good[1500:], bad])
    net, prior = quality.fit(p, rng.permutation(u))
    assert abs(prior - 2500 / 4000) < 0.12
    assert (net.scores(rng.normal(1.5, 1, (500, 4))) > 0.5).mean() > 0.95
    assert (net.scores(rng.normal(-1.5, 1, (500, 4))) < 0.5).mean() > 0.95


def test_quality_defined_results(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a " * 5000), (3, "b"), (None, "c | d")], extra=("x", "score"))
    net, prior = quality.train(docs, spark.createDataFrame([], LABEL))
    assert net is None and {r.score for r in quality.score(docs, net).collect()} == {0.5}
    assert quality.score(docs_of([]), net).count() == 0
    assert all(np.isfinite(quality.text_features(t)).all() for t in (None, "", " ", "x", "\n\n", "| | |", "A" * 9999))

import random
from collections import Counter

from podium.llm.quality_rules import Limits, base_counts, host_rates, judge, keep_good

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    flat = text
    for c in SPACES:
        flat = flat.replace(c, " ")
    words = [w for w in flat.split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", "   \n\t", "one", "a b a b a b a", "x y z\nx y z\n\nx y z", "é ü ß ### **", "a\x0bb\x0cc a b c",
         "|" * 40 + " $$$ %%%", "same line\n same line\nsame line", "w " * 3000]


def test_counts_match_brute_force(docs_of):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab \n#") for _ in range(200)) for _ in range(30)]
    got = {r.doc_id: tuple(r.base)[:3] + tuple(r.base)[4:] for r in base_counts(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_clashing_columns_and_repeated_rows(docs_of):
    extra = ("t_words", "base", "passes", "bad_host", "BASE_", "host_is_bad")
    good = " ".join(f"word{i}" for i in range(60))
    docs = docs_of([(1, good, "en", "h"), (1, good, "en", "h"), (2, None, None, None), (None, good, None, None)], extra)
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 1), (True, None)]
    assert judge(docs).count() == 4


def test_empty_table(docs_of):
    assert judge(docs_of([])).count() == 0
    assert keep_good(docs_of([])).count() == 0


def test_small_hosts_are_shrunk(spark):
    rows = [("big", i < 60) for i in range(100)] + [("small", True)] + [(f"h{k}", i < 2 + k) for k in range(8) for i in range(50)]
    rates = {r.host: r.shrunk_rate for r in host_rates(spark.createDataFrame(rows, "source string, bad boolean"), "source", "bad").collect()}
    assert abs(rates["big"] - 0.6) < 0.1
    assert rates["small"] < 0.95  # one failure is not a rate of 1
    alike = spark.createDataFrame([("a", True), ("b", True)], "source string, bad boolean")
    assert {r.shrunk_rate for r in host_rates(alike, "source", "bad").collect()} == {1.0}


def test_bad_hosts_face_strict_rules(docs_of):
    words = [f"w{i}" for i in range(100)]
    junk = " ".join(w + "###" for w in words)
    mild = " ".join(words) + " " + "#" * 20  # over the strict limit, under the usual one
    rows = [(i, junk, "en", "bad") for i in range(50)] + [(100, mild, "en", "bad"), (101, " ".join(words), "en", "bad")]
    rows += [(200 + i, " ".join(words), "en", "fine") for i in range(50)] + [(300, mild, "en", "fine")]
    kept = {r.doc_id for r in judge(docs_of(rows), Limits()).where("kept").collect()}
    assert 100 not in kept and {101, 300, 200} <= kept
    assert {r.doc_id for r in keep_good(docs_of(rows)).collect()} == kept

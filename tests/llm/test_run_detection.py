"""Run detection against every period tried at every place."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from podium.llm import run_detection
from podium.llm.run_detection import Grammar, collapse, detect_runs, find_runs, planted, strongest


def tried(w, least=24):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 3 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(r):
    alphabet, w = r.choice([1, 2, 3, 5, 30]), []
    for _ in range(r.randint(1, 6)):
        w += [str(r.randrange(alphabet)) for _ in range(r.randint(1, 20))] * r.choice([1, 1, 2, 3, 4, 7, r.randint(1, 30)])
        if r.random() < .3:
            w += w[:r.randint(0, len(w))]
        if r.random() < .3:
            w[r.randrange(len(w))] = "x"
    return w[:500]


@pytest.mark.parametrize("few", [0, 32])
def test_runs_equal_brute_force(few, monkeypatch):
    monkeypatch.setattr(run_detection._Places, "FEW", few)  # 0: always by grams
    r, total = random.Random(few), 0
    for _ in range(600):
        w = words_of(r)
        assert find_runs(w) == tried(w), w
        total += len(tried(w))
    assert total > 500


def test_grammar_derives_the_words_and_has_no_repeated_pair():
    r = random.Random(3)
    for _ in range(50):
        w = [int(x) if x != "x" else 99 for x in words_of(r)]
        g = Grammar(w, 100)

        def derived(s):
            return [s] if s < 100 else derived(g.rules[s - 100][0]) + derived(g.rules[s - 100][1])
        assert [x for s in g.top for x in derived(s)] == w
        seen = {}
        for i, pair in enumerate(zip(g.top, g.top[1:])):
            assert i - seen.setdefault(pair, i) <= 1  # only overlapping ones, as in a a a
        for k, start in enumerate(g.starts):
            assert w[start:start + g.sizes[k]] == derived(100 + k)


@pytest.mark.parametrize("words", [["a"] * 60_000, list("abcdefg") * 9_000, [str(i % 20_000) for i in range(80_000)]])
def test_long_texts(words):
    q = len(set(words))
    assert find_runs(words) == [(0, len(words), q)]


def test_frequent_line_between_other_words():
    line, w = [f"w{i}" for i in range(10)], []
    for i in range(6000):
        w += [*line, str(i)]
    assert find_runs(w) == []


def digests(words, runs):
    cut = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = " ".join(x for i, x in enumerate(words) if i not in cut)
    return ("".join(f"{s},{n},{q}\n" for s, n, q in runs), left)


def test_documents(docs_of):
    """Nulls, empty and long texts, other white space, repeated rows and clashing column names."""
    rows = [(None, "a b " * 30), (1, None), (2, ""), (3, " \n\t "), (4, "a\x0bb\x0cc\r" * 12), (4, "a\x0bb\x0cc\r" * 12),
            (5, "a b c " * 30), (6, "x " * 5000), (7, "é ß " * 11 + "é"), (8, "one two three")]
    rows += [(i, " ".join(words_of(random.Random(i)))) for i in range(10, 60)]
    found = detect_runs(docs_of(rows, extra=["runs", "collapsed", "n_words"]), rewrite=True).collect()
    assert len(found) == len(rows)
    want = []
    for i, text in rows:
        words = [x.decode() for x in (text or "").encode().split()]
        if i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(len(words))]
        runs = tried(words)
        want.append((i, len(words), *digests(words, runs)))
    got = [(r.doc_id, r.n_words, "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs), r.collapsed) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[10:])


def test_empty_table(docs_of):
    assert detect_runs(docs_of([])).collect() == []


def test_strongest_run(spark):
    """Greatest length / period; ties by start, then period; none for no run."""
    df = spark.createDataFrame([(1, [(0, 24, 8), (5, 60, 20), (9, 30, 3), (50, 40, 4)]), (2, [(0, 30, 3), (40, 60, 6)]), (3, [])],
                               f"id long, runs array<{run_detection.RUN}>")
    got = {r.id: r.best for r in df.select("id", strongest(F.col("runs")).alias("best")).collect()}
    assert (got[1].start, got[2].start, got[3]) == (9, 0, None)


def test_collapse_keeps_words_outside_and_first_periods():
    words = [x.encode() for x in ("p q " + "a b c " * 9 + "z").split()]
    assert collapse(words, find_runs(words)) == b"p q a b c z"
    assert planted(words, None) == words and hashlib.sha256(collapse([], [])).hexdigest().startswith("e3b0c442")


def test_least_has_a_bound():
    with pytest.raises(ValueError):
        find_runs(["a"], least=10)

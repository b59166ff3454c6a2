import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm.decontaminate import (
    FMIndex, Phrases, contamination_spans, find_hits, judged, keep_clean, remove_spans, suffix_array, words_of,
)

ITEM = "item_id long, text string"


def brute(text, items):
    words = words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = words_of(t)
        for g in [iw[i:i + 13] for i in range(max(1, len(iw) - 12))] if iw else []:
            for i in range(len(words) - len(g) + 1):
                if words[i:i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=8))
def test_suffix_order_and_search(runs):
    text = np.array([x for r in runs for x in [*r, 0]])
    order = suffix_array(text)
    place = {int(p): k for k, p in enumerate(np.flatnonzero(text == 0))}
    key = lambda i: [(0, place[j]) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))]
    assert list(order) == sorted(range(len(text)), key=key)
    index = FMIndex([np.array(r) for r in runs], 3)
    for phrase in ([1], [2, 1], [1, 1, 2], [3, 3, 3]):
        lo, hi = index.search(np.array([phrase]), np.array([len(phrase)]))
        found = sorted(index.locate(np.arange(lo[0], hi[0])))
        assert found == [i for i in range(len(text)) if list(text[i:i + len(phrase)]) == phrase]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcxy"), max_size=60), max_size=6), st.lists(st.lists(st.sampled_from("abc"), max_size=18), max_size=4))
def test_hits_match_brute_force(docs, items):
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    phrases = Phrases([(str(i), t) for i, t in items])
    shard = [np.array([phrases.numbers.get(w, 0) for w in words_of(" ".join(d))], np.int64) for d in docs]
    got = find_hits(shard, phrases)
    for d, (spans, ids) in zip(docs, got):
        _, n_hit, want = brute(" ".join(d), items)
        assert sum(e - b for b, e in spans) == n_hit and ids == want


def test_rows_with_nulls_copies_and_clashes(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "Short one"), (4, "Short one"), (None, "p1 p2")], ITEM)
    rows = [(1, "x " * 50 + passage.upper() + " y"), (2, None), (3, ""), (4, "a short, ONE b"), (4, "a short, ONE b"), (5, "x " * 5000),
            (None, passage), (6, "short"), (7, "p1 p2")]
    docs = docs_of(rows, extra=("n_words", "spans", "bad_id"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in judged(docs, items).collect())
    # the item without an id counts as one, as in the query's SQL
    assert got == sorted([(1, 71, 20, 2, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 4, 2, 1, True), (4, 4, 2, 1, True),
                          (5, 5000, 0, 0, False), (0, 20, 20, 2, True), (6, 1, 0, 0, False), (7, 2, 2, 1, True)])
    kept = keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6]


def test_clean_rows_stay_beside_contaminated_ones(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage)], ITEM)
    docs = docs_of([(None, passage), (None, "clean one"), (None, None), (5, passage), (5, "clean two"), (6, passage + " x")])
    assert sorted((r.doc_id or 0, r.text or "") for r in keep_clean(docs, items).collect()) == [(0, ""), (0, "clean one"), (5, "clean two")]


def test_blocks_and_small_shards_change_nothing(spark, docs_of):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(rng.choice(["aa", "bb", "cc"], n))
    items = [(i, words(int(rng.integers(1, 20)))) for i in range(12)]
    docs = docs_of([(i, words(60)) for i in range(25)])
    frame = spark.createDataFrame(items, ITEM)
    want = {r.doc_id: brute(r.text, items) for r in docs.collect()}
    for options in ({}, {"shard_words": 100}, {"block_bytes": 40}):
        got = {r.doc_id: (r.n_words, sum(s.end - s.begin for s in r["spans"]), list(r["items"])) for r in contamination_spans(docs, frame, **options).collect()}
        assert got == want, options


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], ITEM)
    assert judged(docs_of([]), none).count() == 0
    assert [r.n_hit for r in judged(docs_of([(1, "a b")]), none).collect()] == [0]


def test_remove_spans():
    assert remove_spans("Keep this, cut THAT é now.", [(2, 4)]) == "Keep this,  é now."
    assert remove_spans(None, []) is None

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import packing
from podium.llm.bpe import nfc, pieces, vocabulary
from podium.llm.common import read_table, tokenizer_path
from podium.llm.token_counts import counts_of, longest_within, prefix_counts, prefix_table, tokens_of_prefix, with_budget
from tests.conftest import SF_SMALL

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "it's 'Re'll don't '' '' 's", "café İstanbul ΣΑΣ", "x <|endoftext|>y<|startoftext|> <|endof", "日本語 ½ ² Ⅳ ª b\x1cd\x85e",
       "naïve ßü 😀👍🏽 zzz", "a" * 300 + "!" * 300, "ẹ̀x ẛ̣", "!!<|endoftext|>!!", "한국어 가", "don'T'S 'l 'v 'VE", "tab\t\tand\r\n　end "]


@pytest.fixture(scope="module")
def library():
    return vocabulary(PATH).tokenizer


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_prefix_of_odd_texts(library):
    for text in ODD:
        text = nfc(text)
        width, growth = prefix_table(text, PATH)
        assert list(counts_of(width, growth)) == [len(encoded(library, text[:p])) for p in range(1, len(text) + 1)], text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aehinorstTHE'’.,!?é\n ½ 1_-İΣ") | st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=40))
def test_generated_texts(text):
    library = vocabulary(PATH).tokenizer
    width, growth = prefix_table(text, PATH)
    counts = counts_of(width, growth)
    assert (int(counts[-1]) if len(counts) else 0) == len(encoded(library, text))
    assert [i for p in pieces(text) for i in vocabulary(PATH).piece_ids(p)] == encoded(library, text)


def test_budgets_without_encoding_again(library):
    text = "The quick brown fox, it's unbelievable! " * 20
    table = prefix_table(text, PATH)
    for p in (0, 1, 7, 100, len(text)):
        assert tokens_of_prefix(*table, p) == len(encoded(library, text[:p]))
    for budget in (0, 1, 5, 50, 10 ** 6):
        cut = longest_within(*table, budget)
        assert len(encoded(library, text[:cut])) <= budget
        assert all(len(encoded(library, text[:p])) > budget for p in range(cut + 1, min(cut + 40, len(text)) + 1))


def test_whole_table_and_defined_results(spark, library, docs_of):
    docs = read_table(spark, SF_SMALL, "documents")
    want = {r.doc_id: (len(r.text.encode()), len(encoded(library, r.text))) for r in docs.collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in prefix_counts(docs).collect()} == want
    odd = docs_of([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x")], extra=("width", "growth"))
    got = with_budget(prefix_counts(odd), 1)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.fits) for r in got.collect()) == [
        (0, 1, 1, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 7, 2, 4), (3, 7, 2, 4)]
    assert prefix_counts(docs_of([])).count() == 0


def check_packing(rows, texts, library, window):
    """Round trip: every id in one piece, windows gapless, no padding but to powers of two."""
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(texts)
    for doc_id, got in of.items():
        ids = np.array(encoded(library, texts[doc_id]) + [1], "<u4")
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            part = ids[r.start:r.start + r.length].tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part) and bytes(r.ids) == part
            at += r.length
        assert at == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for got in windows.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at and length > 0
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


@pytest.mark.parametrize("shard", [1024, 7])
def test_packing_round_trip(spark, library, shard):
    docs = read_table(spark, SF_SMALL, "documents").repartition(3, "doc_id")
    rows = packing.packed(docs, shard_docs=shard).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, library, 2048)


def test_packing_defined_results(spark, library, docs_of):
    texts = {1: None, 2: "", 3: "word " * 9000, 4: "short one", None: "no id"}
    docs = docs_of(list(texts.items()), extra=("ids", "start", "length"))
    check_packing(packing.packed(docs, window=64).collect(), texts, library, 64)
    assert packing.packed(docs_of([])).count() == 0
    twice = packing.packed(docs_of([(1, "a b"), (1, "a b")])).collect()
    assert sum(r.length for r in twice) == 2 * (len(encoded(library, "a b")) + 1)


def brute_scores(docs, idf, mean):
    out = np.zeros((len(docs), len(docs)))
    for q, d in np.ndindex(*out.shape):
        for t in set(docs[q].tolist()):
            tf = int((docs[d] == t).sum())
            out[q, d] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) if tf else 0
    return out


def test_scores_and_neighbours():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, int(rng.integers(1, 40))) for _ in range(25)]
    idf = rng.random(30)
    index = packing.InvertedIndex(docs, idf, 20.0)
    want = brute_scores(docs, idf, 20.0)
    assert np.allclose([index.scores(d) for d in range(25)], want)
    steps = list(packing.neighbour_order(docs, idf, 20.0, 10 ** 6, 10 ** 6))
    assert steps[0][0] == 0 and [d for d, _, _ in steps[1:]] == [int(d) for d in np.argsort(-want[0], kind="stable") if d]
    random.seed(0)


def test_a_cut_document_opens_the_next_window():
    docs = [np.arange(6), np.arange(6), np.arange(6) + 10]
    steps = list(packing.neighbour_order(docs, np.ones(20), 6.0, 8, 8))
    assert steps == [(0, 0, 6), (1, 0, 2), (1, 2, 4), (2, 0, 4), (2, 4, 2)]

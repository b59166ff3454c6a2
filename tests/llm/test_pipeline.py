"""The pipeline's stages against brute-force twins on a small fixture."""

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_quality_rules import brute as brute_counts
from tests.llm.test_simhash_dedup import brute_components, brute_fingerprint

from podium.llm.common import read_table
from tests.conftest import SF_SMALL


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "language ID", "SimHash near-dedup", "benchmark decontamination", "packing"]


def test_each_stage_against_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    items = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns
        kept = {r.doc_id: r.text for r in out.collect()}
        assert len(kept) == out.count() and all(rows[i] == t for i, t in kept.items())
        if name == "quality rules":
            for i, t in rows.items():
                n, chars, symbols, _, repeats = brute_counts(t)
                if n < 50 or 2 * repeats > n:
                    assert i not in kept
                elif not symbols and not repeats and 20 * n <= 10 * chars <= 150 * n and len(set(t.split("\n"))) == len(t.split("\n")):
                    assert i in kept
        elif name == "language ID":
            assert set(kept) == {i for i, t in rows.items() if any(map(str.isalpha, t))}
        elif name == "SimHash near-dedup":
            roots = brute_components({i: brute_fingerprint(t) for i, t in rows.items()})
            assert set(kept) == set(roots.values())
        else:
            judged = {i: brute_hits(t, items) for i, t in rows.items()}
            assert set(kept) == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
        docs, rows = spark.createDataFrame(out.collect(), out.schema), kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0

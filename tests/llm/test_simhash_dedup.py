import numpy as np
import xxhash

from podium.llm.simhash_dedup import (
    allocate, components, connected, fingerprints, group_bits, keep_first, links, simhash,
)


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_match_definition():
    for t in (None, "", " ", "One", "one TWO", "ÀB c d É e", "a b c a b c a b c", "x y z w"):
        assert simhash(t) == brute_fingerprint(t), t


def test_same_hash_as_spark(spark):
    from pyspark.sql import functions as F
    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest("one two three", 42)


def test_thresholds_add_up_and_cost_least():
    rng = np.random.default_rng(0)
    for m in (2, 3, 4, 5):
        cost = rng.random((m, 5))
        got, total = allocate(cost, 3)
        assert sum(got) == 3 - m + 1
        assert abs(total - sum(cost[i, t + 1] for i, t in enumerate(got))) < 1e-9
        grid = np.array(np.meshgrid(*[range(-1, 4)] * m)).T.reshape(-1, m)
        ok = grid[grid.sum(1) == 3 - m + 1]
        assert abs(total - min(cost[np.arange(m), t + 1].sum() for t in ok)) < 1e-9


def test_groups_split_all_bits():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    groups = group_bits(sample, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_links_lose_none(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 40)
    prints = {int(c) for c in centres}
    for c in centres[:15]:
        for _ in range(20):
            x = int(c)
            for b in rng.choice(63, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    rows = {i: p for i, p in enumerate(sorted(prints))}
    df = spark.createDataFrame([(i, p) for i, p in rows.items()], "doc_id long, fp long")
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in components(df).collect()} == want
    for parts in ((2,), (3,), (4,)):  # any plan, and keys cut into many blocks
        edges = links(df.select("fp"), parts=parts, block=4)
        roots = {r.fp: r.root for r in connected(edges).collect()}
        by = {p: roots.get(p, p) for p in rows.values()}
        assert len(set(by.values())) == len(set(want.values()))


def test_documents_with_nulls_copies_and_clashes(docs_of):
    rows = [(3, "a b c d e"), (1, "A b c d e"), (2, None), (7, ""), (7, ""), (None, "q r s t u v"), (None, "q r s t u v"), (9, "z " * 3000)]
    docs = docs_of(rows, extra=("fp", "component_id", "root"))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in components(fingerprints(docs)).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 1), (7, 2), (7, 2), (9, 9)]
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 9]  # also of the rows without an id one stays
    assert components(fingerprints(docs_of([]))).count() == 0


def test_one_id_with_two_texts_keeps_one_of_each_group(docs_of):
    a, b = "a b c d e", " ".join(f"w{i}" for i in range(60))
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in keep_first(docs_of(rows, extra=("row_key", "least"))).collect()), key=str)
    assert kept([(5, a), (5, b), (5, b)]) == [(5, a), (5, b)]
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(5, a.upper()), (5, a), (5, None), (7, "")]) in ([(5, a), (5, None)], [(5, a.upper()), (5, None)])


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.fp: r.root for r in connected(edges).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and got[501] == 500

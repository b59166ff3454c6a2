"""The conversation trie against a trie of Python dictionaries."""

import hashlib
import random
import zlib

import pytest

from podium.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turns_in_order(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t[2] for t in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(source, [])[:h] + own[h:]
    return out


def brute(convs):
    """Rows as the operator returns them."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, held in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(path))
        rows.append((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(kids), len(leaves), saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def random_table(seed, convs=60):
    r, rows = random.Random(seed), []
    for c in r.sample(range(150), convs):
        for turn in range(r.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, r.choice(["user", "user", "user", None]), r.choice(["a", "a", "a", "a", "é", "", None])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, rebuild, block", [(1, False, 4), (2, True, 4), (3, True, 1), (4, False, 3)])
def test_trie_equals_brute_force(spark, seed, rebuild, block):
    rows = random_table(seed)
    convs = turns_in_order(rows)
    df = conversation_trie(spark.createDataFrame(rows, SCHEMA), rebuild=rebuild, block=block)
    want = brute(rebuilt(convs) if rebuild else convs)
    assert got(df) == want and len(want) > 80


def test_nulls_ties_long_texts_clashing_names_and_one_long_conversation(spark):
    """Null ids are left out, null turns come first, turns of one number in order of digest, rows count each; a
    conversation with most of the rows, and one that is its beginning."""
    rows = [(None, 1, "user", "lost"), (0, None, "user", "first"), (0, 3, None, None), (0, 3, "bot", "x"), (0, 3, "bot", "x"),
            (1, 0, "user", "long " * 20_000), (2, 0, "user", "long " * 20_000), (-7, 0, "user", "below"), (-5, 0, "user", "zero"),
            (9223372036854775807, 0, "user", "last")]
    rows += [(5, i, "user", f"turn {i % 3}") for i in range(300)] + [(6, i, "user", f"turn {i % 3}") for i in range(150)]
    convs = turns_in_order(rows)
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", DEPTH long, k0 string")
    assert got(conversation_trie(table)) == brute(convs)
    assert got(conversation_trie(table, rebuild=True)) == brute(rebuilt(convs))


def test_conversation_without_turns_and_empty_table(spark):
    """A rebuilt conversation may lose all turns; it is a member of the root and ends there."""
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    only = conversation_trie(spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA), rebuild=True)
    assert got(only) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert got(conversation_trie(spark.createDataFrame([], SCHEMA), rebuild=True)) == []

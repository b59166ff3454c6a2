"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: the 3-word shingles of the text with A-Z lowered (a text of fewer words is one
shingle), XXH64 with seed 42 each; a bit is set if it is set in over half of the hashes.

Candidates: the 64 bits are split into ``parts`` groups, correlated bits together
(``group_bits``). Groups have thresholds t_1..t_m with t_1 + ... + t_m = distance - m + 1;
two fingerprints within ``distance`` differ by at most t_i bits in some group i, so the
unequal thresholds that a dynamic program picks on estimated candidate counts
(``allocate``) lose no pair. A group with threshold -1 is not probed. With threshold t a
fingerprint has one key for each choice of t bits of the group, those bits masked out:
two values that differ in at most t bits share such a key.

Verification: fingerprints that share a key are compared in full. Exact copies are one
row before this. Keys with many fingerprints are cut into blocks, every pair of blocks
being a task's group of bounded size; a block pair returns a spanning forest
of its links, never all pairs. Components: large-star and small-star rounds over these edges, each stored.

Defined results: a null text and a text without words have fingerprint 0 and link like
any other. Repeated rows give repeated rows. Empty tables give empty results. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import bounded_sample, free_name, stored
from podium.operators.hints import join_on_hot_key

SEED = 42
BITS = 64


def text_hashes(text: str | None) -> np.ndarray:
    """XXH64 of the text's 3-word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.fromiter((digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])),
                       np.uint64, len(words) - 2)


def simhash(text: str | None, step: int = 8192) -> int:
    """The unsigned 64-bit fingerprint."""
    h = text_hashes(text)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), step):
        ones += np.unpackbits(h[i:i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprint_batches(batches):
    for batch in batches:
        fps = np.array([simhash(t.as_py()) for t in batch.column("text")], np.uint64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(fps.view(np.int64))], [*kept, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row; stored, since later steps read it
    more than once."""
    out = docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")
    return stored(out, "fingerprints")


# -- partitioning and thresholds ------------------------------------------------------------

def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bit positions into ``parts`` groups of like size, correlated bits together.

    Greedy: a group begins with the bit that is least correlated to the groups before and takes
    the free bit with the largest absolute correlation to its members until it is full.
    Bits inside a group then repeat each other, and different groups tell more.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    if len(sample) > 1:
        centred = bits - bits.mean(0)
        scale = np.sqrt((centred ** 2).sum(0))
        corr = np.abs(centred.T @ centred / np.maximum(np.outer(scale, scale), 1e-12))
    else:
        corr = np.zeros((BITS, BITS))
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        taken = [b for g in groups for b in g]
        first = min(free, key=lambda b: (corr[b, taken].sum() if taken else -corr[b].sum(), b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def estimated_costs(sample: np.ndarray, groups: list[list[int]], distance: int, rows: int) -> np.ndarray:
    """cost[i, t + 1]: estimated work of probing group i with threshold t.

    Keys (choose t of the group's bits) a fingerprint, plus the candidates: the sample's
    share of pairs within t bits in the group, times the pairs of all ``rows``, once
    for each key that such a pair shares.
    """
    cost = np.zeros((len(groups), distance + 2))
    n = len(sample)
    for i, bits in enumerate(groups):
        part = sample & _mask(bits)
        share = np.zeros(BITS + 1)
        for k in range(0, n, 512):
            share += np.bincount(np.bitwise_count(part[k:k + 512, None] ^ part[None, :]).ravel(), minlength=BITS + 1)
        share[0] -= n
        share /= max(n * (n - 1), 1)
        for t in range(distance + 1):
            pairs = sum(share[d] * comb(len(bits) - d, t - d) for d in range(t + 1))
            cost[i, t + 1] = 50.0 * rows * comb(len(bits), t) + pairs * rows * rows / 2
    return cost


def allocate(cost: np.ndarray, distance: int) -> tuple[list[int], float]:
    """Thresholds (-1 to ``distance`` each) with sum distance - m + 1 and the least total cost,
    by dynamic programming over the groups."""
    m = len(cost)
    need = distance + 1  # of t + 1 summed over the groups
    best = [0.0] + [np.inf] * need
    picks: list[list[int]] = []
    for i in range(m):
        new, pick = [np.inf] * (need + 1), [0] * (need + 1)
        for total in range(need + 1):
            for t1 in range(total + 1):
                c = best[total - t1] + cost[i, t1]
                if c < new[total]:
                    new[total], pick[total] = c, t1
        best = new
        picks.append(pick)
    out, total = [], need
    for pick in reversed(picks):
        out.append(pick[total] - 1)
        total -= pick[total]
    return out[::-1], float(best[need])


def plan_probes(distinct: DataFrame, distance: int, parts: tuple[int, ...], sample_rows: int) -> list[tuple[int, int]]:
    """The masks to probe with, as (mask id, bits kept within the group) pairs.

    Groups and thresholds only steer the work; any choice finds every pair. They come from a
    sample of at most ``sample_rows`` distinct fingerprints.
    """
    rows = distinct.count()
    got = bounded_sample(distinct.select("fp"), "fp", sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plans = []
    for m in parts:
        groups = group_bits(got, m)
        thresholds, cost = allocate(estimated_costs(got, groups, distance, rows), distance)
        plans.append((cost, groups, thresholds))
    _, groups, thresholds = min(plans, key=lambda p: p[0])
    masks = []
    for bits, t in zip(groups, thresholds):
        if t >= 0:
            masks += [int(_mask([b for b in bits if b not in out])) for out in combinations(bits, t)]
    return list(enumerate(masks))


# -- links ----------------------------------------------------------------------------------

def _find(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each class) after linking u[k] with v[k] for all k."""
    label = _find(label)
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        label = _find(label)


def _forest_of_run(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (as fp pairs) of the links inside runs of equal ``group`` (sorted)."""
    n = len(fp)
    label = np.arange(n)
    left = np.arange(n - 1) if n else np.zeros(0, np.int64)
    step = 1
    while len(left):
        left = left[left + step < n]
        left = left[group[left] == group[left + step]]
        near = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= distance]
        if len(near):
            label = join_labels(label, near, near + step)
        step += 1
    tail = np.flatnonzero(label != np.arange(n))
    return fp[tail], fp[label[tail]]


def _link_batches(distance: int):
    """Rows come sorted by group; a run that a batch's end cuts is carried to the next."""
    def run(batches):
        held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(g, f):
            a, b = _forest_of_run(g, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            g = np.concatenate([held_g, batch.column("g").to_numpy()])
            f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1], side="left")) if g[0] != g[-1] else 0
            yield edges(g[:cut], f[:cut])
            held_g, held_f = g[cut:], f[cut:]
        yield edges(held_g, held_f)
    return run


def links(distinct: DataFrame, distance: int = 3, parts: tuple[int, ...] = (2, 3, 4), block: int = 2048,
          sample_rows: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints such that two fingerprints within ``distance`` are connected.

    A key's fingerprints form blocks of about ``block``; a key of one block is one
    group. A larger one has a group for every pair of its blocks, so a row goes out once for each
    block of its key and no group holds more than about two blocks' rows.
    """
    masks = plan_probes(distinct, distance, parts, sample_rows)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(int(np.uint64(k).astype(np.int64)))).alias("k")) for i, k in masks])).alias("x")
    ).select("fp", F.xxhash64("x.m", "x.k").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > block).select(F.col("key"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    joined = join_on_hot_key(keyed, hot, "key", "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    groups = F.when(F.col("blocks").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda other: F.xxhash64("key", F.least(mine, other), F.greatest(mine, other))))
    rows = joined.select("fp", F.explode(groups).alias("g"))
    # groups are hashes: if two fell on one number, their rows would only be compared once more
    parted = rows.repartition("g").sortWithinPartitions("g")
    return parted.mapInArrow(_link_batches(distance), "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Node to the smallest node of its component, for every node of ``edges`` (a, b).

    Alternating large-star and small-star rounds, each stored in the shared folder, until
    a round changes nothing. Neighbourhoods are only ever reduced to their minimum, so a node with
    many edges costs an aggregate, not a group in one task.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        pairs = join_on_hot_key(both, least, "a")
        if large:
            out = pairs.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stored(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    state = mark(now)
    while True:
        now = stored(star(star(now, True), False), "edges")
        new = mark(now)
        if new == state:
            return now.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        state = new


def _members(prints: DataFrame, distance: int) -> DataFrame:
    """fp, first (its smallest doc_id) and root (the smallest fp of its component) of every distinct fp."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = connected(links(distinct.select("fp"), distance))
    return distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def components(prints: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of
    every row of ``prints`` (doc_id, fp)."""
    members = _members(prints, distance)
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = join_on_hot_key(members, least, "root").select("fp", "component_id")
    return join_on_hot_key(prints, by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = 3) -> DataFrame:
    """One document of each near-duplicate component: the row with the smallest doc_id (none counts as the
    greatest), then the smallest text hash, with its columns as they came. The hash finds the row again, so rows
    that share a doc_id, or have none, are told apart by their texts and each component keeps its own."""
    text_key = F.sha2("text", 256)
    keyed = docs.select("doc_id", "text", text_key.alias("row_key"))
    prints = stored(keyed.mapInArrow(_fingerprint_batches, "doc_id long, row_key string, fp long"), "fingerprints")
    rows = join_on_hot_key(prints, _members(prints, distance), "fp")
    firsts = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("least"))
    least, row_key = free_name(docs, "least"), free_name(docs, "row_key")
    firsts = firsts.select(F.col("least").alias(least)).distinct()
    found = docs.withColumn(row_key, text_key)
    here = F.col("doc_id").eqNullSafe(F.col(f"{least}.doc_id")) & F.col(row_key).eqNullSafe(F.col(f"{least}.row_key"))
    return found.join(firsts, here, "left_semi").dropDuplicates(["doc_id", row_key]).select(*docs.columns)

"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns (role, text); every distinct sequence of first d turns is a node. Turns
are grouped in blocks of ``block`` turns. A turn's digest is keyed by its position, and digests add up
(four sums of 32 bits each), so the digest of any prefix is a running sum: over the blocks it comes from the
distributed scan, inside a block from its few turns. Conversations are grouped by their successive block digests
first. Only where a block has siblings - other blocks after the same prefix, shorter last ones included - are
its turn boundaries compared with theirs; a block alone after its prefix keeps its members for all its turns.

Subtree figures need no walk over the tree. A node is named by its smallest member. A member that names a
node names all deeper nodes on its path, so it owns the lower end of its path; the sum over a subtree is the
sum, over the members, of what each owns from there down: a running sum along each owned end, plus the owned ends
that branch off below, which their owners' paths bring to each node above.

Texts are read once, for their digest; only digests, sizes and ids are shuffled. No step holds
a conversation, a node's members or a subtree in one task, whatever their share: turns are numbered and summed by
``scan``, groups are aggregated partially. Only the SHA-256 of a node's ended members runs through
one task, as a stream in id order with bounded memory, since that digest is one sequential function.

Defined results: a null role or text counts as empty; turns of one number (null first) stand in order of their
digests; repeated rows are turns each; rows with a null conv_id belong to no conversation and are left out.
Only conv_id, turn, role and text are read, so other columns and their names do not matter. An empty table has
no conversation and so no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.common import stored
from podium.operators.hints import join_on_hot_key
from podium.operators.scan import running_count, running_sum, scan

BLOCK = 4
LANES = [f"k{i}" for i in range(4)]  # a prefix's digest
PARENT = [f"p{i}" for i in range(4)]  # the digest of the prefix without the last turn
KEY = ["depth", *LANES]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, ... in order of turn, null first), digest and n_bytes (of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    return scan(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest", "n_bytes"], pos=running_count()).drop("turn")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its five."""
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % 5 and its own turns after its first h:
    conv_id, depth (1, 2, ...), digest, n_bytes. A conversation may come out without a turn."""
    family = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") <= 8)).select(
        F.col("conv_id").alias("source"), "pos", "digest", "n_bytes", F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("step"))
    family = family.withColumn("conv_id", F.try_add(F.col("source"), F.col("step").cast("long")))
    first = family.where((F.col("conv_id") - F.col("conv_id") % 5 == F.col("source")) & (F.col("pos") <= shared_turns(F.col("conv_id"))))
    known = turns.where(F.col("pos") == 1).select("conv_id")
    first = first.join(known, "conv_id", "left_semi").select("conv_id", F.col("pos").alias("depth"), "digest", "n_bytes")
    taken = first.groupBy("conv_id").agg(F.max("depth").alias("taken"))
    own = join_on_hot_key(turns.where(F.col("pos") > shared_turns(F.col("conv_id"))), taken, "conv_id", "left")
    depth = F.coalesce("taken", F.lit(0)) + F.col("pos") - shared_turns(F.col("conv_id"))
    return first.unionByName(own.select("conv_id", depth.alias("depth"), "digest", "n_bytes"))


def _lanes(digest: Column, depth: Column) -> list[Column]:
    """Four 32-bit numbers of a turn at its place."""
    one, two = F.xxhash64(digest, depth), F.xxhash64(depth, digest, F.lit("second"))
    low = F.lit((1 << 32) - 1)
    return [F.shiftrightunsigned(one, 32), one.bitwiseAND(low), F.shiftrightunsigned(two, 32), two.bitwiseAND(low)]


def block_chains(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block of each conversation: conv_id, blk, n (its turns), ``turns`` (their lanes and bytes), the
    digest p0..p3 of the prefix before it and k0..k3 of the prefix that ends with it."""
    t = turns.select("conv_id", "depth", "n_bytes", *[c.alias(n) for n, c in zip(LANES, _lanes(F.col("digest"), F.col("depth")))])
    blocks = t.groupBy("conv_id", F.floor((F.col("depth") - 1) / block).alias("blk")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("depth", *LANES, "n_bytes"))).alias("turns"),
        *[F.sum(k).alias(f"own_{k}") for k in LANES])
    chained = scan(blocks, ["conv_id"], ["blk"], **{k: running_sum(f"own_{k}") for k in LANES})
    return chained.select("conv_id", "blk", "n", "turns", *LANES, *[(F.col(k) - F.col(f"own_{k}")).alias(p) for k, p in zip(LANES, PARENT)])


def _prefixes(turns: Column, before: list[Column]) -> Column:
    """The block's prefixes as structs (depth, k0..k3, p0..p3, n_bytes), from those of its turns."""
    def upto(count, lane, start):
        return F.aggregate(F.slice(turns, 1, count), start, lambda a, t: a + t[lane])

    def at(t, i):
        last = [upto(i + 1, lane, start) for lane, start in zip(LANES, before)]
        return F.struct(t["depth"].alias("depth"), *[c.alias(k) for c, k in zip(last, LANES)],
                        *[(c - t[k]).alias(p) for c, k, p in zip(last, LANES, PARENT)], t["n_bytes"].alias("n_bytes"))
    return F.transform(turns, at)


def _nodes(chains: DataFrame, ids: DataFrame) -> DataFrame:
    """The distinct prefixes: depth, k0..k3, p0..p3, n_bytes, conv_id (smallest member), n_convs."""
    blocks = chains.groupBy("blk", *PARENT, *LANES, "n").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("turns").alias("turns"))
    siblings = blocks.groupBy("blk", *PARENT).agg(F.count(F.lit(1)).alias("siblings"))
    blocks = join_on_hot_key(blocks, siblings, ["blk", *PARENT])
    rows = blocks.select("siblings", "conv_id", "n_convs", F.inline(_prefixes(F.col("turns"), [F.col(p) for p in PARENT])))
    alone = rows.where(F.col("siblings") == 1).drop("siblings")
    apart = rows.where(F.col("siblings") > 1).groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        *[F.any_value(c).alias(c) for c in (*PARENT, "n_bytes")])
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where(F.col("n_convs") > 0).select(
        "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in LANES],
        *[F.lit(None).cast("long").alias(p) for p in PARENT], F.lit(0).cast("long").alias("n_bytes"))
    return alone.unionByName(apart).unionByName(root)


def _ended(rows: DataFrame) -> DataFrame:
    """KEY and ends_sha256: the SHA-256 of the ids, ascending and comma-joined, of the conversations that end there."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in done[0]] + [pa.array([done[1].hexdigest()])],
                                              [*KEY, "ends_sha256"])
        for batch in batches:
            closed = []
            columns = [batch.column(n).to_pylist() for n in (*KEY, "conv_id")]
            for *at, conv_id in zip(*columns):
                if at != key:
                    if key is not None:
                        closed.append((key, state))
                    key, state = at, hashlib.sha256(str(conv_id).encode())
                else:
                    state.update(b",%d" % conv_id)
            if closed:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in zip(*[k for k, _ in closed])] + [pa.array([s.hexdigest() for _, s in closed])],
                    [*KEY, "ends_sha256"])
        if key is not None:
            yield out((key, state))
    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return ordered.mapInArrow(digest, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the conversations ``ids`` (conv_id, distinct) with the turns ``turns`` (conv_id, depth from 1
    without gaps, digest, n_bytes).

    Per node: conv_id (smallest member) and depth, which name it and its text; parent_conv_id; n_convs; n_children;
    n_leaves and saved_tokens of its subtree (bytes that members share: (n_convs - 1) times the last text's);
    ends_sha256.
    """
    chains = stored(block_chains(turns, block), "trie-chains")
    nodes = stored(_nodes(chains, ids), "trie-nodes")
    parents = nodes.groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(PARENT, LANES)]).agg(
        F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(parents, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = (counted.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes"))
               .withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    # what a node's smallest member owns from the node down
    owned = stored(scan(counted, ["conv_id"], [F.col("depth").desc()], n_leaves=running_sum("leaf"), saved_tokens=running_sum("saved")), "trie-owned")
    ends = owned.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("bytes"))
    # the owners' paths above their own ends: each owned end belongs to the subtrees of these nodes
    above = join_on_hot_key(chains, ends, "conv_id").where(F.col("blk") * block < F.col("top"))
    start = F.struct((F.col("blk") * block).alias("depth"), *[F.col(p).alias(k) for p, k in zip(PARENT, LANES)])
    inner = F.transform(_prefixes(F.col("turns"), [F.col(p) for p in PARENT]), lambda t: F.struct(t["depth"].alias("depth"), *[t[k].alias(k) for k in LANES]))
    # a block's start is the end of the one before, so of the inner ones the last of a full block is left to the next
    starts = F.concat(F.array(start), F.filter(inner, lambda t: t["depth"] < (F.col("blk") + 1) * block))
    brought = above.select("top", "leaves", "bytes", F.inline(starts)).where(F.col("depth") < F.col("top"))
    brought = brought.groupBy(*KEY).agg(F.sum("leaves").alias("more_leaves"), F.sum("bytes").alias("more_bytes"))
    last = chains.groupBy("conv_id").agg(F.max_by(F.struct((F.col("blk") * block + F.col("n")).alias("depth"), *LANES), "blk").alias("at"))
    last = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col("at")[k], F.lit(0).cast("long")).alias(k) for k in KEY])
    names = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(LANES, PARENT)], F.col("conv_id").alias("parent_conv_id"))
    full = owned.join(brought, KEY, "left").join(_ended(last), KEY, "left")
    full = join_on_hot_key(full, names, ["depth", *PARENT], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("more_bytes", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, *, rebuild: bool = False, block: int = BLOCK) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text). rebuild: of its ``rebuilt_turns`` instead."""
    turns = stored(numbered_turns(conversations), "trie-turns")
    ids = turns.where(F.col("pos") == 1).select("conv_id")
    placed = rebuilt_turns(turns) if rebuild else turns.withColumnRenamed("pos", "depth")
    return trie(placed, ids, block)

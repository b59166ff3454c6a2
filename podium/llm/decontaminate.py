"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of a task's documents. Its words become numbers of the test
phrases' vocabulary; a word outside it cannot be part of an occurrence, so the indexed
string consists of the runs of known words, each closed by a separator, that are at
least as long as the shortest phrase. Over that string: suffix array by prefix doubling
(only rows still tied are sorted again), Burrows-Wheeler transform, a wavelet matrix for
ranks, and suffix positions sampled every ``SAMPLE`` words of a run. All phrases are
searched backward at once, the rows of the found intervals walk to the next sampled position, and the
occurrences merge into spans of words to remove.

Phrases: every window of 13 consecutive words of an item; an item with fewer words is
one window. They are a stated query set: sent to the workers in blocks of at most
``block_bytes`` of text, one pass over the documents for each block.

Defined results: a null or wordless text has no words, no hits and is not contaminated. Null or
wordless items have no windows; items without an id are one item, which counts and has no place in the list of
ids; repeated items count by their distinct item_id. Repeated document
rows are judged each by itself. With no items nothing is hit. Only ``doc_id``, ``text``
and ``item_id`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import free_name

WINDOW = 13
SAMPLE = 16
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 64 << 20

#: byte -> itself lowered if it belongs to a word, else a space
WORD_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, cut at every other ASCII character but letters and digits."""
    return (text or "").encode().translate(WORD_BYTES).split()


# -- index ------------------------------------------------------------------------------

def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols``; zeros are separators, each one smaller than any
    word and than every later separator, so no comparison runs past one."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    seps = np.flatnonzero(symbols == 0)
    rank += len(seps)
    rank[seps] = np.arange(len(seps))
    order = np.argsort(rank, kind="stable")
    k = 1
    rows = np.arange(n)  # places in ``order`` that are still tied
    head = np.empty(n, bool)  # place begins a class
    ranked = rank[order]
    head[0], head[1:] = True, ranked[1:] != ranked[:-1]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = ~(head & np.append(head[1:], True))
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        nxt = rank[np.minimum(at + k, n - 1)]  # a tied suffix has no separator in its first k symbols
        key = rank[at] * n + nxt
        by = np.argsort(key, kind="stable")
        order[rows] = at[by]
        key = key[by]
        head[rows] = np.append(True, key[1:] != key[:-1])
        start = np.maximum.accumulate(np.where(head[rows], rows, 0))
        rank[order[rows]] = start
        k *= 2


class WaveletMatrix:
    """Rank and access on a string of small numbers: one bit vector per bit, high bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, n = bits, len(values)
        self.ones, self.zeros = [], []
        now = values
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        top = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(values, minlength=1 << bits), out=top[1:])
        self.before = top[:-1]  # how many symbols are smaller
        self.first = self._walk(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i in range(self.bits):
            bit = (symbol >> (self.bits - 1 - i)) & 1
            ones = self.ones[i][place]
            place = np.where(bit == 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._walk(symbol, place) - self.first[symbol]

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The row of the suffix that has ``symbol`` before the suffix of row ``place``."""
        return self.before[symbol] + self.rank(symbol, place)


class FMIndex:
    """Backward search and location over runs of word numbers (1 and up)."""

    def __init__(self, runs: list[np.ndarray], vocabulary: int):
        parts = [x for run in runs for x in (run, np.zeros(1, run.dtype))]
        self.text = np.concatenate(parts).astype(np.int64)
        n = len(self.text)
        order = suffix_array(self.text)
        self.bwt = self.text[order - 1]  # the last symbol is a separator: it precedes row of position 0
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(vocabulary).bit_length()))
        starts = np.concatenate([[0], np.flatnonzero(self.text[:-1] == 0) + 1])
        in_run = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        kept = (in_run % SAMPLE == 0)[order]
        self.sampled_before = np.concatenate([[0], np.cumsum(kept)])
        self.is_sampled = kept
        self.samples = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each phrase (rows of ``phrases``, filled up with zeros at the end)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.text), np.int64)
        alive = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            alive = alive[(lengths[alive] >= back) & (hi[alive] > lo[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - back]
            lo[alive] = self.wavelet.step(symbol, lo[alive])
            hi[alive] = self.wavelet.step(symbol, hi[alive])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows, by walking back to a sampled one."""
        out, at, moved = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.is_sampled[at[left]]
            hit = left[done]
            out[hit] = self.samples[self.sampled_before[at[hit]]] + moved
            left = left[~done]
            at[left] = self.wavelet.step(self.bwt[at[left]], at[left])
            moved += 1
        return out


# -- phrases ----------------------------------------------------------------------------

def _named_first(item_id: str | None) -> tuple[bool, str]:
    """Sorts ids as strings, no id last."""
    return item_id is None, item_id or ""


class Phrases:
    """The distinct windows of a block of items, as word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows.setdefault(tuple(ids[i:i + WINDOW]), set()).add(item_id)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.rows = np.zeros((len(windows), WINDOW), np.int64)
        for k, w in enumerate(windows):
            self.rows[k, :len(w)] = w
        self.items = [sorted(x, key=_named_first) for x in windows.values()]
        self.shortest = int(self.lengths.min()) if len(windows) else 0


def find_hits(shard: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each document of a shard (its word numbers, 0 for unknown): the merged spans of hit
    words, and the ids of the items with an occurrence."""
    out: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in shard]
    sizes = np.array([len(d) for d in shard], np.int64)
    flat = np.concatenate(shard) if len(shard) else np.zeros(0, np.int64)
    if not len(flat) or not phrases.shortest:
        return out
    known = np.concatenate([[False], flat > 0, [False]])
    edge = known[1:] != known[:-1]
    doc_start = np.concatenate([[0], np.cumsum(sizes)])
    inner = doc_start[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    begins = np.flatnonzero(edge & known[1:])
    ends = np.flatnonzero(edge & known[:-1])
    cuts = np.unique(inner[known[inner] & known[inner + 1]])  # a run must not cross documents
    begins, ends = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([ends, cuts]))
    long = ends - begins >= phrases.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return out
    index = FMIndex([flat[b:e] for b, e in zip(begins, ends)], len(phrases.numbers))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    if not len(which):
        return out
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    place = index.locate(rows)
    run_start = np.concatenate([[0], np.cumsum(ends - begins + 1)])[:-1]
    run = np.searchsorted(run_start, place, side="right") - 1
    word = begins[run] + place - run_start[run]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + phrases.lengths[which], -1)
    hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edge = hit[1:] != hit[:-1]
    span_b, span_e = np.flatnonzero(edge & hit[1:]), np.flatnonzero(edge & hit[:-1])
    cuts = np.unique(inner[hit[inner] & hit[inner + 1]])
    span_b, span_e = np.sort(np.concatenate([span_b, cuts])), np.sort(np.concatenate([span_e, cuts]))
    for b, e in zip(span_b, span_e):
        d = int(np.searchsorted(doc_start, b, side="right")) - 1
        out[d][0].append((int(b - doc_start[d]), int(e - doc_start[d])))
    doc = np.searchsorted(doc_start, word, side="right") - 1
    for d, w in np.unique(np.stack([doc, which], 1), axis=0):
        out[d][1].extend(phrases.items[w])
    return [(spans, sorted(set(ids), key=_named_first)) for spans, ids in out]


SCHEMA = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
_ARROW = pa.schema([("n_words", pa.int64()),
                    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    ("items", pa.list_(pa.string()))])


def _searched(docs: DataFrame, phrases: Phrases, shard_words: int) -> DataFrame:
    """``docs`` (doc_id of any type, text) with the hits of the phrases instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    return docs.mapInArrow(_search_batches(shared, shard_words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def _search_batches(shared, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        number = phrases.numbers.get
        ids: list = []
        shard: list[np.ndarray] = []
        words = 0
        kind = pa.int64()

        def flush():
            found = find_hits(shard, phrases)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, kind), pa.array([len(d) for d in shard], pa.int64()),
                pa.array([[{"begin": b, "end": e} for b, e in s] for s, _ in found], _ARROW.field("spans").type),
                pa.array([x for _, x in found], _ARROW.field("items").type)], names=["doc_id", *_ARROW.names])

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                numbers = [number(w, 0) for w in words_of(text.as_py())]
                ids.append(doc_id)
                shard.append(np.array(numbers, np.int64))
                words += len(numbers)
                if words >= shard_words:
                    yield flush()
                    ids.clear(), shard.clear()
                    words = 0
        if ids:
            yield flush()
    return run


def _blocks(items: DataFrame, block_bytes: int) -> list[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size; one block is on the driver at a time while it is filled."""
    blocks, now, size = [], [], 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    for r in rows.toLocalIterator():
        n = len(r.text or "")
        if now and size + n > block_bytes:
            blocks.append(now)
            now, size = [], 0
        now.append((r.item_id, r.text))
        size += n
    return blocks + [now]


def contamination_spans(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged ranges of hit words, end excluded) and items (ids, sorted
    as strings) of every row of ``docs``."""
    source = docs.select("doc_id", "text")
    parts = [_searched(source, Phrases(block), shard_words) for block in _blocks(items, block_bytes)]
    if len(parts) == 1:
        return parts[0]
    # several blocks: a row's parts meet by its place in the scan, which every pass shares
    spots = source.withColumn("_row", F.monotonically_increasing_id())
    return _merged_blocks(spots, items, shard_words, block_bytes)


def _merged_blocks(spots: DataFrame, items: DataFrame, shard_words: int, block_bytes: int) -> DataFrame:
    """The union of the blocks' results; spans of one row are merged again."""
    keyed = spots.select(F.col("_row").alias("doc_id"), "text")
    parts = None
    for block in _blocks(items, block_bytes):
        one = _searched(keyed, Phrases(block), shard_words)
        parts = one if parts is None else parts.unionByName(one)
    merged = parts.groupBy(F.col("doc_id").alias("_row")).agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kind = "array<struct<begin:bigint,end:bigint>>"
    joined = F.aggregate(
        "spans", F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["begin"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
        )).otherwise(F.concat(acc, F.array(s))))
    return spots.select("_row", "doc_id").join(merged, "_row").select("doc_id", "n_words", joined.alias("spans"), "items")


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the characters from the first to the last word of each span."""
    if not text or not spans:
        return text
    raw = text.encode()
    kept = raw.translate(WORD_BYTES)
    inside = np.frombuffer(kept, np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for b, e in spans:
        out.append(raw[at:begins[b]])
        at = ends[e - 1]
    return b"".join([*out, raw[at:]]).decode()


def judged(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The contract's columns: n_words, n_hit, n_items, items_sha256, contaminated, with the spans."""
    found = contamination_spans(docs, items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "spans",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they came. The text decides,
    and its hash finds the row again: rows that share a doc_id (or have none) are judged each by itself."""
    key, text_key = free_name(docs, "bad_key"), F.sha2("text", 256)
    bad = judged(docs.select(text_key.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, text_key == F.col(key), "left_anti").select(*docs.columns)

"""Lexical retrieval packing: related documents share a window.

``tokenized`` turns each document into token ids (library ids, then one end id) once and stores them.
``global_statistics`` counts, over all documents, in how many each token occurs and the mean
length; the vocabulary bounds both. ``packed`` then works shard by shard, a shard being
up to ``shard_docs`` documents of one task: it builds a BM25 inverted index of the shard, takes the first
unused document as seed of a window, asks the index for the unused neighbours of the seed in order
of score, and fills the window greedily. A document that does not fit is cut; its rest
opens the next window and is the next seed. Documents without a common token come last, in order.
An open window goes on into the task's next shard. A task's last window is cut into
sequences whose lengths are powers of two, so there is no padding.

Defined results: a null text counts as empty and is the end id alone. Repeated rows are packed
each. An empty table gives no pieces. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.bpe import PieceCache, pieces, vocabulary
from podium.llm.common import stored, tokenizer_path

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 1024
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
ROWS_OUT = 256


@lru_cache(maxsize=2)
def _piece_bytes(path: str, kind: str) -> PieceCache:
    """Per worker: the ids of a piece as numbers of type ``kind``; a piece of several words is put
    together from its words' entries."""
    vocab = vocabulary(path)
    written = [i.to_bytes(np.dtype(kind).itemsize, "little") for i in range(vocab.size)]
    tokenize = vocab.model.tokenize

    def word(w: str) -> bytes:
        if not w.isascii() or not w.isalpha():
            w = vocab.byte_level(w)
        return b"".join([written[t.id] for t in tokenize(w)])

    def piece(p: str) -> bytes:
        words = vocab.plain_words(p)
        if words is None:
            return b"".join([written[i] for i in vocab.piece_ids(p)])
        if len(words) == 1:
            return word(words[0]) if words[0] == p else kept[words[0]]
        return b"".join([kept[w] for w in words])

    kept = PieceCache(piece, limit=1_200_000)
    return kept


def token_bytes(text: str | None, path: str, kind: str = "<u4") -> bytes:
    """The text's ids, then the end id, as numbers of type ``kind``."""
    cache = _piece_bytes(path, kind)
    return b"".join([cache[p] for p in pieces(text or "")]) + np.array([END_ID], kind).tobytes()


def _token_batches(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                ids = [token_bytes(t, path, kind) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return run


def tokenized(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> tuple[DataFrame, str]:
    """doc_id and ids of every row, stored, and the numpy type of the ids (two bytes if the
    vocabulary allows)."""
    path = tokenizer_path(tokenizer)
    kind = "<u4" if vocabulary(path).size > 1 << 16 else "<u2"
    out = docs.select("doc_id", "text").mapInArrow(_token_batches(path, kind), "doc_id long, ids binary")
    return stored(out, "tokens"), kind


def distinct_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document in order, and how often each occurs."""
    ordered = np.sort(ids, kind="stable")  # a radix sort for two-byte ids
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def global_statistics(tokens: DataFrame, kind: str, vocabulary_size: int) -> tuple[np.ndarray, int, int]:
    """In how many documents each token occurs, the number of documents and of tokens. A task
    sends one vector; the sum has as many rows as the vocabulary."""
    def count(batches):
        seen = np.zeros(vocabulary_size, np.int64)
        docs = total = 0
        for batch in batches:
            for ids in batch.column("ids"):
                a = np.frombuffer(ids.as_py(), kind)
                seen[distinct_counts(a)[0]] += 1
                docs += 1
                total += len(a)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(seen[at], [docs, total]))], ["token", "n"])

    sums = tokens.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(vocabulary_size, np.int64)
    by = dict(zip(sums["token"], sums["n"]))
    docs, total = int(by.pop(-1, 0)), int(by.pop(-2, 0))
    df[list(by.keys())] = list(by.values())
    return df, docs, total


class InvertedIndex:
    """BM25 postings of one shard, by token; document frequencies are the whole corpus's. The list of a
    token that over an eighth of the shard's documents have is kept as a row over all of them."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, owners, weights, self.terms_of = [], [], [], []
        for d, ids in enumerate(docs):
            t, tf = distinct_counts(ids)
            self.terms_of.append(t)
            terms.append(t)
            owners.append(np.full(len(t), d))
            weights.append((idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length))))
        term, owner, weight = np.concatenate(terms), np.concatenate(owners), np.concatenate(weights)
        size = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(size > len(docs) / 8)
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        full = self.row[term] >= 0
        self.common = np.zeros((len(common), len(docs)), np.float32)
        self.common[self.row[term[full]], owner[full]] = weight[full]
        term, owner, weight, size[common] = term[~full], owner[~full], weight[~full], 0
        by = np.argsort(term, kind="stable")
        self.owner, self.weight, self.docs = owner[by], weight[by], len(docs)
        self.at = np.zeros(len(idf) + 1, np.int64)
        np.cumsum(size, out=self.at[1:])

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct tokens of ``doc``."""
        t = self.terms_of[doc]
        asked = np.zeros(len(self.common), np.float32)
        asked[self.row[t[self.row[t] >= 0]]] = 1
        out = (asked @ self.common).astype(np.float64)
        lists = [slice(a, b) for a, b in zip(self.at[t].tolist(), self.at[t + 1].tolist()) if a < b]
        if lists:
            owners = np.concatenate([self.owner[x] for x in lists])
            out += np.bincount(owners, np.concatenate([self.weight[x] for x in lists]), minlength=self.docs)
        return out


def neighbour_order(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, room: int, window: int):
    """Yields (document, start, length) in packing order: each window's seed, then its nearest
    unused neighbours. ``room`` is what the open window has left. The first document is its seed."""
    index = InvertedIndex(docs, idf, mean_length)
    unused = np.ones(len(docs), bool)
    first = 0
    while True:
        while first < len(docs) and not unused[first]:
            first += 1
        if first == len(docs):
            return
        seed, at = first, 0
        unused[seed] = False
        while seed is not None:
            take = min(len(docs[seed]) - at, room)
            yield seed, at, take
            room -= take
            if not room:
                room, at = window, at + take
                if at == len(docs[seed]):
                    seed = None  # the window is full and nothing is left over
                continue
            order = np.argsort(-np.where(unused, index.scores(seed), -1.0), kind="stable")
            seed = None
            for d in order[:int(unused.sum())]:
                take = min(len(docs[d]), room)
                yield int(d), 0, take
                unused[d] = False
                room -= take
                if not room:
                    room = window
                    if take < len(docs[d]):
                        seed, at = int(d), take  # its rest opens the next window
                    break


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_batches(kind: str, idf, mean_length: float, window: int, shard_docs: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        open_pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the open window
        filled = 0

        def rows(pieces_in_order, sequence):
            out, offset = [], 0
            for doc_id, start, ids, total in pieces_in_order:
                raw = ids.astype("<u4").tobytes()
                out.append((doc_id, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw))
                offset += len(ids)
            return out

        def batch_of(out):
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def pack(ids, docs):
            nonlocal number, filled, open_pieces
            out = []
            for d, start, length in neighbour_order(docs, idf.value, mean_length, window - filled, window):
                open_pieces.append((ids[d], start, docs[d][start:start + length], len(docs[d])))
                filled += length
                if filled == window:
                    out += rows(open_pieces, number)
                    number, filled, open_pieces = number + 1, 0, []
                    if len(out) >= ROWS_OUT:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

        ids, docs, size = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids.append(doc_id)
                docs.append(np.frombuffer(raw.as_py(), kind))
                size += len(docs[-1])
                if len(docs) >= shard_docs or size >= shard_tokens:
                    yield from pack(ids, docs)
                    ids, docs, size = [], [], 0
        if docs:
            yield from pack(ids, docs)
        # the last window: sequences of 1024, 512, ... tokens as the bits of its length say
        while filled:
            room = 1 << (filled.bit_length() - 1)
            filled -= room
            now = []
            while room:
                doc_id, start, a, total = open_pieces.pop(0)
                now.append((doc_id, start, a[:room], total))
                if len(a) > room:
                    open_pieces.insert(0, (doc_id, start + room, a[room:], total))
                room -= min(room, len(a))
            yield batch_of(rows(now, number))
            number += 1
    return run


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW,
           shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the
    piece's ids (little-endian 32-bit)."""
    spark = docs.sparkSession
    tokens, kind = tokenized(docs, tokenizer)
    df, n_docs, n_tokens = global_statistics(tokens, kind, vocabulary(tokenizer_path(tokenizer)).size)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    return tokens.mapInArrow(
        _pack_batches(kind, spark.sparkContext.broadcast(idf), max(1.0, n_tokens / max(1, n_docs)), window, shard_docs, shard_tokens), SCHEMA)

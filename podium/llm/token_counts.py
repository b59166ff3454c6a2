"""Exact token counts of every prefix of a text.

A dynamic program over the prefixes of each word (``bpe.PrefixBpe``) gives the number of
tokens of every prefix; words are counted once and kept. A document's table holds, for each of its code
points, how much the count grows there, one byte each (two in a table that needs them): the
count of the whole text is the sum, the count of any prefix a partial sum, and the longest prefix
within a budget is found without encoding anything again.

Positions are code points of the text in NFC, the form that the vocabulary sees.

Defined results: a null text counts as empty: 0 bytes, 0 tokens, an empty table. Repeated rows
are counted each. Only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.bpe import PieceCache, PrefixBpe, nfc, pieces, vocabulary
from podium.llm.common import tokenizer_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, width int, growth binary"
ROWS_OUT = 64


def _growth(counts: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *counts], counts)]


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[PieceCache, PieceCache]:
    """Per worker: the growth at each code point of a piece, in a byte (None: does not fit) and in two."""
    prefix = PrefixBpe(vocabulary(path))

    def narrow(piece: str) -> bytes | None:
        g = _growth(prefix.piece_counts(piece))
        return np.array(g, np.int8).tobytes() if not g or (min(g) >= -128 and max(g) <= 127) else None

    return PieceCache(narrow), PieceCache(
        lambda piece: np.array(_growth(prefix.piece_counts(piece)), "<i2").tobytes(), limit=10_000)


def prefix_table(text: str | None, path: str) -> tuple[int, bytes]:
    """(bytes per code point, growth of the count at each code point)."""
    narrow, wide = _tables(path)
    parts = pieces(nfc(text or ""))
    try:
        return 1, b"\0".join([narrow[p] for p in parts])
    except TypeError:  # a piece that needs more than a byte
        return 2, b"\0\0".join([wide[p] for p in parts])


def counts_of(width: int, growth: bytes) -> np.ndarray:
    """The token count of each non-empty prefix."""
    return np.cumsum(np.frombuffer(growth, np.int8 if width == 1 else "<i2"), dtype=np.int64)


def tokens_of_prefix(width: int, growth: bytes, length: int) -> int:
    """Tokens of the first ``length`` code points."""
    counts = counts_of(width, growth[:length * width])
    return int(counts[-1]) if len(counts) else 0


def longest_within(width: int, growth: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    fits = np.flatnonzero(counts_of(width, growth) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS_OUT):  # tables of long texts leave in small batches
                batch = whole.slice(at, ROWS_OUT)
                texts = batch.column("text").to_pylist()
                tables = [prefix_table(t, path) for t in texts]
                totals = [int(np.frombuffer(g, np.int8 if w == 1 else "<i2").sum(dtype=np.int64)) for w, g in tables]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array(totals, pa.int64()), pa.array([w for w, _ in tables], pa.int32()),
                    pa.array([g for _, g in tables], pa.binary())],
                    ["doc_id", "n_bytes", "n_tokens", "width", "growth"])
    return run


def prefix_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_bytes, n_tokens and the prefix table (width, growth) of every row."""
    path = tokenizer_path(tokenizer)
    return docs.select("doc_id", "text").mapInArrow(_count_batches(path), SCHEMA)


def with_budget(tables: DataFrame, budget: int) -> DataFrame:
    """Adds ``fits`` (code points of the longest prefix within ``budget`` tokens) to a prefix table."""
    @F.pandas_udf("long")
    def fits(width, growth):
        return width.combine(growth, lambda w, g: longest_within(w, bytes(g), budget))
    return tables.withColumn("fits", fits("width", "growth"))

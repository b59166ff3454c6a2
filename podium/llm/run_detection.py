"""Periodic runs of words, found on a grammar of each text.

The words of a text are numbered and compressed by Re-Pair: the most frequent pair of neighbouring
symbols becomes a nonterminal, until no pair occurs twice. A run lies across the boundary between the
two halves of some nonterminal, or across a boundary of the start rule, so runs are searched at these
boundaries only, once per nonterminal however often it occurs. What a nonterminal holds is translated to
all its positions in the derivation; a run cut off at a nonterminal's edge is found whole further up, so of
the intervals of one period those inside another are merged into it.

A run is a stretch of words with the smallest period q (words q apart are the same) and a length of at
least ``max(least, 3 q)`` that no neighbouring word extends. Why pairs lead to all of them: the longer
side of such a run, seen from a boundary inside it, has at least ``max(least, 3 q) / 2`` words, so with
``least`` of 24 or more at least four words beside the boundary occur again q words on.

Defined results: a null or empty text has no words and no runs; a text is read as a whole, whatever its
length; repeated rows are searched each; a null doc_id names no rewrite (``planted``). Only ``doc_id``
and ``text`` are read, so other columns and their names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "struct<start:long,length:long,period:long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
LEAST = 24
ROWS_OUT = 256


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that one of ten ids asks for: from word a on, the words repeat
    with a period that the id's checksum fixes."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


class Grammar:
    """Re-Pair over a list of numbers.

    ``rules[k]`` is the pair that nonterminal ``first + k`` stands for, ``sizes[k]`` how many numbers it
    derives, ``starts[k]`` where its first occurrence begins; ``top`` lists the start rule's symbols.
    ``pairs`` keeps the positions of the repeated pairs of the numbers themselves. Of pairs
    that are equally frequent the oldest goes first, which keeps the nonterminals of a repeated passage balanced.
    """

    def __init__(self, numbers: list[int], first: int):
        self.first, self.rules, self.sizes, self.starts = first, [], [], []
        n = len(numbers)
        found = Counter(zip(numbers, numbers[1:]))
        self.pairs = {pair: [] for pair, count in found.items() if count > 1}
        if not self.pairs:
            self.top = numbers
            return
        pairs = self.pairs
        for at, pair in enumerate(zip(numbers, numbers[1:])):
            if pair in pairs:
                pairs[pair].append(at)
        symbol = [*numbers, -1]  # -1: no symbol here (the end, or swallowed by the one before)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        places = dict(pairs)
        heap = [(-len(at), age, pair) for age, (pair, at) in enumerate(places.items())]
        heapify(heap)
        age = len(heap)
        while heap:
            count, born, pair = heappop(heap)
            at = self._still(places.pop(pair), pair, symbol, after)
            if len(at) < 2:
                continue
            if len(at) < -count:
                places[pair] = at
                heappush(heap, (-len(at), born, pair))
                continue
            new = first + len(self.rules)
            self._add(pair, at[0])
            for i in at:
                j = after[i]
                k = after[j]
                symbol[i], symbol[j] = new, -1
                after[i] = k
                if k <= n:
                    before[k] = i
            fresh: dict = {}
            for i in at:
                p, k = before[i], after[i]
                if p >= 0 and symbol[p] != new:
                    fresh.setdefault((symbol[p], new), []).append(p)
                if k < n:
                    fresh.setdefault((new, symbol[k]), []).append(i)
            for pair, where in fresh.items():
                if len(where) > 1:
                    places[pair] = where
                    heappush(heap, (-len(where), age, pair))
                    age += 1
        self.top, i = [], 0
        while i < n:
            self.top.append(symbol[i])
            i = after[i]

    @staticmethod
    def _still(at: list[int], pair, symbol: list[int], after: list[int]) -> list[int]:
        """The positions that still hold the pair, without overlaps."""
        a, b = pair
        if a != b:
            return [i for i in at if symbol[i] == a and symbol[after[i]] == b]
        kept, free = [], -1
        for i in at:
            if i >= free and symbol[i] == a and symbol[after[i]] == a:
                kept.append(i)
                free = after[i] + 1
        return kept

    def _add(self, pair: tuple[int, int], start: int) -> None:
        self.rules.append(pair)
        self.sizes.append(self.size(pair[0]) + self.size(pair[1]))
        self.starts.append(start)

    def size(self, symbol: int) -> int:
        return self.sizes[symbol - self.first] if symbol >= self.first else 1


def _same_on(w, i: int, j: int, end: int) -> int:
    """How many words from i and from j > i on are the same, before ``end``."""
    k, step = 0, 8
    while j + k + step <= end and w[i + k:i + k + step] == w[j + k:j + k + step]:
        k += step
        step *= 2
    while step:
        if j + k + step <= end and w[i + k:i + k + step] == w[j + k:j + k + step]:
            k += step
        step //= 2
    return k


def _same_back(w, i: int, j: int, begin: int) -> int:
    """How many words up to i and up to j > i are the same, not before ``begin``."""
    k, step = 0, 8
    while i - k - step + 1 >= begin and w[i - k - step + 1:i - k + 1] == w[j - k - step + 1:j - k + 1]:
        k += step
        step *= 2
    while step:
        if i - k - step + 1 >= begin and w[i - k - step + 1:i - k + 1] == w[j - k - step + 1:j - k + 1]:
            k += step
        step //= 2
    return k


class _Places:
    """Where the words beside a boundary occur again.

    The longer side of a run with period q repeats half of q words at least, so a period from 2 g to 4 g asks
    for the g words beside the boundary; a short period, or one in a text whose pairs are rare, for
    the boundary's pair. Grams of 8, 16, 32 words and so on are numbered when first asked for, each size from
    the repeated grams of half its size.
    """

    NEAR, FEW = 16, 32

    def __init__(self, w: list[int], pairs: dict):
        self.w, self.pairs, self.grams = w, pairs, []

    def _level(self, k: int) -> tuple[list[int], list[list[int]]]:
        """For grams of 8 * 2**k words: the number of the one at each position (-1: it is there only), and the
        positions of each number."""
        while len(self.grams) <= k:
            found: dict = {}
            if not self.grams:
                for i, gram in enumerate(zip(*(self.w[j:] for j in range(8)))):
                    found.setdefault(gram, []).append(i)
            else:
                half, (names, spots) = 4 << len(self.grams), self.grams[-1]
                for at in spots:
                    for i in at:
                        if i + half < len(names) and names[i + half] >= 0:
                            found.setdefault((names[i], names[i + half]), []).append(i)
            spots, names = [at for at in found.values() if len(at) > 1], [-1] * len(self.w)
            for number, at in enumerate(spots):
                for i in at:
                    names[i] = number
            self.grams.append((names, spots))
        return self.grams[k]

    def later(self, b: int, last: int) -> Iterator[int]:
        """Positions j in (b, last] that may start the words from b on again, nearest first."""
        at = self.pairs.get((self.w[b], self.w[b + 1]), ())
        low, high = bisect_right(at, b), bisect_right(at, last)
        if high - low <= self.FEW:
            yield from at[low:high]
            return
        yield from at[low:bisect_left(at, b + self.NEAR, low, high)]
        k, g = 0, 8
        while b + 2 * g <= last:
            names, spots = self._level(k)
            if names[b] < 0:
                return
            far = spots[names[b]]
            yield from far[bisect_left(far, b + 2 * g):bisect_right(far, min(last, b + 4 * g - 1))]
            k, g = k + 1, 2 * g

    def earlier(self, b: int, first: int) -> Iterator[int]:
        """Positions i in [first, b) before which the words before b may stand, nearest first."""
        at = self.pairs.get((self.w[b - 2], self.w[b - 1]), ())
        low, high = bisect_left(at, first - 2), bisect_left(at, b - 2)
        if high - low <= self.FEW:
            for i in reversed(at[low:high]):
                yield i + 2
            return
        for i in reversed(at[max(low, bisect_right(at, b - 2 - self.NEAR)):high]):
            yield i + 2
        k, g = 0, 8
        while b - 2 * g >= first:
            names, spots = self._level(k)
            if names[b - g] < 0:
                return
            far = spots[names[b - g]]
            for i in reversed(far[bisect_left(far, max(first, b - 4 * g + 1) - g):bisect_right(far, b - 3 * g)]):
                yield i + g
            k, g = k + 1, 2 * g


def _crossing(w, places: _Places, begin: int, b: int, end: int, least: int, out: dict) -> None:
    """Runs inside [begin, end) that hold the words before and at b: ``out[(start, stop)] = period``.

    Once a period p is known to hold up to a stop, a period of 2 p or more that repeats p words before that
    stop would be a multiple of p, so such candidates are passed over.
    """
    longest = (end - begin) // 3
    half = least // 2
    if end - b >= half:  # the longer side is to the right: its words occur again a period on
        p, known = 0, b
        for j in places.later(b, b + longest):
            q = j - b
            if p and q >= 2 * p and j + p <= known:
                continue
            need = max(half - q, (q + 1) // 2)
            if j + need > end or w[b - 1] != w[j - 1] or w[b + need - 1] != w[j + need - 1]:
                continue
            right = _same_on(w, b, j, end)
            if right >= need:
                if _note(out, b - _same_back(w, b - 1, j - 1, begin), j + right, q, least) and j + right > known:
                    p, known = q, j + right
    if b - begin >= half:
        p, known = 0, b
        for i in places.earlier(b, b - longest):
            q = b - i
            if p and q >= 2 * p and i - p >= known:
                continue
            need = max(half - q, (q + 1) // 2)
            if i - need < begin or w[i] != w[b] or w[i - need] != w[b - need]:
                continue
            left = _same_back(w, i - 1, b - 1, begin)
            if left >= need:
                if _note(out, i - left, b + _same_on(w, i, b, end), q, least) and i - left < known:
                    p, known = q, i - left


def _note(out: dict, start: int, stop: int, q: int, least: int) -> bool:
    if stop - start < max(least, 3 * q):
        return False
    out[start, stop] = min(q, out.get((start, stop), q))
    return True


def find_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the list, by start, then period."""
    if least < 24:
        raise ValueError("least must be 24 or more")
    number: dict = {}
    w = [number.setdefault(x, len(number)) for x in words]
    n, first = len(w), len(number)
    grammar = Grammar(w, first)
    if n < least or not grammar.pairs:
        return []
    places = _Places(w, grammar.pairs)
    w.append(-1)  # no word equals the end
    inside: dict[int, list] = {}
    for k, (left, _) in enumerate(grammar.rules):
        size = grammar.sizes[k]
        if size < least:
            continue
        begin, held = grammar.starts[k], {}
        _crossing(w, places, begin, begin + grammar.size(left), begin + size, least, held)
        if held:
            inside[k] = [(s - begin, e - begin, q) for (s, e), q in held.items()]
    found: dict = {}
    place = 0
    for x, y in zip(grammar.top, grammar.top[1:]):
        place += grammar.size(x)
        if x >= first or y >= first:  # a run holds repeated pairs, so a nonterminal
            _crossing(w, places, 0, place, n, least, found)
    intervals = {(q, s, -e) for (s, e), q in found.items()}
    if inside:
        intervals.update(_derived(grammar, inside, least))
    runs, last, stop = [], None, -1
    for q, s, e in sorted(intervals):
        if q != last:
            last, stop = q, -1
        if -e > stop:
            stop = -e
            runs.append((s, stop - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _derived(grammar: Grammar, inside: dict, least: int) -> Iterator[tuple[int, int, int]]:
    """The nonterminals' runs at all their positions in the derivation, as (period, start, -stop)."""
    first = grammar.first
    at: list[list[int]] = [[] for _ in grammar.rules]
    place = 0
    for x in grammar.top:
        if x >= first:
            at[x - first].append(place)
        place += grammar.size(x)
    for k in range(len(grammar.rules) - 1, -1, -1):
        if not at[k] or grammar.sizes[k] < least:
            continue
        left, right = grammar.rules[k]
        if left >= first:
            at[left - first].extend(at[k])
        if right >= first:
            size = grammar.size(left)
            at[right - first].extend([p + size for p in at[k]])
        for s, e, q in inside.get(k, ()):
            for p in at[k]:
                yield q, p + s, -(p + e)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repetitions: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    cuts = sorted((s + q, s + length) for s, length, q in runs)
    kept, at = [], 0
    for s, e in cuts:
        if s > at:
            kept += words[at:s]
        at = max(at, e)
    return b" ".join(kept + words[at:])


def _search(least: int, rewrite: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), ROWS_OUT):
                batch = whole.slice(begin, ROWS_OUT)
                sizes, runs, texts = [], [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    if rewrite:
                        words = planted(words, doc_id)
                    found = find_runs(words, least)
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(collapse(words, found))
                run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, run_type),
                    pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
    return run


def detect_runs(docs: DataFrame, *, least: int = LEAST, rewrite: bool = False) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period by start and period) and ``collapsed``, the text whose
    runs keep their first period only, its words joined by one space.

    Words are stretches without ASCII white space, numbered from 0. least: the fewest words of a run (24
    or more). rewrite: search the words with their ``planted`` tails instead.
    """
    return docs.select("doc_id", "text").mapInArrow(_search(least, rewrite), SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (ties: smallest start, then period); null if there is none."""
    def better(best, r):
        here, there = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best.isNull() | (here > there), r).otherwise(best)  # runs come by start and period
    return F.aggregate(runs, F.lit(None).cast(RUN), better)

"""Word-level BPE vocabularies of the ``tokenizers`` library, word by word.

For vocabularies whose pre-tokenizer never crosses white space (NFC, lower case, one
Split pattern, byte level, an end-of-word mark): a text's tokens are those of its
pieces between white space, so what a piece gives is worked out once and kept in a bounded cache.

``piece_ids`` takes token ids from the library's own model. ``PrefixBpe`` is the dynamic
program over a word's prefixes (see ``token_counts``).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import regex

# Unicode White_Space, and Latin characters that NFC leaves alone, that lower to
# one character and that Python's re classes as the vocabulary's pattern does.
RARE_WHITE_CODES = [0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NOT_PLAIN_TEXT = re.compile("[^\t\n\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]")
WHITE = re.compile("[\t\n " + "".join(map(chr, RARE_WHITE_CODES)) + "]")
PLAIN = re.compile("[\x21-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for
    the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


class Vocabulary:
    """One tokenizer file: the library's tokenizer, the pattern, the merges and their trees."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        mark = spec["model"]["end_of_word_suffix"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not mark:
            raise ValueError(f"{path}: not a lower-casing BPE vocabulary with word ends")
        self.mark = mark
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.ids = spec["model"]["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.symbols = {b: s for b, s in byte_symbols().items()}
        self._table = {b: s for b, s in self.symbols.items() if chr(b) != s}
        self.size = self.tokenizer.get_vocab_size()

    def byte_level(self, word: str) -> str:
        if word.isascii():
            return word.translate(self._table) if not word.isprintable() else word
        return word.encode().decode("latin-1").translate(self._table)

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of a lowered piece; together they are the piece."""
        if PLAIN.fullmatch(piece):
            return PLAIN_WORDS.findall(piece)
        return self.pattern.findall(piece)

    def lowered(self, piece: str) -> str:
        """Lower case of each character by itself."""
        return "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token, from the library's model."""
        if not word.isascii() or not word.isalpha():
            word = self.byte_level(word)
        return [t.id for t in self.model.tokenize(word)]

    def plain_words(self, piece: str) -> list[str] | None:
        """The lowered words of a plain piece; None if the library has to cut it."""
        if piece.isascii() and piece.isalpha():
            return [piece.lower()]
        if "<" in piece and self.special and self.special.search(piece) or not PLAIN.fullmatch(piece):
            return None
        return PLAIN_WORDS.findall(piece.lower())

    def piece_ids(self, piece: str) -> list[int]:
        """The library's token ids of a piece without white space."""
        words = self.plain_words(piece)
        if words is None:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return [i for w in words for i in self.word_ids(w)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


def pieces(text: str) -> list[str]:
    """The text between single white space characters (empty pieces included), lowered where
    that is sure to change nothing: each character lowers to one, and no special string can arise."""
    if NOT_PLAIN_TEXT.search(text):
        return WHITE.split(text)
    if "<" not in text:
        text = text.lower()
    return text.replace("\n", " ").replace("\t", " ").split(" ")


class PieceCache(dict):
    """piece -> value, filled on demand; emptied when it holds ``limit`` pieces."""

    def __init__(self, make, limit: int = 600_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: str):
        if len(self) >= self.limit:
            self.clear()
        value = self[piece] = self.make(piece)
        return value


class PrefixBpe:
    """Token counts of every prefix of a word, by dynamic programming.

    The tokens of a string end in a token t such that the tokens of the rest, followed
    by t, are stable: no merge crosses the seam. Given the last token of each shorter prefix
    there is one such t, so a prefix needs its candidates t and a seam test only.
    A prefix as a text of its own ends a word, so its last token carries the word-end mark, while
    what stands before that token is as inside a word.

    Seam test: a symbol on the right edge of the left token lives until its parent is
    merged; the same holds for the left edge of the right token. A pair of edge symbols merges across the seam
    if its rank comes before both parents (on equal ranks the pair further left goes
    first). Ranks of parts are smaller than the rank of the whole, which makes rank the clock.

    All tokens that a word spells somewhere come from one pass of an Aho-Corasick automaton, in order of their ends.
    """

    SEAMS = 600_000  # seams kept

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.rank = {pair: i for i, pair in enumerate(vocab.merges)}
        self.parts = {a + b: (a, b) for a, b in vocab.merges}
        self.born = {a + b: i for i, (a, b) in enumerate(vocab.merges)}
        self.after: dict[str, dict[str, int]] = {}
        for (a, b), i in self.rank.items():
            self.after.setdefault(a, {})[b] = i
        # what a token spells: its length, the token inside a word and the one at its end
        bodies: dict[str, tuple[int, str | None, str | None]] = {}
        for token in vocab.ids:
            if token not in vocab.specials:
                body = token.removesuffix(vocab.mark)
                _, inside, end = bodies.get(body, (0, None, None))
                bodies[body] = (len(body), inside, token) if token != body else (len(body), token, end)
        self.spelled = ahocorasick.Automaton()
        for body, found in bodies.items():
            if body:
                self.spelled.add_word(body, found)
        self.spelled.make_automaton()
        self.spelling = PieceCache(vocab.byte_level)  # of single characters
        self.kept = 0
        self.seams = PieceCache(lambda left: PieceCache(lambda right: self._seam(left, right)))
        self.right_edge = lru_cache(maxsize=50_000)(lambda t: self._edge(t, 1))
        self.left_edge = lru_cache(maxsize=50_000)(lambda t: self._edge(t, 0))
        self.whole = lru_cache(maxsize=100_000)(self._is_whole)
        self.counts = lru_cache(maxsize=400_000)(self._counts)

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """Symbols on an edge of the token's merge tree, each with its parent's rank."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = self.born[token], self.parts[token][side]

    def _crossing(self, left: str, right: str) -> list[int]:
        out = []
        for x, x_until in self.right_edge(left):
            for y, y_until in self.left_edge(right):
                q = self.rank.get((x, y))
                if q is not None and q < x_until and q <= y_until:
                    out.append(q)
        return out

    def _seam(self, left: str, right: str) -> bool:
        self.kept += 1
        if self.kept > self.SEAMS:
            self.seams.clear()
            self.kept = 0
        return self._stable(left, right)

    def _stable(self, left: str, right: str) -> bool:
        edge = self.left_edge(right)
        for x, x_until in self.right_edge(left):
            merges = self.after.get(x)
            if merges:
                for y, y_until in edge:
                    q = merges.get(y)
                    if q is not None and q < x_until and q <= y_until:
                        return False
        return True

    def _is_whole(self, token: str) -> bool:
        """Does the token's own string give the token?"""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self.whole(a) and self.whole(b) and self._crossing(a, b) == [self.born[token]]

    def _counts(self, word: str) -> tuple[int, ...]:
        """Tokens of word[:1], word[:2], ..., word: each prefix a word by itself."""
        ends, s = [], ""
        if word.isascii():
            s = self.v.byte_level(word)
            ends = range(1, len(s) + 1)
        else:
            for c in word:
                s += self.spelling[c]
                ends.append(len(s))
        n, seams = len(s), self.seams
        last: list[str | None] = [None] * (n + 1)
        inner, closed = [0] * (n + 1), [0] * (n + 1)
        for i, (size, inside, end) in self.spelled.iter(s):  # by end, so all prefixes before are known
            b, i = i + 1 - size, i + 1
            if b:
                stable, count = seams[last[b]], inner[b] + 1
                if inside is not None and last[i] is None and stable[inside]:
                    last[i], inner[i] = inside, count
                if end is not None and not closed[i] and stable[end]:
                    closed[i] = count
            else:
                if inside is not None and last[i] is None and self.whole(inside):
                    last[i], inner[i] = inside, 1
                if end is not None and not closed[i] and self.whole(end):
                    closed[i] = 1
        if n and not all(closed[1:]):
            raise ValueError(f"no tokens for {word!r}")
        return tuple(closed[1:]) if len(ends) == n else tuple([closed[e] for e in ends])

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts of every prefix of a piece without white space (NFC)."""
        if self.v.special and "<" in piece:
            found = self.v.special.search(piece)
            if found:
                # up to the special string's last character it is ordinary text, then one token
                before = self._plain_counts(piece[:found.end() - 1])
                base = (before[found.start() - 1] if found.start() else 0) + 1
                return [*before, base, *(base + c for c in self.piece_counts(piece[found.end():]))]
        return self._plain_counts(piece)

    def _plain_counts(self, piece: str) -> list[int]:
        low = self.v.lowered(piece)
        out: list[int] = []
        base = 0
        for w in self.v.words(low):
            if len(w) > 1 and w[0] == "'" and w[1].isalpha():
                # a contraction: cut short it is an apostrophe and a word
                quote = self.counts("'")[-1]
                steps = [quote, *(quote + c for c in self.counts(w[1:])[:-1]), self.counts(w)[-1]]
            else:
                steps = self.counts(w)
            out += [base + c for c in steps]
            base = out[-1]
        if len(low) != len(piece):  # a character that lowers to several counts when all of them are in
            return [out[at - 1] for at in accumulate(len(c.lower()) for c in piece)]
        return out


def nfc(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

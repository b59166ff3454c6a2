"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and texts. Runs that repeat in the stream become repeated groups, which
leaves few different streams per host; they are counted before anything is grouped by host.
``infer_wrappers`` aligns a host's streams one after the other: what the wrapper accepts
already changes nothing, otherwise the streams are aligned and the tags that only one side has become
optional groups, groups that repeat on one side only become repeated groups, and texts are slots.
A host's streams are folded in a tree, about ``FAN`` of them in one group and round, each round stored, until
one wrapper is left; so a hot host is not one task's work. Digits in class and id values are one symbol.

What the matched pages show then decides what the wrapper's elements are, over all pages of the host. An element
whose text is the same on two or more pages with different main texts is constant. A constant element is the
template's own (a notice, say) if it is no heading, no varying element beside it is of its kind, and it stands before the first
or after the last varying text; a constant part between varying ones, or a paragraph like the varying paragraphs, is the article's.
On hosts without article (or main) elements the main region is the element that the varying text leads to: from
the root down, the part that holds at least ``SHARE`` of it, as long as that part is one element a page and
has several elements of its own; a varying h1 outside of it is kept.

``extract`` matches each page with its host's wrapper. A text is main text or not by its place on the page's
own tag path: inside the article (or main) element, or the region, and outside of menus, headers, footers, asides, forms, scripts,
notices, adverts and comments, unless it is the template's. (The wrapper's optional alternatives are no path: one page never has them all.) A page that its wrapper does not match (cut off, say)
is its own wrapper. Main texts join to blocks at block tags, in page order.

Defined results: null or empty html gives an empty text. A page without an article, main element or region
gives the texts of its body outside the excluded places. An url without a host belongs to the host ``""``. Repeated rows
are extracted each. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import difflib
import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">]++)*+)>",
    re.S | re.I)
ATTR = regex.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", regex.I)
DIGITS = regex.compile(r"[0-9]+")

# HTML's element kinds, and names that pages give to what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
EXCLUDED = frozenset("nav footer aside form head button select option label input dialog menu object canvas audio video".split())
EXCLUDED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu form".split())
EXCLUDED_NAMES = regex.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notices|alert|newsletter|subscribe|"
    r"sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|comment-\w+|replies|"
    r"disqus|discussion|share|sharing|social|related|recommend\w*|popup|modal|overlay|login|signup|search|pagination|pager|skip)(?:$|[\s_-])", regex.I)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
TEXT = "#"
SHORT_GROUP = 48
FAN = 64
SHARE = 0.7
STEPS = 20_000
KNOWN_TAGS = 50_000


def tokens(page: str | None) -> list[tuple[str, str]]:
    """(symbol, text) pairs: a tag with its class, id and role, or ``#`` with its raw text. Comments and
    elements whose content is no markup are gone."""
    page = page or ""
    out: list[tuple[str, str]] = []
    at = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            if out and out[-1][0] == TEXT:  # a comment stood between
                out[-1] = (TEXT, out[-1][1] + piece)
            else:
                out.append((TEXT, piece))

    for m in TOKEN.finditer(page):
        start, end = m.span()
        if start > at:
            text(page[at:start])
        at = end
        tag = m[0]
        symbol = _tags.get(tag)
        if symbol is None:
            symbol = _symbol(m)
            if len(tag) <= 100:
                if len(_tags) >= KNOWN_TAGS:
                    _tags.clear()
                _tags[tag] = symbol
        if symbol[0]:
            out.append(symbol)
    text(page[at:])
    return out


_tags: dict[str, tuple[str, str]] = {}


def _symbol(m: re.Match) -> tuple[str, str]:
    name = (m["name"] or "").lower()
    if m["close"]:
        return "/" + name, ""
    attrs = m["attrs"] if name else ""
    marks = " ".join(f"{k.lower()}={DIGITS.sub('0', v.strip(chr(34) + chr(39)))}" for k, v in ATTR.findall(attrs)) if "=" in attrs else ""
    return f"{name} {marks}".strip(), ""


# -- places ------------------------------------------------------------------------------------

def _is_excluded(symbol: str, inside_article: bool) -> bool:
    name, _, marks = symbol.partition(" ")
    if name in EXCLUDED or name == "header" and not inside_article:
        return True
    for mark in regex.split(r"\s(?=(?:class|id|role)=)", marks):
        kind, _, value = mark.partition("=")
        if kind == "role" and value.lower() in EXCLUDED_ROLES or kind in ("class", "id") and name not in ("body", "html", "article", "main") and EXCLUDED_NAMES.search(value):
            return True
        if kind in ("class", "id") and regex.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", value, regex.I):
            return True
    return False


def _is_article(symbol: str) -> bool:
    return symbol.split(" ")[0] in ("article", "main") or "role=main" in symbol.lower()


@lru_cache(maxsize=50_000)
def _tag(symbol: str) -> tuple[str, bool, bool, bool, bool]:
    """name, excluded outside and inside an article, an article itself, a block."""
    name = symbol.split(" ")[0]
    return name, _is_excluded(symbol, False), _is_excluded(symbol, True), _is_article(symbol), name in BLOCK


@dataclass
class Outline:
    """A page's elements: for each symbol the element it stands in (its symbol's number, -1: none), for each
    opening tag where its element ends, and for each text whether its place is main text."""

    parents: list[int]
    ends: list[int]
    main: list[bool]
    has_article: bool


def outline(symbols: list[str]) -> Outline:
    root = ("", False, False, -1)
    open_: list[tuple[str, bool, bool, int]] = []  # name, excluded, inside an article, number
    n = len(symbols)
    parents, ends = [-1] * n, [n] * n
    texts: list[tuple[int, bool, bool]] = []

    def close_from(k: int, at: int) -> None:
        for x in open_[k:]:
            ends[x[3]] = at
        del open_[k:]

    for i, s in enumerate(symbols):
        top = open_[-1] if open_ else root
        if s == TEXT:
            parents[i] = top[3]
            texts.append((i, top[1], top[2]))
        elif s[0] == "/":
            name = s[1:]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close_from(k, i)
                    break
        else:
            name, outside, inside, is_article, is_block = _tag(s)
            if is_block and open_:  # an open paragraph ends where a block begins
                names = [o[0] for o in open_]
                if "p" in names:
                    k = names.index("p")
                    if not {"td", "th", "li"}.intersection(names[k:]):
                        close_from(k, i)
            if open_ and open_[-1][0] in CLOSED_BY.get(name, ()):
                close_from(len(open_) - 1, i)
            top = open_[-1] if open_ else root
            parents[i] = top[3]
            if name in VOID:
                ends[i] = i
            else:
                open_.append((name, top[1] or (inside if top[2] else outside), top[2] or is_article, i))
    found = any(article and not excluded for _, excluded, article in texts)
    main = [False] * n
    for i, excluded, article in texts:
        main[i] = not excluded and (article or not found)
    return Outline(parents, ends, main, found)


def places(symbols: list[str]) -> list[bool]:
    """For each symbol: is a text there main text, by the tags and names around it alone?"""
    return outline(symbols).main


# -- wrappers ----------------------------------------------------------------------------------
# An item is a symbol, ["+", items] or ["?", items]; a wrapper is a list of items.

def _grouped(items: list, size: int) -> list:
    """Runs of ``size`` items that repeat side by side as repeated groups."""
    out, i = [], 0
    while i < len(items):
        if i + 2 * size <= len(items) and items[i] == items[i + size] and items[i:i + size] == items[i + size:i + 2 * size]:
            j = i + size
            while items[j:j + size] == items[i:i + size]:
                j += size
            out.append(["+", items[i:i + size]])
            i = j
        else:
            out.append(items[i])
            i += 1
    return out


def collapse(symbols: list) -> list:
    """Runs that repeat side by side become repeated groups, short ones first. Above ``SHORT_GROUP`` items, the sizes
    tried are the distances from an item to its next occurrence."""
    items = list(symbols)
    for size in range(2, SHORT_GROUP + 1):
        if 2 * size > len(items):
            return items
        if sum(map(eq, items, items[size:])) >= size:
            items = _grouped(items, size)
    size = SHORT_GROUP
    while True:
        last: dict[str, int] = {}
        sizes: dict[int, int] = {}
        for i, x in enumerate(items):
            key = x if isinstance(x, str) else _key(x)
            gap = i - last.get(key, i)
            if gap > size and 2 * gap <= len(items):
                sizes[gap] = sizes.get(gap, 0) + 1
            last[key] = i
        size = next((g for g in sorted(sizes) if sum(map(eq, items, items[g:])) >= g), 0)
        if not size:
            return items
        items = _grouped(items, size)


def _key(item) -> str:
    return json.dumps(item)


def _unrolled(items: list) -> list[str]:
    """A stream the wrapper accepts: repeated groups twice, optional ones once."""
    out: list[str] = []
    for x in items:
        out += [x] if isinstance(x, str) else _unrolled(x[1]) * (2 if x[0] == "+" else 1)
    return out


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Matcher:
    """The wrapper as a position automaton, a state being the set of items that may have been read
    last; its steps are worked out when a page first needs them. Texts are optional. ``verdict``: what the host's
    pages show of the items (``judge_items``)."""

    def __init__(self, wrapper: list, verdict: dict | None = None):
        verdict = verdict or {}
        self.constant, self.region = frozenset(verdict.get("constant", ())), verdict.get("region")
        self.follow = [0]  # of the start, then of each item
        self.places_of: dict[str, int] = {}
        empty, first, last = self._build(wrapper)
        self.follow[0] = first
        self.accepting = last | empty
        self.steps: dict[tuple[int, str], int] = {}

    def _build(self, items: list) -> tuple[bool, int, int]:
        """Can the items be empty, and which can be first and last?"""
        empty, first, last = True, 0, 0
        for x in items:
            if isinstance(x, str):
                here = 1 << len(self.follow)
                self.follow.append(0)
                self.places_of[x] = self.places_of.get(x, 0) | here
                none, f, t = x == TEXT, here, here
            else:
                none, f, t = self._build(x[1])
                if x[0] == "+":
                    for p in _bits(t):
                        self.follow[p] |= f
                none = none or x[0] == "?"
            for p in _bits(last):
                self.follow[p] |= f
            if empty:
                first |= f
            last = t | last if none else t
            empty = empty and none
        return empty, first, last

    def path(self, symbols: list[str]) -> list[int] | None:
        """The item that each symbol of a page is, or None if the wrapper does not match."""
        states = [1]
        for s in symbols:
            key = states[-1], s
            to = self.steps.get(key)
            if to is None:
                to = 0
                here = self.places_of.get(s, 0)
                for p in _bits(key[0]) if here else ():
                    to |= self.follow[p]
                to &= here
                if len(self.steps) >= STEPS:
                    self.steps.clear()
                self.steps[key] = to
            if not to:
                return None
            states.append(to)
        ends = states[-1] & self.accepting
        if not ends:
            return None
        out = [next(_bits(ends))]
        for state in states[-2:0:-1]:
            out.append(next(p for p in _bits(state) if self.follow[p] >> out[-1] & 1))
        return out[::-1] if symbols else []

    def main_texts(self, symbols: list[str]) -> list[bool] | None:
        """For each symbol of a page: main text? None if the wrapper does not match."""
        path = self.path(symbols)
        if path is None:
            return None
        found = outline(symbols)
        if self.region is not None and not found.has_article and self.region in path:
            self._keep_region(symbols, path, found)
        if self.constant and not self.constant.isdisjoint(path):
            self._drop_template(symbols, path, found)
        return found.main

    def _keep_region(self, symbols: list[str], path: list[int], found: Outline) -> None:
        inside = [p == self.region for p in path]
        for i, parent in enumerate(found.parents):  # parents come first
            inside[i] = inside[i] or parent >= 0 and (inside[parent] or symbols[parent].split(" ")[0] == "h1" and path[parent] not in self.constant)
        if any(m and x for m, x in zip(found.main, inside)):
            found.main = [m and x for m, x in zip(found.main, inside)]

    def _drop_template(self, symbols: list[str], path: list[int], found: Outline) -> None:
        constant = [s != TEXT and p in self.constant for s, p in zip(symbols, path)]
        varying = []  # main texts outside of constant elements
        for i, parent in enumerate(found.parents):
            constant[i] = constant[i] or parent >= 0 and constant[parent]
            if found.main[i] and not constant[i]:
                varying.append(i)
        if not varying:
            return
        beside: dict[int, set[str]] = {}  # kinds of the varying elements by their parent
        for i, parent in enumerate(found.parents):
            if not constant[i] and symbols[i] != TEXT and symbols[i][0] != "/":
                beside.setdefault(parent, set()).add(symbols[i])
        for i, parent in enumerate(found.parents):
            whole = constant[i] and symbols[i] != TEXT and symbols[i][0] != "/" and (parent < 0 or not constant[parent])
            if (whole and symbols[i].split(" ")[0] not in HEADINGS and symbols[i] not in beside.get(parent, ())
                    and not varying[0] < i < varying[-1]):
                for j in range(i, found.ends[i]):
                    found.main[j] = False

    def accepts(self, symbols: list[str]) -> bool:
        return self.path(symbols) is not None


def align(wrapper: list, stream: list) -> list:
    """The wrapper widened to accept ``stream`` too, mismatches resolved to repeated or optional groups."""
    def numbered(items: list) -> list[tuple[object, int]]:
        """Items with the number of their optional group (0: must be there)."""
        out, groups = [], 0
        for x in items:
            if isinstance(x, list) and x[0] == "?":
                groups += 1
                out += [(y, groups) for y in x[1]]
            else:
                out.append((x, 0))
        return out

    def either(g: int, h: int) -> tuple | None:
        """An item of both is optional if it is on either side; its run ends where a group does."""
        return ("both", g, h) if g or h else None

    flat, theirs = numbered(wrapper), numbered(stream)
    matcher = difflib.SequenceMatcher(None, [_key(x) for x, _ in flat], [_key(x) for x, _ in theirs], autojunk=False)
    out: list[tuple[object, tuple | None]] = []  # item, name of its optional run
    for op, a1, a2, b1, b2 in matcher.get_opcodes():
        mine, other = [x for x, _ in flat[a1:a2]], [x for x, _ in theirs[b1:b2]]
        if op == "equal":
            out += [(x, either(g, h)) for (x, g), (_, h) in zip(flat[a1:a2], theirs[b1:b2])]
        elif len(mine) == 1 and isinstance(mine[0], list) and other and _unrolled(mine[0][1]) == _unrolled(other):
            out.append((mine[0], either(flat[a1][1], theirs[b1][1])))  # one turn of a repeated group
        elif len(other) == 1 and isinstance(other[0], list) and mine and _unrolled(other[0][1]) == _unrolled(mine):
            out.append((other[0], either(flat[a1][1], theirs[b1][1])))
        elif len(mine) == len(other) == 1 and isinstance(mine[0], list) and isinstance(other[0], list):
            out.append((["+", align(mine[0][1], other[0][1])], either(flat[a1][1], theirs[b1][1])))
        else:
            out += [(x, ("only mine", a1, g)) for x, g in flat[a1:a2]]
            out += [(x, ("only theirs", b1, h)) for x, h in theirs[b1:b2]]
    result: list = []
    last = None
    for x, run in out:
        if run is None:
            result.append(x)
        elif run == last:
            result[-1][1].append(x)
        else:
            result.append(["?", [x]])
        last = run
    return result


def fold(streams: list[list]) -> list:
    """The wrapper of several collapsed streams or wrappers, in the order given."""
    wrapper: list = []
    matcher = None
    for stream in streams:
        if matcher is None:
            wrapper, matcher = stream, Matcher(stream)
        elif not matcher.accepts(_unrolled(stream)):
            wrapper = align(wrapper, stream)
            matcher = Matcher(wrapper)
    return wrapper


def _stream_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct collapsed streams of a task by host, with the number of pages."""
    counts: dict[tuple[str, str], int] = {}

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.string()),
             pa.array(list(counts.values()), pa.int64())], ["host", "stream", "pages"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            key = host, json.dumps(collapse([s for s, _ in tokens(page.as_py())]))
            counts[key] = counts.get(key, 0) + 1
        if len(counts) > 5000:
            yield out()
            counts.clear()
    yield out()


def _fold_group(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values(["pages", "stream"], ascending=[False, True])
    wrapper = fold([json.loads(s) for s in rows["stream"]])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "stream": [json.dumps(wrapper)], "pages": [int(rows["pages"].sum())]})


def host_of(url):
    """The host of an url, lower case; "" if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), pages and verdict (JSON: its constant items and its region), one row per host."""
    kind = "host string, stream string, pages long"
    source = pages.select(host_of(F.col("url")).alias("host"), "html")
    seen = source.mapInArrow(_stream_batches, kind)
    now = stored(seen.groupBy("host", "stream").agg(F.sum("pages").alias("pages")), "streams")
    while True:
        sizes = now.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) < 2:
            break
        part = F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / FAN)).alias("part")
        parts = now.join(sizes, "host").select("host", "stream", "pages", part)
        folded = parts.groupBy("host", "part").applyInPandas(_fold_group, kind)
        now = stored(folded.groupBy("host", "stream").agg(F.sum("pages").alias("pages")), "streams")
    whole = now.select("host", F.col("stream").alias("wrapper"), "pages")
    seen = source.join(whole, "host").select("host", "html", "wrapper").mapInArrow(
        _item_batches, "host string, item long, parent long, symbol string, least long, most long, page long, occurrences long, chars long, pages long")
    items = seen.groupBy("host", "item", "parent", "symbol").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.countDistinct("page").alias("different"),
        F.sum("occurrences").alias("occurrences"), F.sum("chars").alias("chars"), F.sum("pages").alias("pages"))
    verdicts = items.groupBy("host").applyInPandas(_judge_host, "host string, verdict string")
    return whole.join(verdicts, "host", "left").select("host", "wrapper", "pages", "verdict")


def _text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "replace")) >> 1


def item_facts(stream: list[tuple[str, str]], path: list[int]) -> list[tuple[int, int, str, int, int]]:
    """(item, parent's item or -1, symbol, hash of its texts, characters) of every element of a matched page that
    holds main text. Characters count on pages without an article only: there they lead to the region."""
    symbols = [s for s, _ in stream]
    found = outline(symbols)
    hashes, chars = [0], [0]
    for (_, text), m in zip(stream, found.main):
        hashes.append(hashes[-1] + (_text_hash(text) if m else 0))
        chars.append(chars[-1] + (len(text) if m else 0))
    facts = []
    for i, (s, parent) in enumerate(zip(symbols, found.parents)):
        if s != TEXT and s[0] != "/" and chars[end := found.ends[i]] > chars[i]:
            facts.append((path[i], path[parent] if parent >= 0 else -1, s, (hashes[end] - hashes[i]) % (1 << 63),
                          0 if found.has_article else chars[end] - chars[i]))
    return facts


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's pages show of each host's items, added up; up to two different pages (hashes of their main
    texts) are named while an item's texts are the same."""
    seen: dict[tuple[str, int, int, str], list] = {}
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 6
    names = ["host", "item", "parent", "symbol", "least", "most", "page", "occurrences", "chars", "pages"]

    def out():
        rows = []
        for key, (least, most, keys, occurrences, chars, pages) in seen.items():
            named = sorted(keys) if least == most else [None]
            rows += [(*key, least, most, k, *((occurrences, chars, pages) if j == 0 else (0, 0, 0))) for j, k in enumerate(named)]
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    for batch in batches:
        for host, page, wrapper in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("wrapper").to_pylist()):
            stream = tokens(page.as_py())
            path = _matcher(wrapper).path([s for s, _ in stream])
            facts = item_facts(stream, path) if path is not None else []
            key = hash(tuple(sorted(f[3] for f in facts if f[1] == -1))) if len(facts) != 1 else facts[0][3]
            here = set()
            for item, parent, symbol, text, chars in facts:
                entry = seen.setdefault((host, item, parent, symbol), [text, text, set(), 0, 0, 0])
                entry[0], entry[1] = min(entry[0], text), max(entry[1], text)
                if len(entry[2]) < 2:
                    entry[2].add(key)
                entry[3] += 1
                entry[4] += chars
                if item not in here:
                    entry[5] += 1
                    here.add(item)
        if len(seen) > 50_000:
            yield out()
            seen.clear()
    yield out()


def judge_items(rows: list[tuple[int, int, str, int | None, bool, int, int, int]]) -> dict:
    """constant (items) and region (an item or None) of a host from (item, parent, symbol, hash of its text or None if
    that differs, on different pages, occurrences, chars, pages)."""
    texts: dict[int, set[int | None]] = {}
    for row in rows:
        texts.setdefault(row[0], set()).add(row[3])
    constant = sorted({r[0] for r in rows if r[4] and r[3] is not None and len(texts[r[0]]) == 1})
    under: dict[int, list] = {}
    for row in rows:
        if row[6] and row[0] not in constant:
            under.setdefault(row[1], []).append(row)
    region, at = None, -1
    steps = set()
    while under.get(at) and at not in steps:
        steps.add(at)
        best = max(under[at], key=lambda r: (r[6], -r[0]))
        several = sum(r[5] for r in under.get(best[0], ()))
        only = len(under.get(best[0], ())) == 1 and several <= best[5]
        if best[6] < SHARE * sum(r[6] for r in under[at]) or best[5] > best[7] or not (several > best[5] or only):
            break
        at = best[0]
        if several > best[5]:
            region = at
    return {"constant": constant, "region": region}


def _judge_host(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values(["item", "parent", "symbol"])
    verdict = judge_items([(int(r.item), int(r.parent), r.symbol, int(r.least) if r.least == r.most else None, r.different >= 2, int(r.occurrences), int(r.chars), int(r.pages))
                           for r in rows.itertuples()])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "verdict": [json.dumps(verdict)]})


# -- extraction --------------------------------------------------------------------------------

@lru_cache(maxsize=1000)
def _matcher(wrapper: str, verdict: str | None = None) -> Matcher:
    return Matcher(json.loads(wrapper), json.loads(verdict or "{}"))


@lru_cache(maxsize=50_000)
def _is_block(symbol: str) -> bool:
    return symbol.lstrip("/").split(" ")[0] in BLOCK


def page_text(page: str | None, matcher: Matcher | None = None) -> str:
    """The main text: blocks joined by a line feed, white space inside a block as one space."""
    stream = tokens(page)
    symbols = [s for s, _ in stream]
    main = matcher.main_texts(symbols) if matcher else None
    if main is None:
        main = places(symbols)
    blocks, now = [], []
    for (symbol, text), is_main in zip(stream, main):
        if symbol == TEXT:
            if is_main:
                now.append(html.unescape(text))
        elif _is_block(symbol):
            blocks.append("".join(now))
            now = []
        elif symbol == "br":
            now.append(" ")
    blocks.append("".join(now))
    joined = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [page_text(p.as_py(), _matcher(w, t) if w is not None else None)
                 for p, w, t in zip(batch.column("html"), batch.column("wrapper").to_pylist(), batch.column("verdict").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages``."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = own.join(wrappers.select("host", "wrapper", "verdict"), "host", "left").select("page_id", "url", "html", "wrapper", "verdict")
    return joined.mapInArrow(_extract_batches, "page_id long, url string, text string")

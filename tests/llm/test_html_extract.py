import json
import random

import pytest

from podium.llm.html_extract import Matcher, align, collapse, extract, fold, infer_wrappers, page_text, tokens

PAGE = "page_id long, url string, html string"


def page(body, head="", foot="<footer>f &copy;</footer>"):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body><nav><ul><li><a href='/x'>x</a></li><li><a href='/y'>y</a></li></ul></nav>{body}{foot}</body></html>"


def symbols(html):
    return [s for s, _ in tokens(html)]


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"),
    (page("<article><h1>A &amp; B</h1><p>one\n  two</p><p>three</p></article>"), "A & B\none two\nthree"),
    (page("<article><p><b>open one<br><p>next</article>"), "open one\nnext"),
    (page("<article><p>a<!-- c -->b</p><script>var t='</p>';</script><p>c &lt;d&gt; &eacute;</p></article>"), "ab\nc <d> é"),
    (page("<div class='ad'>buy</div><main><p>m</p><aside>s</aside><div class='comments'><p>nice!</p></div><form><p>f</p></form></main>"), "m"),
    (page("<article><p>text</p></article><article class='comment'><p>reply</p></article>"), "text"),
    (page("<div id='cookie-notice'>ok?</div><div><p>no article here</p></div>"), "no article here"),
    (page("<article><header><h1>kept</h1></header><p>p</p></article>"), "kept\np"),
    (page("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>"), "one\ntwo\nc1\nc2"),
    ("<html><body><article><p>cut off in the mid", "cut off in the mid"),
    (page("<article><p title=\"a>b\">attr</p></article>"), "attr"),
    (page("<article><p>&am &amp &quo</p></article>"), "&am & &quo"),
])
def test_texts(html, text):
    assert page_text(html) == text
    assert page_text(html, Matcher(collapse(symbols(html)))) == text


def test_repeats_collapse_and_streams_align():
    one, many = symbols("<article><p>a</p></article>"), symbols("<article><p>a</p><p>b</p><p>c</p></article>")
    assert collapse(many) == ["article", ["+", ["p", "#", "/p"]], "/article"]
    other = symbols("<article><h2>t</h2><p>a</p><p>b</p><hr></article>")
    wrapper = fold([collapse(x) for x in (many, one, other)])
    for stream in (one, many, other, symbols("<article><h2></h2><p>a</p></article>")):
        assert Matcher(wrapper).accepts(stream), (wrapper, stream)
    assert not Matcher(wrapper).accepts(symbols("<div>x</div>"))


def test_folded_wrappers_accept_their_streams():
    bodies = ["<p>a</p>", "<p>a</p><p>b</p>", "<h2>x</h2><p>a</p>", "<p>a</p><ul><li>1</li><li>2</li></ul>", "<div><p>q</p></div><p>a</p><p>b</p>"]
    streams = [symbols(page(f"<article>{b}</article>")) for b in bodies]
    left, right = fold([collapse(s) for s in streams[:3]]), fold([collapse(s) for s in streams[3:]])
    both = fold([left, right])
    assert sum(Matcher(both).accepts(s) for s in streams) >= 4
    assert json.loads(json.dumps(align(left, right))) == align(left, right)


def test_wrapper_with_many_optional_groups_is_matched_in_few_steps():
    wrapper = ["+", [["?", ["p", "#", "/p"]], ["?", ["p", "/p", "p"]], ["?", ["p", ["+", ["b", "/b"]], "/p"]]]]
    stream = ["p", "/p", "p", "#", "/p", "p", "b", "/b", "b", "/b", "/p"] * 300
    assert Matcher([wrapper, "hr"]).accepts(stream + ["hr"]) and not Matcher([wrapper, "hr"]).accepts(stream + ["br"])
    assert len(Matcher([wrapper, "hr"]).path(stream + ["hr"])) == len(stream) + 1
    assert Matcher([]).path([]) == [] and Matcher(["p"]).path([]) is None


@pytest.mark.parametrize("one,two", [("<nav class='a'>m</nav>", "<nav class='b'>m</nav>"), ("<div class='ad'>m</div>", "<div class='post'>m</div>")])
def test_templates_with_other_classes_keep_their_article(one, two):
    pages = [page(f"{x}<article><h1>t</h1><p>p</p></article>") for x in (one, two)]
    matcher = Matcher(fold([collapse(symbols(x)) for x in pages]))
    assert all(matcher.accepts(symbols(x)) for x in pages)
    assert [page_text(x, matcher) for x in pages] == ["t\np"] * 2


def test_table_with_nulls_copies_and_clashes(spark):
    rows = [(i, f"http://H.example.com:80/{i}", page(f"<article><h1>t{i}</h1>" + "".join(f"<p>p{i} {k}</p>" for k in range(1 + i % 4)) + "</article>")) for i in range(20)]
    rows += [(100, "http://h.example.com/n", None), (101, None, page("<article>x</article>")), (102, "no host", ""), (3, rows[3][1], rows[3][2]),
             (103, "http://h.example.com/cut", rows[1][2][:-30]), (None, "http://other.org", page("<article><p>" + "word " * 20000 + "</p></article>"))]
    pages = spark.createDataFrame([r + (0, 0) for r in rows], PAGE + ", host int, wrapper int")
    wrappers = infer_wrappers(pages)
    assert {r.host for r in wrappers.collect()} == {"h.example.com", "", "other.org"}
    got = [(r.page_id, r.url, r.text) for r in extract(pages, wrappers).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(got, key=key) == sorted([(i, u, page_text(h)) for i, u, h in rows], key=key)
    assert len(next(t for i, _, t in got if i is None)) == 5 * 20000 - 1
    none = spark.createDataFrame([], PAGE)
    assert extract(none, infer_wrappers(none)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 5])
def test_constant_texts_of_a_host_are_its_template(spark, n):
    notice, heading = "<div class='x7'>Read us daily</div>", "<h2>Ingredients</h2>"
    bodies = {
        "notice": lambda i: f"<h1>t{i}</h1><p>p{i}</p>{notice}", "heading": lambda i: f"<h1>t{i}</h1>{heading}<p>p{i}</p>",
        "between": lambda i: f"<p>p{i}</p><div class='x7'>then</div><ul><li>l{i}</li></ul>", "alike": lambda i: f"<p><b>Hello</b></p><p>p{i}</p>",
        "same": lambda i: "<h1>same</h1><p>all of it</p>", "title": lambda i: f"<h1>same</h1><p>p{i}</p>"}
    rows = [(i, f"http://{host}.org/{i}", page(f"<article id='post-{i}'>{body(i)}</article>")) for host, body in bodies.items() for i in range(n)]
    pages = spark.createDataFrame(rows, PAGE)
    got = {(r.url.split("/")[2][:-4], r.page_id): r.text for r in extract(pages, infer_wrappers(pages)).collect()}
    for i in range(n):
        assert got["notice", i] == f"t{i}\np{i}"
        assert got["heading", i] == f"t{i}\nIngredients\np{i}"
        assert got["between", i] == f"p{i}\nthen\nl{i}"
        assert got["alike", i] == f"Hello\np{i}"
        assert got["same", i] == "same\nall of it" and got["title", i] == f"same\np{i}"
    plain = {(r[1].split("/")[2][:-4], r[0]): page_text(r[2]) for r in rows}
    assert {k for k in got if got[k] != plain[k]} == {("notice", i) for i in range(n)}


@pytest.mark.parametrize("n", [2, 3, 6])
def test_main_region_is_found_without_article_and_listed_names(spark, n):
    def body(i):
        text = "".join(f"<p>{i} {k} " + "word " * 20 + "</p>" for k in range(2 + i % 3))
        return (f"<div class='k1'><div class='k2'><a href='/a'>Start</a> <a href='/{i}'>Seen {i}</a></div><h1>t{i}</h1>"
                f"<div class='k3'>{text}</div><div class='k4'><p>other {i}</p><p>more {i}</p></div></div>")
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", page(body(i))) for i in range(n)], PAGE)
    got = {r.page_id: r.text for r in extract(pages, infer_wrappers(pages)).collect()}
    assert got == {i: "\n".join([f"t{i}"] + [f"{i} {k}" + " word" * 20 for k in range(2 + i % 3)]) for i in range(n)}


def accepted(wrapper, stream):
    """Brute force: the places in ``stream`` where the wrapper can end when it begins at 0."""
    ends = {0}
    for x in wrapper:
        now = set()
        for at in ends:
            if isinstance(x, str):
                now |= ({at} if x == "#" else set()) | ({at + 1} if stream[at:at + 1] == [x] else set())
            else:
                new = {at + e for e in accepted(x[1], stream[at:])}
                now |= new | ({at} if x[0] == "?" else set())
                while x[0] == "+" and new:
                    new = {a + e for a in new for e in accepted(x[1], stream[a:])} - now
                    now |= new
        ends = now
    return ends


def test_wrappers_equal_brute_force_matching():
    draw = random.Random(7)
    for _ in range(150):
        streams = [[s for _ in range(draw.randint(1, 4)) for s in draw.choice((["p", "#", "/p"], ["hr"], ["ul", "li", "#", "/li", "/ul"], ["p", "b", "#", "/b", "/p"]))]
                   for _ in range(draw.randint(1, 4))]
        wrapper = fold([collapse(s) for s in streams])
        matcher = Matcher(wrapper)
        assert all(matcher.accepts(s) for s in streams)  # templates of a host without nested groups
        for s in streams + [s[:draw.randint(0, len(s))] for s in streams] + [draw.sample(s, len(s)) for s in streams]:
            assert matcher.accepts(s) == (len(s) in accepted(wrapper, s)), (wrapper, s)


def test_long_blocks_become_groups():
    block = ["div"] + [f"t{k}" for k in range(80)] + ["/div"]
    assert collapse(["x"] + block * 3 + ["y"]) == ["x", ["+", block], "y"]


def test_many_streams_of_a_host_fold_in_rounds(spark, monkeypatch):
    from podium.llm import html_extract

    fold_group = html_extract._fold_group

    def watched(group):
        assert len(group) <= 40
        return fold_group(group)

    monkeypatch.setattr(html_extract, "FAN", 8)
    monkeypatch.setattr(html_extract, "_fold_group", watched)
    bodies = ["".join(f"<{t}>w{i}</{t}>" for t, b in zip(("h2", "p", "ul", "ol", "pre", "h3", "h4", "h5", "h6"), f"{i:09b}") if b == "1") for i in range(1, 512)]
    pages = spark.createDataFrame([(i, "http://h.org", page(f"<article>{b}</article>")) for i, b in enumerate(bodies)], PAGE)
    (row,) = html_extract.infer_wrappers(pages).collect()
    assert row.pages == 511
    assert sum(Matcher(json.loads(row.wrapper)).accepts(symbols(r.html)) for r in pages.collect()) >= 460


def test_every_page_finds_its_document(spark):
    from podium.llm.common import read_table
    from podium.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    texts = {" ".join(r.text.split()) for r in read_table(spark, SF_SMALL, "documents").collect()}
    rows = QUERIES["op9_html_extraction"](spark, SF_SMALL).collect()
    found = sum(" ".join(r.text.split("\n", 1)[-1].split()) in texts for r in rows)
    assert rows and found >= 0.9 * len(rows) and all(r.n_chars == len(r.text) for r in rows)

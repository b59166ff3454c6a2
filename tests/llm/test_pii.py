"""Personal data: fixed forms against Python's regular expressions, discovery against its SQL and by hand."""

import random
import re

import duckdb
import pytest

from podium.llm.oracle import ORACLE
from podium.llm.pii import Bootstrap, personal_data, spans_and_candidates

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            value, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if (kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in value.split(".")))
                    or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)):
                out.append((kind, m.start(), m.end(), value))
    return out


def found(docs, which="spans", **settings):
    rows = personal_data(docs, Bootstrap(**settings)).collect()
    return sorted(((r.doc_id, [tuple(s) for s in r[which]]) for r in rows), key=str)


def test_fixed_forms_on_random_texts(docs_of):
    r, rows = random.Random(5), []
    for i in range(1500):
        rows.append((i, "".join(r.choice("aZ09@@..--++%_ 12345678 ()\n\té😀") for _ in range(r.randint(0, 120)))))
    rows += [(2000 + i, " ".join(r.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.0.0.1", "+1 (017) 555-7713",
                                          "+123", "a@b.c_d@e.f", "x@y", "x@y..z", "5500000000000004", "é"]) for _ in range(20))) for i in range(50)]
    assert found(docs_of(rows), "base") == sorted(((i, base(t)) for i, t in rows), key=str)


def test_documents(docs_of):
    """Nulls, empty and long texts, repeated rows, one id with two texts, names that clash."""
    many = "a@b.c " * 2000 + "1.2.3.4 " * 700
    rows = [(None, "mail a@b.cd"), (None, None), (1, ""), (2, many), (3, "a@b.cd"), (3, "a@b.cd"), (4, "1.2.3.4"), (4, "none"),
            (5, "a." * 20_000 + "@" + "b." * 20_000 + "c"), (6, "9" * 100_000), (7, "x" * 100_000), (8, "+" * 50_000 + "1")]
    got = found(docs_of(rows, extra=["spans", "base", "kind", "row"]), "base")
    by_id = {}
    for i, spans in got:
        by_id.setdefault(i, []).append(spans)
    assert sorted(map(len, by_id[None])) == [0, 1] and by_id[1] == [[]] and len(by_id[3]) == 2 and sorted(map(len, by_id[4])) == [0, 1]
    assert by_id[2] == [base(many)]
    assert [(s[1], s[2]) for s in by_id[5][0]] == [(0, 80_002)] and by_id[6] == by_id[7] == by_id[8] == [[]]


def test_empty_table(docs_of):
    assert personal_data(docs_of([])).collect() == []


def bootstrap_table():
    """Phones after "call me" and "reach me"; a house number form that only patterns find, in two steps: "ring us" has
    discovered ones only."""
    rows = [f"please call me +1 (555) 010-{1000 + i} today" for i in range(9)]
    rows += [f"please call me 555-20{10 + i} today" for i in range(2)]  # no form: found by "call me _"
    rows += [f"now ring us 555-20{10 + i} soon" for i in range(2)] + ["now ring us 555-2012 soon", "please call me 555-2012 today"]
    rows += ["now ring us 555-2099 soon"]  # found through the discovered ones of "ring us _"
    rows += [f"order of {7000 + i} parts" for i in range(30)]  # numbers that no seed shares a pattern with
    rows += [f"see of it {'a%d@x.org' % i if i % 2 else '10.0.0.%d' % i} there" for i in range(8)] + ["see of it 123456 there"]  # mixed company
    return list(enumerate(rows))


def test_discovery_in_rounds(docs_of):
    docs = docs_of(bootstrap_table())
    new = {}
    for rounds in (1, 3):
        rows = personal_data(docs, Bootstrap(rounds=rounds)).collect()
        new[rounds] = {(s.kind, s.value) for r in rows for s in r.spans} - {(s.kind, s.value) for r in rows for s in r.base}
        for r in rows:
            assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
            for s in r.spans:
                assert dict(bootstrap_table())[r.doc_id][s.start:s.end] == s.value
    assert new[1] == set() or new[1] < new[3]
    assert {("phone", f"555-201{i}") for i in range(3)} <= new[3]
    assert not any("123456" in v or v.startswith("70") for _, v in new[3])


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_equals_its_sql(docs_of, seed):
    r = random.Random(seed)
    ids = ["a%d@x.org", "10.0.0.%d", "+1 555 0100 0%03d", "id-9%03d", "(77%03d)", "user%d@host", "\"88%03d\"."]
    rows = [(i, " ".join(r.choice(["call", "me", "at", "the", "mail", r.choice(ids) % r.randrange(40)]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows += bootstrap_table() + [(None, None), (7, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted((i, s) for i, *_, s in con.execute(ORACLE["op13_pii"]).fetchall() if i is not None)
    got = sorted((i, ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)) for i, spans in found(docs_of(rows)) if i is not None)
    assert got == want
    assert sum(len(s) for _, s in found(docs_of(rows))) > sum(len(s) for _, s in found(docs_of(rows), "base"))


def test_candidates_leave_out_fixed_spans_and_marks(docs_of):
    row = spans_and_candidates(docs_of([(1, "see (a-1234), b@c 12 +1 555 0100 000 x")])).collect()[0]
    assert [(c.value, c.start, c.left1) for c in row.candidates] == [("a-1234", 5, "see"), ("b@c", 14, None)]

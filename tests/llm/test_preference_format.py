from podium.llm.preference_format import FIRST, preference_segments, rendered, turns, with_echo_answer

TURN = "conv_id long, turn long, role string, text string"


def table(spark, rows, extra=()):
    return spark.createDataFrame([r + (0,) * len(extra) for r in rows], TURN + "".join(f", {c} int" for c in extra))


def brute(chosen, rejected):
    """Segments of one pair: lists of (turn, role, text)."""
    a, b = dict((t, (r, x)) for t, r, x in chosen), dict((t, (r, x)) for t, r, x in rejected)
    order = sorted(a.keys() | b.keys())
    first = next((t for t in order if t not in a or t not in b or a[t] != b[t]), None)
    out = []
    for t in order:
        for part, side in (("prompt", a),) if first is None or t < first else (("chosen", a), ("rejected", b)):
            if t in side:
                role, text = side[t]
                head = f"<|{role or 'unknown'}|>\n"
                s = f"{head}{text or ''}<|end|>\n"
                on = part != "prompt" and role == "assistant"
                out.append((part, t, s, len(head) if on else 0, len(s) if on else 0))
    return sorted(out)


def test_pairs_match_brute_force(spark):
    u, a, s = "user", "assistant", "system"
    sides = {
        1: ([(0, u, "hi"), (1, a, "good")], [(0, u, "hi"), (1, a, "bad")]),
        2: ([(0, u, "hi"), (1, a, "x")], [(0, u, "hi"), (1, a, "x")]),
        3: ([(0, u, "a")], [(0, u, "b"), (1, a, "c"), (2, u, "d"), (3, a, None)]),
        4: ([(0, s, None), (1, u, "q"), (2, a, "same"), (5, a, "tail é")], [(0, s, None), (1, u, "q"), (2, a, "same")]),
        5: ([(0, None, "q"), (3, a, "z")], [(0, None, "q"), (2, a, "z")]),
        6: ([(0, u, "only chosen")], []),
    }
    left = table(spark, [(p, *t) for p, (c, _) in sides.items() for t in c])
    right = table(spark, [(p, *t) for p, (_, r) in sides.items() for t in r])
    got = preference_segments(turns(left), turns(right)).collect()
    for p, (c, r) in sides.items():
        mine = sorted((x.part, x.turn, x.segment, x.train_begin, x.train_end) for x in got if x.pair_id == p)
        assert mine == brute(c, r), p


def test_defined_results(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, "system", "s"),
            (None, 0, "user", None), (None, 1, "assistant", "x"), (2, 0, "user", "no answer")]
    conv = table(spark, rows, extra=("pair_id", "first", "said", "c"))
    got = sorted((x.pair_id or 0, x.turn, x.part, x.segment) for x in preference_segments(*with_echo_answer(conv)).collect())
    assert got == [
        (0, 0, "prompt", "<|user|>\n<|end|>\n"), (0, 1, "chosen", "<|assistant|>\nx<|end|>\n"), (0, 1, "rejected", "<|assistant|>\n<|end|>\n"),
        (1, FIRST, "prompt", "<|system|>\ns<|end|>\n"), (1, 0, "prompt", "<|user|>\nhi<|end|>\n"),
        (1, 1, "chosen", "<|assistant|>\na<|end|>\n"), (1, 1, "rejected", "<|assistant|>\nhi<|end|>\n"),
        (2, 0, "prompt", "<|user|>\nno answer<|end|>\n")]
    none = table(spark, [])
    assert preference_segments(*with_echo_answer(none)).count() == 0


def test_rendered_parts_and_their_trained_ranges(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}" * 3) for i in range(6)]
    other = [(1, 0, "user", "t0t0t0"), (1, 1, "assistant", "else"), (1, 2, "user", "more"), (1, 3, "assistant", "end")]
    parts = {r.part: r for r in rendered(preference_segments(turns(table(spark, rows)), turns(table(spark, other)))).collect()}
    assert parts["prompt"].text == "<|user|>\nt0t0t0<|end|>\n" and parts["prompt"].trained == []
    r = parts["rejected"]
    assert [r.text[s.begin:s.end] for s in r.trained] == ["else<|end|>\n", "end<|end|>\n"]
    assert len(parts["chosen"].trained) == 3


def test_a_hot_conversation_is_not_gathered(spark):
    conv = spark.range(3000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "CONCAT('t', id) AS text")
    segments = preference_segments(*with_echo_answer(conv))
    plan = segments._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
    assert segments.count() == 3001

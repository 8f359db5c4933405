import pytest

from quillsift.llm import chat_format as C

CONV = "conv_id bigint, turn bigint, role string, text string"
T = [{"role": r, "content": c} for r, c in (("system", "be brief"), ("user", "hi"), ("assistant", "one\ntwo"), ("user", "<|assistant|>"), ("assistant", ""))]


def spans_of(render, turns):
    """What the marked-up pieces should be, from the definition of each template."""
    return C.trace(render, turns)


def test_append_only_templates_tile_the_final_text():
    for render, turns in ((C.chatml, T), (C.prompted, T), (C.prompted, T[2:]), (C.instruct, T[1:])):
        final = render(turns)
        got = spans_of(render, turns)
        assert [g[0] for g in got] == ["append"] * len(turns) and all(g[4] for g in got)
        assert got[0][1] == 0 and all(a[2] == b[1] for a, b in zip(got, got[1:]))
        for g, t in zip(got, turns):
            assert t["content"] in final[g[1] : g[2]]


def test_a_start_mark_is_no_footer():
    got = spans_of(lambda turns: "<s>" + "".join(f"[{t['content']}]</s>" for t in turns), T)
    assert [g[0] for g in got] == ["append"] * len(T) and got[0][1] == 3


def test_rewriting_is_found():
    got = spans_of(C.first_lines, T)
    assert [g[0] for g in got] == ["append", "append", "append", "rewrite", "append"]
    at = got[3][3]
    assert C.first_lines(T[:3])[:at] == C.first_lines(T[:4])[:at] and C.first_lines(T[:3])[at] != C.first_lines(T[:4])[at]
    assert [g[4] for g in got] == [True, True, False, True, True]


def test_refused_prefixes():
    got = spans_of(C.instruct, T)
    assert got[0][:3] == ("error", None, None) and got[1][1] == 0
    assert all(g[0] == "error" for g in spans_of(lambda turns: 1 / 0, T)) and C.trace(C.chatml, []) == []


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "abd"), ("abc", "ab"), ("x" * 1000 + "y", "x" * 1000 + "z")])
def test_common_prefix(a, b):
    n = C.common_prefix(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x"), (None, 0, "user", "y"), (2, 0, "assistant", "long " * 50_000), (3, 5, "user", "")]
    c = spark.createDataFrame([(*r, "clash", "clash") for r in rows], CONV + ", turns string, alone string")
    got = C.spans(c, {"chatml": C.chatml}).collect()
    assert len(got) == 7
    assert [(r.turn, r.start) for r in sorted(got, key=lambda r: r.end) if r.conv_id == 1][0] == (None, 0)
    assert [r.start for r in got if r.conv_id is None] == [0, 0]
    assert C.spans(c.limit(0)).count() == 0

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marram.functions import source as S
from marram.operators import code_chunker


@given(st.text(alphabet="ab{};/*\"'\\\n ", max_size=200))
@settings(max_examples=300, deadline=None)
def test_mask_keeps_length_and_lines(text):
    masked = S.mask_comments(text)
    assert len(masked) == len(text)
    assert [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(masked) if c == "\n"]


def test_mask():
    text = 'a // b\n"// s" /* x\ny */ c'
    assert S.mask_comments(text) == 'a     \n"// s"     \n     c'


def test_brace():
    assert S.closing_brace('{ "}" { } }', 0) == 10
    for bad in ("x", "{ {}"):
        with pytest.raises(ValueError):
            S.closing_brace(bad, 0)


def test_methods():
    text = "class A {\n public function a();\n public function b() { return 1; }\n static function c(int x) -> string {\n }\n}"
    assert [(m[0], m[3], m[4]) for m in S.methods(text)] == [("a", 2, 3), ("c", 4, 5)]
    assert list(S.methods("function f() {")) == []


def test_ranges():
    assert S.hard_ranges(0, 3200, 1500) == [(0, 1500), (1500, 3000), (3000, 3200)]
    assert S.merge_small([(0, 200), (200, 600)], 300, 1500) == [(0, 600)]
    assert S.merge_small([(0, 1400), (1400, 1500)], 300, 1500) == [(0, 1500)]
    assert S.merge_small([(0, 1450), (1450, 1550), (1550, 2900)], 300, 1500) == [(0, 1450), (1450, 2900)]
    assert S._segments(0, 2000, [600, 1400, 1900], 1500) == [(0, 1400), (1400, 2000)]
    assert S._segments(0, 2000, [1600], 1500) == [(0, 2000)]


def test_structural_ranges_cover():
    rng = random.Random(5)
    for _ in range(40):
        text, depth = "{", 1
        while len(text) < rng.randint(100, 9000) or depth:
            c = rng.random()
            if c < 0.1 and depth < 6 and len(text) < 9000:
                text, depth = text + "if x {", depth + 1
            elif c < 0.2 and depth > 0:
                text, depth = text + "}", depth - 1
                if depth == 0:
                    break
            else:
                text += "w" * rng.randint(1, 400) + ";"
        r = S.merge_small(S.structural_ranges(text, 1500), 300, 1500)
        assert "".join(text[s:e] for s, e in r) == text
        assert all(0 < e - s <= 1500 for s, e in r)


def test_chunk_methods(spark):
    body = "function f() {\n" + "".join(f"    let x{i} = {i};\n" for i in range(300)) + "}"
    rows = [("p::f", "f", body, 10, 400, "p"), ("p::f", "f", "function f() { }", 1, 1, "p"), ("p::g", "g", None, 1, 1, "p")]
    df = spark.createDataFrame(rows, "id string, name string, content string, start_line int, end_line int, file string")
    got = code_chunker.chunk_methods(df).collect()
    long = sorted((r for r in got if r["start_line"] >= 10), key=lambda r: r["chunk_index"])
    assert "".join(r["content"] for r in long) == body
    assert [r["prev_chunk_id"] for r in long] == [None, *(r["id"] for r in long[:-1])]
    assert [r["next_chunk_id"] for r in long] == [*(r["id"] for r in long[1:]), None]
    assert [r["id"] for r in got if r["start_line"] == 1] == ["p::f::0"]
    parsed = code_chunker.parse_methods(spark.createDataFrame([("p", body), ("q", None)], "file string, content string")).collect()
    assert [(r["id"], r["start_line"], r["end_line"]) for r in parsed] == [("p::f", 1, 302)]

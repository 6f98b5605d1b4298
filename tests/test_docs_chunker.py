import random

from marram.operators.docs_chunker import chunk_documents, split_sections

FENCE = "`" * 3


def sections(spark, text):
    rows = split_sections(spark.createDataFrame([("d", text)], "doc string, content string")).collect()
    return [(r["id"], r["heading_path"], r["content"]) for r in rows]


def chunks(spark, text):
    return chunk_documents(spark.createDataFrame([("d", text)], "doc string, content string")).collect()


def test_headings(spark):
    got = sections(spark, "# A\ni\n## B\nx\n### C\ny\n## D\nz")
    assert [g[0] for g in got] == ["d::a", "d::a::b", "d::a::b::c", "d::a::d"]
    assert [g[1] for g in sections(spark, "# A\n### C\nx\n## B\ny")] == [["A"], ["A", "C"], ["A", "B"]]
    assert [g[0] for g in sections(spark, "## X\na\n## X\nb")] == ["d::x", "d::x-2"]
    assert [g[0] for g in sections(spark, "intro\n# A\nx")] == ["d::root", "d::a"]
    assert [g[1] for g in sections(spark, f"# A\n{FENCE}\n# no\n{FENCE}")] == [["A"], ["no"]]


def test_headings_against_a_stack(spark):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        lines = [("#" * rng.randint(1, 6) + f" t{rng.randint(0, 4)}") if rng.random() < 0.4 else rng.choice(["", "x", "#no", "y z"]) for _ in range(25)]
        docs.append((str(i), "\n".join(lines)))
    got = {}
    for r in split_sections(spark.createDataFrame(docs, "doc string, content string")).collect():
        got.setdefault(r["doc"], []).append((r["heading_path"], r["content"]))
    import re

    for name, text in docs:
        want, stack, cur = [], [], []
        for line in text.split("\n"):
            m = re.match(r"(#{1,6})\s+(.+)$", line)
            if m:
                if cur:
                    want.append(([t for _, t in stack], "\n".join(cur).strip()))
                while stack and stack[-1][0] >= len(m[1]):
                    stack.pop()
                stack.append((len(m[1]), m[2].strip()))
                cur = [line]
            else:
                cur.append(line)
        want.append(([t for _, t in stack], "\n".join(cur).strip()))
        # an empty first piece has no text and no row
        assert [w for w in want if w != ([], "")] == [g for g in got[name] if g != ([], "")], text


def test_many_headings_take_linear_time(spark):
    import time

    from marram.operators.docs_chunker import sections as split

    text = "".join(f"{'#' * (1 + i % 5)} t{i % 7}\nx\n" for i in range(10_000))
    began = time.perf_counter()
    got = split("d", text)
    assert len(got) == 10_000 and len({g[0] for g in got}) == 10_000 and time.perf_counter() - began < 2
    assert len(sections(spark, text)) == 10_000


def test_methods_and_events(spark):
    got = chunks(spark, '# C\npre\n<h4 id="a"><code>a()</code></h4>\nx\n<h4 id="b"><code>b()</code></h4>\ny')
    assert [(r["id"], r["method"]) for r in got] == [("d::c", None), ("d::c::a", "a()"), ("d::c::b", "b()")]
    table = "## List of Events\n\n| Component | Event | Parameters |\n|---|---|---|\n| [C1](u) | e1 | p |\n| C2 | e2 | p |\n| [C1](u) | e3 | p |\ntail"
    got = chunks(spark, table)
    assert [r["event_component"] for r in got] == ["C1", "C2"]
    assert got[0]["content"].split("\n")[2:] == ["| [C1](u) | e1 | p |", "| [C1](u) | e3 | p |"]


def test_oversized(spark):
    words = lambda n: " ".join(["w"] * n)
    got = chunks(spark, f"# A\n\n{words(300)}\n\n{words(150)}\n\n## B\n\n" + words(3))
    assert [r["id"] for r in got] == ["d::a", "d::a::b"]
    got = chunks(spark, f"# A\n\n{words(300)}\n\n{FENCE}php\n{words(20)}\n\n{words(20)}\n{FENCE}\n{words(190)}")
    assert [(r["id"], r["part"]) for r in got] == [("d::a::part-1", 1), ("d::a::part-2", 2)]
    assert got[0]["content"].count(FENCE) == 2
    rows = "\n".join(f"| {words(100)} | b |" for _ in range(12))
    got = chunks(spark, f"# T\n\n{words(300)}\n\n| a | b |\n|---|---|\n{rows}")
    assert [r["id"] for r in got] == ["d::t::part-1", *(f"d::t::part-2::table-{i}" for i in (1, 2, 3))]
    assert all(r["content"].startswith("| a | b |\n|---|---|\n") for r in got[1:])
    items = "\n".join(f"<ApiItem n>{words(30)}</ApiItem>" for _ in range(23))
    got = chunks(spark, f"# L\n<ApiList>\n{items}\n</ApiList>")
    assert got[0]["content"].startswith("# L\n<ApiList>\n\n<ApiItem ") and got[0]["content"].endswith("</ApiList>")
    assert [r["content"].count("<ApiItem ") for r in got if r["api_items_part"]] == [10, 10, 3]
    got = chunks(spark, "# M\n" + "\n".join(f"@method {words(90)}" for _ in range(12)))
    assert [r["content"].count("@method") for r in got if r["method_annotations_part"]] == [5, 5, 2]
    sig = lambda i: f"public function f{i}(int a)\n// {words(200)}"
    got = chunks(spark, f"# S\n\n{FENCE}php\n" + "\n".join(sig(i) for i in range(4)) + f"\n{FENCE}")
    assert len(got) >= 1


def test_empty_and_null(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "\n\n"), ("d", "# H\n")], "doc string, content string")
    assert chunk_documents(df).collect() == []

import pytest
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.functions.front_matter import parse
from marram.functions.packer import greedy


def value(spark, expr, text):
    return spark.createDataFrame([(text,)], "c string").select(expr(F.col("c")).alias("x")).first()["x"]


def test_slug(spark):
    for given, want in (("Hello, World!", "hello-world"), ("setShared()", "setshared"), ("a_b c", "a_b-c"), ("Ünï", "n")):
        assert value(spark, T.slug, given) == want


def test_white_space_of_any_script(spark):
    text = "\u00a0\u3000one\u2003two\x1cthree\u2028four \x85"
    assert value(spark, T.word_count, text) == len(text.split()) == 4
    assert value(spark, T.trim_all, text) == text.strip()
    for x in ("Hello, World!", "setShared()", " a_b c ", "Ünï", "", "--"):
        assert value(spark, T.slug, x) == T.slug_text(x)


def test_noise(spark):
    assert value(spark, lambda c: T.is_noise(c, ("a b",)), "\u00a0\n a b\t") and not value(spark, lambda c: T.is_noise(c, ("a b",)), "a b c")
    assert value(spark, lambda c: T.is_noise(c, ()), "a") is False and value(spark, lambda c: T.is_noise(c, ("a",)), None) is False


def test_front_matter(spark):
    closed = "---\ntitle: A\nn: \"x\"\n---\n# H\n"
    assert value(spark, lambda c: T.front_matter_map(T.front_matter(c)), closed) == {"title": "A", "n": "x"}
    assert value(spark, T.body, closed) == "# H\n"
    for plain in ("# H", "---\ntitle: A\n# H"):
        assert value(spark, T.body, plain) == plain
        assert value(spark, T.front_matter, plain) is None


def test_nested_front_matter():
    pytest.importorskip("yaml")
    block = "\ntitle: 'A: b'\nversion: 5.20\ntags:\n  - x\n  - y\nside:\n  order: 1\nempty:\n"
    assert parse(block) == {"title": "A: b", "version": "5.20", "tags": '["x", "y"]', "side": '{"order": "1"}', "empty": ""}
    assert parse(None) == {} and parse("\n- a\n") == {} and parse("\na: [\nb: c\n") == {"a": "[", "b": "c"}


def test_long_trees_are_removed(spark):
    tree = lambda n: "<ApiTree>" + "\n".join("x" * 3 for _ in range(n)) + "</ApiTree>"
    assert value(spark, T.clean, tree(20)) == tree(20)
    assert value(spark, T.clean, "a" + tree(21) + "b") == "ab"
    assert value(spark, T.clean, "a\n\n\n\nb<ApiUses>\nz\n</ApiUses>") == "a\n\nb"
    assert value(spark, T.clean, "a\n[x]: http://y z\nb") == "a\n\nb"


def test_keep_chunk(spark):
    rows = [("Method Summary", "text"), ("A", "# only"), ("T", "## T\n![i](u)"), ("T", "## T\nx"), (None, "x"), (None, ""), (None, None)]
    got = [r["k"] for r in spark.createDataFrame(rows, "s string, c string").select(T.keep_chunk(F.col("s"), F.col("c")).alias("k")).collect()]
    assert got == [False, False, False, True, True, False, False]


def test_link_text(spark):
    assert value(spark, T.link_text, "[a b](c) d") == "a b"
    assert value(spark, T.link_text, "plain") == "plain"


def test_packer(spark):
    w = lambda n: " ".join(["w"] * n)
    cases = {(300, 200, 1): [[300, 200], [1]], (300, 201): [[300], [201]], (501,): [[501]], (100, 600, 100): [[100], [600], [100]], (): []}
    for sizes, want in cases.items():
        df = spark.createDataFrame([([w(n) for n in sizes],)], "i array<string>")
        got = df.select(greedy(F.col("i"), 500).alias("g")).first()["g"]
        assert [[len(x.split()) for x in g] for g in got] == want
    df = spark.createDataFrame([(["a b"] * 23,)], "i array<string>")
    assert [len(g) for g in df.select(greedy(F.col("i"), 500, 3, 10).alias("g")).first()["g"]] == [10, 10, 3]

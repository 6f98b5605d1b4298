from collections import Counter

import pytest

from marram.llm import budget as B
from marram.llm.tokenizers import FOLDER, Tokenizer, Words

pytest.importorskip("tiktoken")
SCHEMA = "doc string, content string, source string, language string, domain string, n_tokens long"


def sums(cube):
    return {tuple(r[c] for c in B.LABELS): (r["n_docs"], r["n_tokens"]) for r in cube.collect() if r["n_docs"] or r["n_tokens"]}


def want(rows, count):
    docs, tokens = Counter(), Counter()
    for _, text, *labels, _ in rows:
        docs[tuple(labels)] += 1
        tokens[tuple(labels)] += count(text) if text else 0
    return {k: (docs[k], tokens[k]) for k in docs}


def test_deltas_equal_a_fresh_count(spark):
    count = Tokenizer().counter()
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    a = [("1", "red fox", "s", "en", "d", 9), ("2", "red fox", "s", "en", "d", 9), ("2", "red fox", "s", "en", "d", 9), ("3", None, "s", "en", "x", 9), ("4", "", "t", "de", "d", 9), ("5", "long " * 5000, "t", "de", "d", 9)]
    one = B.TokenBudget(Tokenizer()).update(frame(a))
    assert sums(one.cube) == want(a, count)
    # one removed, one changed, one moved to another label, one new
    b = [("1", "red fox jumps", "s", "en", "d", 9), ("2", "red fox", "s", "fr", "d", 9), ("3", None, "s", "en", "x", 9), ("5", "long " * 5000, "t", "de", "d", 9), ("6", "red fox", "u", "en", "d", 9)]
    two = one.update(frame(b))
    assert sums(two.cube) == want(b, count)
    # only what was never seen is encoded
    assert two.counts.count() - one.counts.count() == 1
    three = two.update(frame([]))
    assert sums(three.cube) == {}
    assert sums(B.TokenBudget(Tokenizer()).update(frame([])).cube) == {}
    everything = {tuple(r[c] for c in B.LABELS): r["n_tokens"] for r in B.totals(two.cube).collect()}
    assert everything[("all", "all", "all")] == sum(n for _, n in want(b, count).values())


def test_change_sets_and_saved_states(spark, tmp_path):
    count = Tokenizer().counter()
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    a = [("1", "red fox", "s", "en", "d", 9), ("2", "blue sky", "s", "en", "d", 9), ("2", "blue sky", "s", "en", "d", 9), ("3", None, "s", "en", "x", 9)]
    path = str(tmp_path / "budget")
    B.TokenBudget(Tokenizer()).update(frame(a)).save(path)
    again = B.TokenBudget.load(spark, path, Tokenizer())
    same = again.update(frame(a))
    # a later process encodes nothing that is known
    assert same.fresh.count() == 0 and sums(same.cube) == want(a, count)
    changed = [("2", "red fox jumps", "t", "en", "d", 9), ("7", "blue sky", "s", "de", "d", 9)]
    next_ = again.change(frame(changed), spark.createDataFrame([("1",), ("99",)], "doc string"))
    left = [a[3], *changed]
    assert next_.fresh.count() == 1 and sums(next_.cube) == want(left, count)
    assert sorted(r["doc"] for r in next_.members.collect()) == ["2", "3", "7"]
    assert next_.save(path).endswith("state-000002")
    assert sums(B.TokenBudget.load(spark, path, Tokenizer()).update(frame(left)).cube) == want(left, count)
    other = B.TokenBudget.load(spark, path, Words())
    assert other.cube is None and sums(other.update(frame(left)).cube) == want(left, lambda t: len(t.split()))
    assert B.TokenBudget.load(spark, path + "-none", Tokenizer()).cube is None


def test_labels(spark):
    rows = [(1, "a", "x::y", " Docs ", (None, None, "EN-us")), (2, "b", "guides/a.mdx::z", None, ("guides/a.mdx", None, None)), (3, "c", None, "", (None, "Queue/x.zep", "und"))]
    c = spark.createDataFrame(rows, "chunk_no long, content string, id string, source string, metadata struct<file_path:string,file:string,language:string>")
    d = spark.createDataFrame([("guides", "learning"), ("Queue", "messaging"), ("guides", "learning")], "top_dir string, domain string")
    got = {r["doc"]: (r["source"], r["language"], r["domain"]) for r in B.label_chunks(c, d).collect()}
    assert got == {"1": ("docs", "en", "other"), "2": ("unknown", "unknown", "learning"), "3": ("unknown", "unknown", "messaging")}


def test_tokenizers_agree_with_their_libraries():
    import tiktoken  # noqa: F401
    from tokenizers import Tokenizer as T

    texts = ["Hello world, it's   fine.\n\n  x", "Привет, мир! 你好", "a" * 3000, "let x = \"y\";\r\n"]
    t = T.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    a, b = Tokenizer().counter(), Tokenizer(f"{FOLDER}/byte_bpe_50k.json").counter()
    assert [a(x) for x in texts] == [b(x) for x in texts] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert Tokenizer(f"{FOLDER}/piece_bpe_32k.model").counter()("hello world") > 0
    assert Tokenizer().key != Tokenizer(f"{FOLDER}/byte_bpe_50k.json").key

import numpy as np

from marram.llm import endings as E
from marram.llm import truncation as X

SENTENCES = ["The reader opens the window and returns an empty list.", "The writer closes the stream when the cache is off.", "It keeps the previous value in the log."]


def verdicts(spark, corpus, texts):
    """Lenient, strict and at-limit verdicts of ``texts`` by the counts of ``corpus``."""
    tokens = E.Tokens()
    rows = [(i, i, *E.shape(t, tokens)) for i, t in enumerate(texts)]
    shaped = spark.createDataFrame(rows, f"key long, text_hash long, {E.SHAPE_DDL}")
    df = spark.createDataFrame([(t,) for t in corpus], "text string").repartition(3)
    return {texts[r["key"]]: (r["lenient"], r["strict"], r["at_limit"]) for r in E.resolve(shaped, df, "text", len(texts)).collect()}


def test_kinds(spark):
    corpus = [" ".join(SENTENCES)] * 20 + ["a: works now\nb: ok great\nc: see you"] * 20 + [None, "", " "]

    complete = ("", "  ", SENTENCES[0], "# Window", "x.\n\n- empty list\n- open window", "x.\n\nTags: a, b", "x\n| a | b |\n|--|--|\n| 1 | 2 |", "x.\n```php\ny\n```", "x.\n-- \nuser12", "a: works now", "`Foo::bar()`", "See [a](b.md)")
    broken = {
        "The reader opens the window and returns an empty li": "word",
        "The reader opens the window and returns an": "sentence",
        SENTENCES[0] + " The writer closes the": "sentence",
        "The option `cache.tt": "word",
        "x\n```php\nfoo(": "code",
        "| a | b |\n|--|--|\n| 1 | 2": "table",
        "namespace A;\nclass B\n{\n    function c() {": "code",
        "cut inside a letter �": "word",
        "The reader is slow, ": "sentence",
    }
    complete += ("namespace A;\nclass B\n{\n    function c() { return \"{\"; }\n}\n// end of file",)
    got = verdicts(spark, corpus, [*complete, *broken])
    for text in complete:
        assert got[text][0] is None, text
    for text, kind in broken.items():
        assert got[text][0] == kind, text


def test_counts_are_exact(spark):
    """What follows a word is counted over all rows, whatever the partitions."""
    texts = SENTENCES * 50 + ["The reader opens the log", None]
    tokens = E.Tokens()
    word = lambda t: int(E._contexts(tokens(t)[0])[1][-1].view(np.int64))
    keys = spark.createDataFrame([(word(w),) for w in ("list", "log", "reader", "zebra")], "key long")
    df = spark.createDataFrame([(s,) for s in texts], "text string")
    for n in (1, 7):
        got = {r["key"]: (r["ends"], r["goes"]) for r in E.follow_counts(df.repartition(n), "text", keys).collect()}
        assert got == {word("list"): (50, 0), word("log"): (50, 0), word("reader"): (0, 51)}


def generated(rng, n):
    nouns, verbs = [f"{a}{b}" for a in ("read", "writ", "cach", "pars") for b in ("er", "ing", "es", "or", "able")], ["opens", "closes", "returns", "keeps", "skips"]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} and {rng.choice(verbs)} one {rng.choice(nouns)}."
    out = []
    for _ in range(n):
        t = " ".join(sentence() for _ in range(rng.randint(3, 9)))
        x = rng.random()
        if x < 0.2:
            t = t[: rng.randint(len(t) // 2, len(t) - 3)]
        elif x < 0.35:
            t += "\n\n" + rng.choice(["Any thoughts", "See you", "Over and out"])
        out.append(t)
    return out


def test_verdicts_do_not_depend_on_the_size(spark):
    """The same rows in a table ten times larger give the same verdicts."""
    import random

    few = generated(random.Random(11), 400)
    many = few + generated(random.Random(12), 3600)
    frame = lambda ts: spark.createDataFrame([(i, t, "s") for i, t in enumerate(ts)], "doc_id long, text string, source string")
    small = {r["doc_id"] for r in X.truncated(frame(few)).collect()}
    large = {r["doc_id"] for r in X.truncated(frame(many)).collect() if r["doc_id"] < 400}
    assert len(small) > 50 and small == large
    copies = {r["doc_id"] % 400 for r in X.truncated(frame(few * 10)).collect()}
    assert copies == small


def test_long_last_line(spark):
    """The last line is judged whole, however long it is."""
    filler = "The reader opens the window and returns an empty list. " * 300
    got = verdicts(spark, SENTENCES * 20, ["`" + filler + "`", "(" + filler + "and", "| a " * 3000, "- " + filler])
    assert [v[0] for v in got.values()] == [None, "sentence", "table", None]


def test_spikes_and_cases(spark):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(8)) + "."
    rows = []
    for i in range(300):
        t = " ".join(sentence() for _ in range(rng.randint(3, 30)))
        cut = i % 3 == 0 and len(t) > 400
        rows.append((i, t[:400] if cut else t, "s", "clash"))
    rows += [(1000, None, "s", "x"), (1001, "", None, "x"), (1002, "a b.", None, None), (None, "x.", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kind string")
    got = {r["doc_id"]: r for r in X.truncated(df).collect()}
    want = {r[0] for r in rows if r[1] and len(r[1]) == 400 and not r[1].rstrip().endswith(".")}
    assert want and want == set(got)
    assert all(r["at_spike"] for r in got.values())
    share = {r["source"]: r for r in X.truncation_by_source(df, X.truncated(df)).collect()}
    assert share["s"]["n_truncated"] == len(want) and share[None]["share"] == 0
    assert X.truncated(df.limit(0)).collect() == []


def test_copies_are_no_spike(spark):
    rows = [("s", 100, 100, 1)] * 50 + [("s", n, n, n) for n in range(200, 400)]
    assert X.spikes(spark.createDataFrame(rows, "source string, n_chars long, n_bytes long, text_hash long")).collect() == []


def test_copies_make_no_usual_ending(spark):
    whole = [f"{SENTENCES[i % 3]} {SENTENCES[i // 3 % 3]} Part {i}." for i in range(40)]
    word, sentence = SENTENCES[0] + " The reader opens the window and returns an empty li", SENTENCES[1] + " The writer keeps the cache in stream"
    rows = [(i, t, "s") for i, t in enumerate(whole + [word] * 20 + [sentence] * 20)]
    got = {r["doc_id"]: r["kind"] for r in X.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: "word" if t == word else "sentence" for i, t, _ in rows if t in (word, sentence)}

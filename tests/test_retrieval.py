import math
import sys

from marram.engine import Engine
from marram.functions import text as T
from marram.operators import dense, evaluate, fusion, generate, lexical
from marram.plans import retrieval as R
from pyspark import cloudpickle
from pyspark.sql import functions as F

# models of these tests travel to the workers, which cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc string, rank long")


def scores(df):
    return {r["doc"]: round(r["score"], 6) for r in df.collect()}


def test_fusion(spark):
    a = ranking(spark, [("q", "x", 1)])
    assert scores(fusion.fuse([(a, 1.0), (a, 1.0)], 60)) == {"x": round(2 / 61, 6)}
    d = ranking(spark, [("q", "a", 1), ("q", "b", 2)])
    l = ranking(spark, [("q", "b", 1), ("q", "a", 2), ("q", "c", 3)])
    got = fusion.fuse([(d, 4.0), (l, 1.0)], 60).orderBy("rank")
    assert [r["doc"] for r in got.collect()] == ["a", "b", "c"]
    assert scores(got) == {"a": 0.081703, "b": 0.080910, "c": 0.015873}
    assert fusion.fuse([(a.limit(0), 1.0)], 60).collect() == []
    docs, code = ranking(spark, [("q", "d1", 1), ("q", "d2", 2)]), ranking(spark, [("q", "c1", 1), ("q", "c2", 2)])
    assert [r["doc"] for r in fusion.multi_source([docs, code]).orderBy("rank").collect()] == ["d1", "c1", "d2", "c2"]


def test_quota(spark):
    rows = [("q", f"d{i}", "docs", 1.0 - i / 10, i) for i in range(4)] + [("q", f"c{i}", "code", 9.0 - i, i) for i in range(8)] + [("q", "z", "other", 99.0, 0)]
    df = spark.createDataFrame(rows, "query_id string, doc string, source string, score double, tie int")
    got = fusion.select_by_source(df, {"docs": 2, "code": 5}).orderBy("position").collect()
    assert [r["doc"] for r in got] == ["d0", "d1", "c0", "c1", "c2", "c3", "c4"]


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "the"), (4, None)], "doc long, text string").where("text is not null")
    q = spark.createDataFrame([("a", "Red red fox"), ("b", "green"), ("c", None)], "query_id string, query string")
    got = {r["doc"]: r["score"] for r in lexical.search(q, corpus, 10).collect()}
    n, avg = 3, 5 / 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    tf = lambda f, dl: f / (f + 1.5 * (0.25 + 0.75 * dl / avg))
    assert abs(got[1] - (2 * idf(1) * tf(2, 3) + idf(2) * tf(1, 3))) < 1e-8
    assert abs(got[2] - idf(2) * tf(1, 2)) < 1e-8 and set(got) == {1, 2}


def test_best_against_sorting():
    import random

    import numpy as np

    from marram.operators.ranking import Best

    rng = random.Random(4)
    for names in (range(300), [f"d{i}" for i in range(300)]):
        for k in (1, 3, 40, 400):
            for positive in (True, False):
                scores = np.array([[rng.choice([0.0, 1.0, 2.0, -1.0]) for _ in names] for _ in range(6)])
                order = rng.sample(range(300), 300)
                best = Best(6, k, positive)
                for at in range(0, 300, 70):
                    part = order[at : at + 70]
                    best.add(scores[:, part], [names[j] for j in part])
                got = {}
                for i, d, s in zip(*best.rows()):
                    got.setdefault(int(i), []).append((-s, d))
                for q in range(6):
                    want = sorted((-scores[q, j], names[j]) for j in range(300) if not positive or scores[q, j] > 0)[:k]
                    assert sorted(got.get(q, [])) == want


def test_dense_blocks_and_ties(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)] + [(99, None)], "doc long, embedding array<double>")
    q = v.where("doc < 5").withColumnRenamed("doc", "query_id")
    whole = dense.search(q, v, 4).orderBy("query_id", "rank").collect()
    assert whole == dense.search(q, v.repartition(7), 4, block=2).orderBy("query_id", "rank").collect()
    assert [r["doc"] for r in whole if r["query_id"] == 1] == [2, 5, 8, 11]
    assert dense.search(q.limit(0), v, 4).collect() == []


def test_metrics(spark):
    r = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 12)], "query_id string, first_rank int")
    m = evaluate.hit_metrics(r).first()
    assert (m["recall_at_5"], m["recall_at_10"], m["mrr"]) == (0.5, 0.5, 0.354167)
    a = spark.createDataFrame([("1", 1), ("2", None), ("3", 2), ("4", None)], "query_id string, first_rank int")
    b = spark.createDataFrame([("1", 2), ("2", 5), ("3", 2), ("4", None)], "query_id string, first_rank int")
    c = evaluate.compare(a, b).first()
    assert (c["a_better"], c["b_better"], c["equal"]) == (1, 1, 2)


def test_prefix_recall(spark):
    e = spark.createDataFrame([(q, "d.mdx") for q in "abc"], "query_id string, expected string")
    r = spark.createDataFrame([("a", "d.mdx::x"), ("b", "d.mdx2::x"), ("c", "d.mdx")], "query_id string, id string")
    assert {x["query_id"]: x["hit"] for x in evaluate.prefix_recall(e, r).collect()} == {"a": 1, "b": 0, "c": 1}


def test_validation_and_prompt(spark):
    rows = [("x" * 2000, None), ("x" * 2001, None), (" ", None), ("q", None), ("q", " "), (None, None)]
    got = generate.validate(spark.createDataFrame(rows, "question string, context string")).select("reject").collect()
    assert [r[0] for r in got] == [None, "question", "question", None, "context", "question"]
    df = spark.createDataFrame([("q", "code();", None), ("q", None, None)], "question string, context string, x string")
    p = [r[0] for r in df.select(generate.prompt(F.col("question"), F.lit("[1]\nz\n\n"), F.col("context"))).collect()]
    assert "code();" in p[0] and "Code of the user" not in p[1] and p[1].endswith("[1]\nz\n\n")


def test_engine(spark):
    rows = [
        (1, "a::x", "Open a window with openWindow. More text.", "docs", "a", "X", None, None, None),
        (2, "b::y", "function openWindow() { return window; }", "code", "b", None, "openWindow", 1, 2),
        (3, "c::z", "Nothing here.", "docs", "c", "Z", None, None, None),
    ]
    corpus = spark.createDataFrame(rows, "doc long, id string, text string, source string, file string, section string, method string, start_line int, end_line int")
    asks = spark.createDataFrame([("q1", "how to open a window", None), ("q2", "window", "openWindow();"), ("q3", "", None)], "query_id string, question string, context string")
    got = {r["query_id"]: r for r in Engine(corpus).ask(asks).collect()}
    assert got["q3"]["reject"] == "question" and got["q3"]["answer"] is None
    assert {s["id"] for s in got["q1"]["sources"]} >= {"a::x", "b::y"} and got["q1"]["answer"].startswith("Open a window with openWindow. [1]")
    assert "Code of the user" in got["q2"]["prompt"]


class Longest:
    """A reranker, a generator and a rewriter in one, told apart by what they are given."""

    def __init__(self, f):
        self.f = f

    def make(self):
        return self.f


class Letters:
    reads = "text"

    def make(self):
        import numpy as np

        def embed(texts):
            v = np.array([[t.lower().count(c) for c in "aeiouw"] for t in texts], float)
            return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]

        return embed


def engine_rows(spark):
    rows = [
        (1, "a::x", "Open a window with openWindow. More text.", "docs", "a", "X", None, None, None),
        (2, "b::y", "function openWindow() { return window; }", "code", "b", None, "openWindow", 1, 2),
        (3, "c::z", "Nothing here.", "docs", "c", "Z", None, None, None),
        (4, "d::z", "Nothing here, but much longer than all others.", "docs", "c", "Z", None, None, None),
    ]
    return spark.createDataFrame(rows, "doc long, id string, text string, source string, file string, section string, method string, start_line int, end_line int")


def test_models_are_plugged_in(spark):
    rerank = Longest(lambda qs, ts: [float(len(t)) + (1000 if q == "REWRITTEN" and "window" in t else 0) for q, t in zip(qs, ts)])
    generate_ = Longest(lambda prompts: [f"answer to {p.split('Question:')[1].split()[0]}" for p in prompts])
    rewrite = Longest(lambda qs, cs: [" REWRITTEN " for _ in qs])
    e = Engine(engine_rows(spark), embedder=Letters(), reranker=rerank, generator=generate_, rewriter=rewrite)
    asks = spark.createDataFrame([("q1", "plain question", None), ("q2", "with code", "openWindow();"), ("q3", " ", None)], "query_id string, question string, context string")
    got = {r["query_id"]: r for r in e.ask(asks).collect()}
    # only a question with code is rewritten, and only for retrieval
    assert [s["id"] for s in got["q1"]["sources"]] == ["d::z", "a::x", "b::y"]
    assert [s["id"] for s in got["q2"]["sources"]][0] == "a::x"
    assert (got["q1"]["answer"], got["q2"]["answer"], got["q3"]["answer"]) == ("answer to plain", "answer to with", None)


def test_stored_engine(spark, tmp_path):
    q = spark.createDataFrame([("q", "open the window"), ("r", "nothing")], "query_id string, query string")
    rows = engine_rows(spark)
    want = sorted(Engine(rows).retrieve(q).collect())
    assert sorted(Engine(rows, path=str(tmp_path / "e")).retrieve(q).collect()) == want
    # the second one reads what the first one wrote, and no text
    blank = rows.withColumn("text", F.lit("x"))
    e = Engine(blank, path=str(tmp_path / "e"))
    assert sorted(e.hybrid(q, "docs").collect()) == sorted(Engine(rows).hybrid(q, "docs").collect())
    assert e.index().n == 4 and lexical.Index.load(spark, str(tmp_path / "e" / "index-all")).avgdl == e.index().avgdl


def test_postings_of_a_long_text(spark):
    text = " ".join(f"w{i}" for i in range(30_000)) + " w7 w7"
    got = {r["term"]: (r["tf"], r["dl"]) for r in lexical.postings(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, text string")).collect()}
    assert len(got) == 30_000 and got["w7"] == (3, 30_002) and got["w8"] == (1, 30_002)


def test_rubric_and_means(spark):
    g = spark.createDataFrame([("m", 2, 1), ("m", 0, 2), ("m", None, 2), ("n", 2, 2)], "model string, a int, b int")
    got = {r["model"]: (r["a"], r["b"], r["score"], r["out_of"], r["share"]) for r in evaluate.rubric(g, ("a", "b")).collect()}
    assert got == {"m": (2, 3, 5, 8, 0.625), "n": (2, 2, 4, 4, 1.0)}
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "query_id string, expected string")
    r = spark.createDataFrame([("a", "x", 2)], "query_id string, group string, rank long")
    m = evaluate.source_metrics(evaluate.source_recall(e, r), spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")).first()
    assert (m["n_questions"], m["n_skipped"], m["hit_at_1"], m["hit_at_3"], m["source_recall_at_5"], m["mrr"]) == (2, 1, 0.0, 0.5, 0.25, 0.25)


def test_latency():
    from marram.latency import measure

    calls = []
    got = measure(lambda: calls.append(1), 6, 2)
    assert len(calls) == 6 and got["n"] == 4 and got["min"] <= got["median"] <= got["max"]


def test_first_ranks_have_no_depth(spark):
    words = ["red", "fox", "blue", "sky", "tree"]
    rows = [(d, " ".join(words[(d * 7 + i * i) % 5] for i in range(1 + d % 9)) + f" w{d % 4}") for d in range(60)] + [(60, "the"), (61, None)]
    corpus = spark.createDataFrame(rows, "doc long, text string").repartition(5)
    q = spark.createDataFrame([(f"q{i}", " ".join(words[i % 5 :][:2]) + f" w{i % 4}") for i in range(8)] + [("none", "zebra")], "query_id string, query string")
    relevant = [(f"q{i}", d) for i in range(8) for d in ((i * 11 + 40) % 60, (i * 17 + 53) % 60, 60)] + [("none", 3)]
    all_ = {}
    for r in lexical.search(q, corpus, 1000).collect():
        if (r["query_id"], r["doc"]) in relevant:
            all_[r["query_id"]] = min(r["rank"], all_.get(r["query_id"], 9999))
    assert max(all_.values()) > 10
    rel = spark.createDataFrame(relevant, "query_id string, doc long")
    for block in (4096, 3):
        got = {r["query_id"]: r["first_rank"] for r in lexical.first_ranks(q, corpus, rel, block=block).collect()}
        assert got == all_


def test_dense_first_ranks_have_no_depth(spark):
    v = [(i, [float(i % 6), float(i % 10), 1.0], "rare" if i % 29 == 0 else None if i % 7 == 0 else "often") for i in range(90)] + [(99, None, "rare"), (98, [1.0, 1.0, 1.0], "single")]
    want = {}
    for i, e, l in v:
        if e is None or i % 2:
            continue
        order = sorted((-round(sum(a * b for a, b in zip(e, f)), 9), j, m) for j, f, m in v if f is not None and j != i)
        hit = [n for n, (_, _, m) in enumerate(order, 1) if m == l and l is not None]
        want |= {i: hit[0]} if hit else {}
    assert max(want.values()) > 10 and min(want.values()) == 1
    df = spark.createDataFrame(v, "doc long, embedding array<double>, label string").repartition(5)
    q = df.where("doc % 2 = 0").withColumnRenamed("doc", "query_id")
    for block in (4096, 7):
        assert {r["query_id"]: r["first_rank"] for r in dense.first_ranks(q, df, block=block).collect()} == want


def test_hashed_embeddings_cover_all_sources(spark, small):
    rows = R.corpus(spark, small).select("doc", "source", T.terms(F.col("text")).alias("ts")).collect()
    vectors = dense.HashedEmbedder(R.C.dims).make()([r["ts"] for r in rows])
    want = {(r["doc"], j): round(x, 6) for r, v in zip(rows, vectors) for j, x in enumerate(v) if x}
    got = {(r["doc"], r["dim"]): r["x"] for r in R.hashed_embeddings(spark, small).collect()}
    assert {r["source"] for r in rows} > {"code"} and set(got) == set(want)
    assert all(abs(got[k] - x) < 2e-6 for k, x in want.items())


def test_queries_run_the_whole_pipeline(spark, monkeypatch):
    rows = [
        (1, "a::x", "Open a window with openWindow. More text.", "docs", "a", "X", None, None, None),
        (2, "b::y", "function other() { return 1; }", "code", "b", None, "other", 1, 2),
        (3, "c::z", "Nothing here.", "docs", "c", "Z", None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc long, id string, text string, source string, file string, section string, method string, start_line int, end_line int")
    q = spark.createDataFrame([("q", "how to open a window", None)], "query_id string, query string, category string")
    monkeypatch.setattr(R, "corpus", lambda *_: df)
    monkeypatch.setattr(R, "_ENGINES", {})
    for name in ("asked", "_multi_questions"):
        monkeypatch.setattr(R, name, lambda *_: q)
    monkeypatch.setattr(R, "_expected", lambda *_: spark.createDataFrame([("q", "b"), ("q", "a")], "query_id string, expected string"))
    # chunks that share no term with the question come from dense search alone
    assert {r["doc"] for r in R.multi_source_union(spark, "").collect()} == {1, 2, 3}
    assert [r["doc"] for r in R.source_quota_select(spark, "").orderBy("position").collect()] == [1, 3, 2]
    assert R.answers(spark, "").first()["n_chunks"] == 3
    assert R.prefix_match_recall(spark, "").first()["n_found"] == 2

"""Search in the JVM against the numpy form and plain sums."""

import random

import numpy as np
import pytest

from marram.operators import dense, jvm, lexical


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def both(monkeypatch):
    """Rows of a search in the JVM and by numpy."""

    def run(search):
        quick = search()
        assert "marram_scan" in _plan(quick)
        rows = _rows(quick)
        with monkeypatch.context() as m:
            m.setattr(jvm, "ready", lambda _: False)
            slow = search()
            assert "marram_scan" not in _plan(slow)
            return rows, _rows(slow)

    return run


@pytest.fixture()
def few(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, weights=range(60, 0, -1), k=n))
    # short texts of few words: many ties; one of them has no terms, one a term many times
    corpus = [(7 * d % 1201 - 300, text(rng.randint(1, 9))) for d in range(1200)] + [(5000, "-"), (5001, "w1 " * 60)]
    asked = [(f"q{i:03}", text(rng.randint(1, 6))) for i in range(90)] + [("qa", "w1 w1 w1 w9 w9"), ("qb", "unknown"), ("qc", "-")]
    return spark.createDataFrame(corpus, "doc long, text string"), spark.createDataFrame(asked, "query_id string, query string")


def test_lexical_search_and_ranks_in_the_jvm(spark, few, both, monkeypatch):
    monkeypatch.setattr(jvm, "TILE", 300)
    corpus, q = few
    index = lexical.Index.build(corpus)
    for k, block in ((7, 1000), (1300, 20)):
        quick, slow = both(lambda: lexical.search(q, index, k, block=block))  # noqa: B023
        assert quick == slow and quick
    relevant = q.select("query_id").crossJoin(corpus.where("doc % 97 = 0").select("doc"))
    quick, slow = both(lambda: lexical.first_ranks(q, index, relevant))
    assert quick == slow and len(quick) > 50


def test_dense_search_in_the_jvm(spark, few, both, monkeypatch):
    monkeypatch.setattr(jvm, "TILE", 300)
    corpus, q = few
    vectors = dense.embed(corpus).localCheckpoint()
    asked = dense.embed(q.withColumnsRenamed({"query_id": "doc", "query": "text"})).withColumnRenamed("doc", "query_id").localCheckpoint()
    # values that are no multiples of one number, too many for 8 bits, and a null
    odd = spark.createDataFrame([("x", [0.3, 0.41, -0.17] + [0.0] * 61), ("y", [0.01, -0.9] + [0.0] * 61 + [0.02]), ("z", None)], "query_id string, embedding array<double>")
    asked = asked.unionByName(odd)
    for k, block in ((9, 1000), (1300, 30)):
        quick, slow = both(lambda: dense.search(asked, vectors, k, block=block))  # noqa: B023
        assert quick == slow and quick
    v = {r["doc"]: np.array(r["embedding"]) for r in vectors.collect()}
    e = {r["query_id"]: r["embedding"] for r in asked.where("embedding is not null").collect()}
    want = {i: [d for _, d in sorted((-round(float(np.array(x) @ y), 9), d) for d, y in v.items())[:1300]] for i, x in e.items()}
    assert {i: [d for a, d, _, _ in sorted(quick, key=lambda r: (r[0], r[3])) if a == i] for i in want} == want


def test_vectors_without_a_unit_are_left_to_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.random(8).tolist()) for i in range(50)], "doc long, embedding array<double>")
    got = dense.search(vectors.withColumnRenamed("doc", "query_id"), vectors, 3)
    assert "marram_scan" not in _plan(got) and got.count() == 150


def test_tiles_are_made_again_after_their_scope(spark, few):
    from marram.storage import scope

    corpus, q = few
    index = lexical.Index.build(corpus)
    with scope(spark):
        first = _rows(lexical.search(q, index, 3))
    assert _rows(lexical.search(q, index, 3)) == first

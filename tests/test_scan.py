"""Scores by tiles against plain sums, and passes over the texts that do not grow with the queries."""

import random

import numpy as np

from marram.operators import dense, lexical, scan


class Tile:
    """Columns of a matrix of rows and texts."""

    def __init__(self, rows, names, plan, weights):
        self.names, self.m, self.plan, self.weights = np.asarray(names), rows, plan, weights
        self.largest = np.abs(rows).max(initial=0.0)

    def rows(self, j):
        return (self.m[j] * self.plan.unit[j]).astype(np.float32)

    def sparse(self, j):
        where = np.flatnonzero(self.m[j])
        return where, self.rows(j)[where]

    def exact(self, i, j):
        return np.round((self.weights[i] * self.m.T[j]).sum(axis=1), 9)


def planned(weights, whole, scale=None):
    i, at = np.nonzero(weights)
    return scan.Plan(at, weights[i, at] / (1 if scale is None else scale[i]), np.bincount(i, minlength=len(weights)), whole, scale)


def test_best_and_ranks_over_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(scan, "PAIRS", 50)
    for filled, signed in ((0.2, False), (0.2, True), (0.9, True)):
        weights = np.where(rng.random((40, 30)) < filled, rng.integers(1, 3, (40, 30)) * np.where(rng.random((40, 30)) < 0.5 * signed, -1.0, 1.0), 0.0) * rng.choice([0.7, 1.3], 40)[:, None]
        weights[7] = 0
        rows = np.where(rng.random((30, 300)) < 0.3, rng.integers(1, 4, (30, 300)) / 7, 0.0)
        names = rng.permutation(300)
        scale = rng.choice([0.5, 3.0], 40) if signed else None
        plan = planned(weights, np.ones(30, bool) if signed else rng.random(30) < 0.5, scale)
        cut = lambda: (Tile(rows[:, s : s + 70], names[s : s + 70], plan, weights) for s in range(0, 300, 70))  # noqa: B023, E731
        scores = np.round(weights @ rows, 9)
        for positive in (False, True):
            got = {}
            for i, d, s in zip(*scan.best_of(plan, 5, positive, cut()).rows()):
                got.setdefault(int(i), []).append((-s, d))
            for q in range(40):
                want = sorted((-s, d) for s, d in zip(scores[q].tolist(), names.tolist()) if s > 0 or not positive)[:5]
                assert [d for _, d in sorted(got.get(q, []))] == [d for _, d in want]
        goal = rng.integers(0, 300, 40)
        n = scan.before(plan, scores[np.arange(40), goal], names[goal], cut())
        for q in range(40):
            assert n[q] == sum((-s, d) < (-scores[q, goal[q]], names[goal[q]]) for s, d in zip(scores[q].tolist(), names.tolist()))


def test_whole_multiples_are_summed_in_16_bits(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(scan, "PAIRS", 50)
    for signed in (False, True):
        weights = np.where(rng.random((40, 30)) < 0.12, rng.integers(1, 4, (40, 30)) * np.where(rng.random((40, 30)) < 0.5 * signed, -1.0, 1.0), 0.0)
        weights[3] *= 1.37
        weights[4] *= 40
        weights[5] = 0
        rows = np.where(rng.random((30, 300)) < 0.3, rng.choice([1e-6, 0.2, 0.7, 3.0], (30, 300)), 0.0)
        names = rng.permutation(300)
        plan = planned(weights, rng.random(30) < 0.5, np.ones(40))
        # what is no whole multiple, and what would make all steps coarse, is left to 32 bits
        assert plan.short.sum() > 25 and not plan.short[3] and not plan.short[4]
        tile = Tile(rows, names, plan, weights)
        by, step, error = plan.steps(tile.largest, not signed)
        scores = weights @ rows
        kinds = set()
        for i, sums in plan.sums(tile, by, not signed):
            kinds.add((bool(plan.short[i]), sums.dtype))
            assert (np.abs(sums * step[i] - scores[i]) <= error[i]).all()
        assert kinds == {(True, np.dtype(np.int16)), (False, np.dtype(np.float32))}
        cut = lambda: (Tile(rows[:, s : s + 70], names[s : s + 70], plan, weights) for s in range(0, 300, 70))  # noqa: B023, E731
        got = {}
        for i, d, s in zip(*scan.best_of(plan, 5, not signed, cut()).rows()):
            got.setdefault(int(i), []).append((-s, d))
        for q in range(40):
            want = sorted((-s, d) for s, d in zip(np.round(scores[q], 9).tolist(), names.tolist()) if s > 0 or signed)[:5]
            assert [d for _, d in sorted(got.get(q, []))] == [d for _, d in want]


def _plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def _few(spark):
    words = [f"w{i}" for i in range(40)]
    rng = random.Random(2)
    corpus = spark.createDataFrame([(d, " ".join(rng.choices(words, k=12))) for d in range(200)], "doc long, text string")
    q = spark.createDataFrame([(f"q{i:02}", " ".join(rng.choices(words, k=3))) for i in range(40)], "query_id string, query string")
    return corpus, q, lexical.Index.build(corpus)


def test_lexical_passes_do_not_grow_with_queries(spark):
    corpus, q, index = _few(spark)
    got = lexical.search(q, index, 5, block=4)
    assert _plans(got) <= spark.sparkContext.defaultParallelism
    key = lambda r: (r["query_id"], r["rank"])
    assert sorted(got.collect(), key=key) == sorted(lexical.search(q, index, 5).collect(), key=key)


def test_dense_passes_do_not_grow_with_queries(spark):
    corpus, q, _ = _few(spark)
    vectors, asked = dense.embed(corpus), dense.embed(q.withColumnsRenamed({"query_id": "doc", "query": "text"})).withColumnRenamed("doc", "query_id")
    got = dense.search(asked, vectors, 5, block=4)
    assert _plans(got) <= spark.sparkContext.defaultParallelism
    v = {r["doc"]: np.array(r["embedding"]) for r in vectors.collect()}
    want = {r["query_id"]: sorted((-round(float(np.array(r["embedding"]) @ x), 9), d) for d, x in v.items())[:5] for r in asked.collect()}
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["doc"]))
    assert found == want


def test_first_ranks_pass_once(spark):
    _, q, index = _few(spark)
    relevant = q.select("query_id").crossJoin(spark.range(3, 60, 19).withColumnRenamed("id", "doc"))
    got = lexical.first_ranks(q, index, relevant, block=4)
    # one more for the scores of the relevant texts, which each side of a union holds
    assert _plans(got) <= 2 * spark.sparkContext.defaultParallelism
    ranks = {}
    for r in lexical.search(q, index, 1000).where("doc in (3, 22, 41)").collect():
        ranks[r["query_id"]] = min(r["rank"], ranks.get(r["query_id"], 9999))
    assert {r["query_id"]: r["first_rank"] for r in got.collect()} == ranks


def test_terms_of_texts_do_not_move_with_candidates(spark):
    from marram.operators import fusion

    _, q, index = _few(spark)
    candidates = lexical.search(q, index, 5)
    got = fusion.rerank(candidates, None, q, index=index)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    have = [len(x) - len(x.lstrip(" :+-")) for x in plan if "AS have#" in x]
    weights = [len(x) - len(x.lstrip(" :+-")) for x in plan if "AS ts#" in x]
    # the questions' weights are joined below the texts' terms
    assert len(have) == 1 and max(weights) > have[0]
    assert got.count() == candidates.count()


def test_counts_over_lengths_are_summed_in_8_bits(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scan, "SEGMENT", 16)
    monkeypatch.setattr(scan, "MARKS", 3)
    rng = np.random.default_rng(8)
    counts = np.where(rng.random((300, 40)) < 0.4, rng.integers(-4, 5, (300, 40)), 0)
    counts[5], counts[6, 0] = 0, 90
    asked = np.where(rng.random((40, 40)) < 0.1, rng.integers(-2, 3, (40, 40)), 0)
    asked[7], asked[8] = 0, [1, 2, 3, 400] + [0] * 36
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]
    vectors, asked, names = unit(counts), unit(asked), rng.permutation(300)
    odd = vectors.copy()
    odd[:, 3] += 0.01 * rng.random(300)
    for given, whole in ((vectors, True), (odd, False)):
        kinds = set()

        def cut():
            for s in range(0, 300, 70):
                v = given[s : s + 70]
                batch = pa.RecordBatch.from_arrays([pa.array(names[s : s + 70]), pa.array(v.tolist())], names=["doc", "embedding"])
                t = dense._Tile(batch, asked)
                assert (t.units is not None) == whole
                if whole:
                    kinds.update(x.dtype for _, x in plan.sums(t, size=plan.multiples(t)[0]))
                yield t

        plan = dense._plan(asked)
        got = {}
        for i, d, s in zip(*scan.best_of(plan, 5, False, cut()).rows()):
            got.setdefault(int(i), []).append((-s, d))
        scores = np.round((asked[:, None, :] * given[None]).sum(axis=2), 9)
        for q in range(40):
            assert sorted(got[q]) == sorted((-s, d) for s, d in zip(scores[q].tolist(), names.tolist()))[:5]
        assert kinds == ({np.dtype(x) for x in (np.int8, np.int16, np.float32)} if whole else set())


def test_terms_are_found_by_their_upper_bits():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    terms = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 50), (7 << 48) + np.arange(20), [-(2**63), 2**63 - 1]]))
    lists = [pa.array([x.tolist()]) for x in (terms, np.ones(len(terms)), np.full(len(terms), 3))]
    asks = lexical._Asks(pa.RecordBatch.from_arrays([pa.array(["q"]), *lists], names=["query_id", "ts", "ws", "dfs"]), 100)
    hashes = rng.permutation(np.concatenate([terms, terms[1:-1] + 1, terms[1:-1] - 1, rng.integers(-(2**63), 2**63 - 1, 50)]))
    hit, at = asks.find(hashes)
    assert hit.tolist() == np.flatnonzero(np.isin(hashes, terms)).tolist() and (terms[at] == hashes[hit]).all()

import random

import numpy as np

from marram.llm import contamination as C
from marram.llm.words import WORD


def brute(docs, items, n=13):
    grams = lambda t: {tuple(w[i : i + n]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - n + 1)}
    g = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs if d is not None for s in [grams(t)] if s for i, x in g if s & x}


def make(seed):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(300)]
    special = [f"e{i}" for i in range(200)] + common[:60]
    items = [(i, " ".join(rng.choice(special) for _ in range(rng.randint(5, 70)))) for i in range(60)] + [(99, None), (98, "")]
    docs = []
    for d in range(300):
        w = [rng.choice(common) for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.4:
            x = WORD.findall(rng.choice(items[:60])[1])
            k = rng.randint(8, 30)
            s = rng.randrange(max(1, len(x) - k))
            at = rng.randint(0, len(w))
            w[at:at] = x[s : s + k]
        docs.append((d, " ".join(y.upper() + "," if rng.random() < 0.2 else f"**{y}**" for y in w)))
    return docs + [(900, None), (901, ""), (902, "c1 " * 20000)], items


def test_recall_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = make(seed)
        df = spark.createDataFrame([(d, t, "clash") for d, t in docs] * 2, "doc_id long, text string, item_id string").repartition(4)
        it = spark.createDataFrame(items, "item_id long, text string")
        for p in (C.LeakSearch(rank=64), C.LeakSearch(rank=64, items_a_pass=25)):
            got = [(r[0], r[1]) for r in C.verbatim(C.leaks(df, it, p=p)).select("doc_id", "item_id").collect()]
            want = brute(docs, items)
            assert len(got) == len(set(got)) and set(got) <= want
            assert len(set(got)) >= 0.98 * len(want) > 10


def test_recall_of_altered_passages(spark):
    """Passages with every sixth to ninth word replaced by a new one: nearly all are found, and under their item."""
    rng = random.Random(8)
    words = [f"e{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(50)]
    docs, planted = [], set()
    for d in range(200):
        w = [f"c{rng.randrange(500)}" if rng.random() < 0.8 else rng.choice(words) for _ in range(120)]
        if d % 2:
            i = rng.randrange(50)
            x, every = items[i][1].split()[:36], rng.randint(6, 9)
            x = [f"n{rng.randrange(9999)}" if k % every == 3 else y for k, y in enumerate(x)]
            w[50:50] = x
            planted.add((d, i))
        docs.append((d, " ".join(w)))
    found = C.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), p=C.LeakSearch(bridge=2, rank=64))
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in C.kinds(found).collect()}
    assert len(planted & set(got)) >= 0.9 * len(planted) and set(got) <= planted
    assert set(got.values()) == {"paraphrase"}


def test_svd_against_numpy(spark):
    docs, items = make(3)
    it = C.read_items(items)
    p = C.LeakSearch(min_run=5, rank=8, power=4)
    f = C.passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text", it, p)
    idf = np.ones(len(it.vocabulary))
    basis = C.latent_space(f, it, idf, p)
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-8)
    texts = [np.frombuffer(r["words"], np.int32) for r in f.where("words is not null").collect()]
    wt, terms = C.Weights(idf), len(idf)
    mine, _ = C._cut(it.words, p.query, p.query_step)
    rows, _ = C._cut(texts, p.window, p.window)
    dense = lambda w: wt.times(w, np.eye(terms))
    a = np.concatenate([dense(rows), dense(mine) * np.sqrt(len(rows) / len(mine))])
    s = np.linalg.svd(a, compute_uv=False)
    kept = np.linalg.norm(a @ basis) ** 2
    assert kept > 0.97 * (s[:8] ** 2).sum()


def test_alignment():
    rng = random.Random(6)
    a = [[rng.randrange(4) for _ in range(8)] for _ in range(60)]
    b = [[rng.randrange(4) for _ in range(12)] for _ in range(60)]
    run, lcs = C.align(np.array(a), np.array(b))
    for x, y, r, l in zip(a, b, run, lcs):
        t = [[0] * 13 for _ in range(9)]
        best = 0
        for i in range(8):
            for j in range(12):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
                k = 0
                while i + k < 8 and j + k < 12 and x[i + k] == y[j + k]:
                    k += 1
                best = max(best, k)
        assert (r, l) == (best, t[8][12])


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 10)], "item_id long, text string")
    assert C.leaks(docs, items).collect() == [] and C.leaks(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
    assert C.kinds(C.leaks(docs, items)).collect() == []

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marram.llm import packing as K


def padding(lengths, counts, ends, capacity=60):
    return sum(n * (capacity / (capacity // min(e for e in ends if e >= x)) - x) for x, n in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        lengths = np.array(sorted(rng.sample(range(1, 60), 9)))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        for k in (1, 2, 3, 4):
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], k - 1))
            ends = K.boundaries(lengths, counts, 60, k)
            assert len(ends) <= k and abs(padding(lengths, counts, ends) - best) < 1e-9


@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
@settings(max_examples=150, deadline=None)
def test_fill_keeps_capacity(tokens):
    lengths, counts = np.unique(tokens, return_counts=True)
    ends = K.boundaries(lengths, counts, 50, 4)
    where = K.fill(tokens, 50, ends)
    used = {}
    for w, t in zip(where, tokens):
        used[w] = used.get(w, 0) + t
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 50
    # every bucket fills the slots of its batches
    own = [min(e for e in ends if e >= t) for t in tokens]
    assert len(used) <= sum(-(-own.count(e) // (50 // e)) for e in ends)


def test_boundaries_form_the_batches():
    """Other boundaries give other placements; a container starts with one batch of its bucket."""
    rng = random.Random(9)
    tokens = [rng.randint(1, 100) for _ in range(600)]
    lengths, counts = np.unique(tokens, return_counts=True)
    best = K.boundaries(lengths, counts, 100, 6)
    placed = [K.fill(tokens, 100, ends) for ends in (best, [100], [20, 60, 100], [40, 100])]
    assert len({tuple(p) for p in placed}) == 4
    # more buckets, less padding, fewer containers than without
    assert max(placed[0]) < max(placed[1])
    # a container that is not the last of its bucket has at least as many items of it as slots, or no room for one
    used = {}
    for w, t in zip(placed[0], tokens):
        used.setdefault(w, []).append(t)
    upper = lambda t: min(e for e in best if e >= t)
    short = {}
    for ts in used.values():
        u = upper(max(ts))
        if sum(upper(t) == u for t in ts) < 100 // u:
            short[u] = short.get(u, 0) + 1
    assert all(n == 1 for n in short.values())


def test_padding_and_rules(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randint(0, 260)) for i in range(500)], "item long, tokens long")
    placed = K.pack(df, [100])
    rows = K.padding(placed).collect()
    assert all(r["slots"] == 100 // r["bucket"] and r["padding"] >= 0 for r in rows)
    assert sum(r["padding"] for r in rows) < sum(r["padding_in_one"] for r in rows)
    r = K.rules(placed).first()
    assert (r["n_items"], r["n_overfull"], r["n_split_needlessly"]) == (500, 0, 0) and r["n_split"] == df.where("tokens > 100").count()


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 5, 30, 99, 100, 101, 250, 300])) for i in range(400)] + [(500, 0), (501, None), (502, 7), (502, 7)]
    df = spark.createDataFrame(rows, "item long, tokens long")
    placed = K.pack(df, [100, 512, 100])
    got = K.container_id(placed).collect()
    for cap in (100, 512):
        mine = [r for r in got if r["capacity"] == cap]
        per = {}
        for r in mine:
            per[r["item"]] = per.get(r["item"], 0) + r["tokens"]
        assert per == {i: (t or 0) * (2 if i == 502 else 1) for i, t in rows}
        pieces = [r["item"] for r in mine if r["tokens"] == cap or r["piece"] > 0]
        assert all(dict(rows)[i] >= cap for i in pieces)
    c = K.containers(placed).collect()
    assert all(0 <= r["unused"] == r["capacity"] - r["used"] for r in c)
    assert sum(r["used"] for r in c if r["capacity"] == 100) == sum(t or 0 for _, t in rows)
    assert K.pack(df.limit(0), [100]).collect() == [] and K.pack(df, []).collect() == []

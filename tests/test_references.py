import random
from datetime import datetime, timedelta

from marram.operators import references as R

REFS = "ref_table string, id string, ref string, created_at timestamp_ntz, by_lead boolean"
PARENTS = "id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, ref string"
T0 = datetime(2024, 1, 1)


def brute(refs, parents):
    out = set()
    for table, i, ref, at, lead in refs:
        if ref is None:
            continue
        rows = [p for p in parents if p[0] is not None and (p[0] == ref or (lead and p[0].startswith(ref + "::")))]
        seen = [p for p in rows if p[1] is not None and at is not None and p[1] <= at]
        if any(p[2] is None or p[2] > at for p in seen):
            continue
        out.add((table, i, ref, "missing" if not rows else "late" if not seen else "deleted", at.strftime("%Y-%m") if at else None))
    return out


def run(spark, refs, parents):
    got = R.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()
    rows = [tuple(r) for r in got]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    rng = random.Random(1)
    for seed in range(4):
        keys = ["a", "a::b", "a::b::c", "a:::b", "::a", "x", "x::", "ab::c", ""]
        # a hot key, times that tie, and steps of minutes so that slices are crossed
        at = lambda: T0 + timedelta(minutes=rng.randint(0, 60) * (1 if seed % 2 else 7))
        parents = []
        for _ in range(60):
            t = rng.choice([at(), at(), None])
            parents.append((rng.choice([*keys, "a::b", None]), t, rng.choice([None, (t or T0) + timedelta(minutes=rng.randint(0, 30))]), "clash"))
        refs = [(rng.choice("rq"), str(rng.randint(0, 30)), rng.choice([*keys, None, "zz"]), rng.choice([at(), at(), at(), None]), rng.random() < 0.5) for _ in range(120)]
        assert run(spark, refs + refs[:20], parents) == brute(refs, parents)


def test_empty_tables(spark):
    assert run(spark, [], [("a", T0, None, "")]) == set()
    assert run(spark, [("q", "1", "a", T0, False)], []) == {("q", "1", "a", "missing", "2024-01")}


def test_ties(spark):
    p = [("a", T0, T0 + timedelta(days=1), "")]
    assert run(spark, [("q", "1", "a", T0, False)], p) == set()
    assert run(spark, [("q", "1", "a", T0 + timedelta(days=1), False)], p) == {("q", "1", "a", "deleted", "2024-01")}
    assert run(spark, [("q", "1", "a", T0 - timedelta(microseconds=1), False)], p) == {("q", "1", "a", "late", "2023-12")}


def test_plan_has_no_cross_join_or_python(spark, small):
    from marram.plans.orphans import p1_found

    plan = p1_found(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan

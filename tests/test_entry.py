import os

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the small test tables")
def test_queries_equal_their_sql(spark):
    """Every query that has SQL gives the same rows on the smallest tables; one session for all."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ROOT}/{f}'")
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in sql:
        df = queries[name](spark, ROOT)
        cols = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        cur = con.execute(sql[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols, name
        want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want, name


def test_flagship(spark):
    assert entry.entry(spark).columns == ["ref_table", "id", "ref", "reason", "period"]

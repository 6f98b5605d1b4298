import os

import pytest

from marram.__main__ import main
from marram.operators.base import HybridRetriever
from marram.operators.lexical import search

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the small test tables")
def test_commands(spark, tmp_path, capsys):
    main(["ask", "how to verify a nested alias", "--root", ROOT])
    assert "- " in capsys.readouterr().out
    main(["ask", " ", "--root", ROOT])
    assert "rejected: question" in capsys.readouterr().out
    main(["embed", "--root", ROOT, "--out", str(tmp_path / "v")])
    assert spark.read.parquet(str(tmp_path / "v")).where("model = 'hashed'").count() > 100
    main(["evaluate", "--root", ROOT])
    assert "recall_at_10" in capsys.readouterr().out


def test_retriever_and_plan(spark):
    corpus = spark.createDataFrame([(i, f"word{i} common text") for i in range(30)], "doc long, text string")
    q = spark.createDataFrame([("a", "word7 common")], "query_id string, query string")
    assert HybridRetriever(corpus).search(q, 20, 3).orderBy("rank").first()["doc"] == 7
    plan = search(q, corpus, 5)._jdf.queryExecution().executedPlan().toString()
    # the best are kept before rows are gathered by query
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "Join" not in plan

import os

import pytest

from marram import storage


def exists(spark, df):
    return all(os.path.exists(f.removeprefix("file://").replace("///", "/")) for f in df.inputFiles())


def test_tables_live_as_long_as_their_scope(spark):
    outer = storage.write_through(spark.range(5).toDF("x"), "outer")
    with storage.scope(spark):
        inner = storage.write_through(outer.selectExpr("x + 1 as x"), "inner")
        files = inner.inputFiles()
        assert sorted(r["x"] for r in inner.collect()) == [1, 2, 3, 4, 5]
        with storage.scope(spark):
            storage.write_through(inner, "innermost")
        assert exists(spark, inner)
    assert not any(os.path.exists(f.replace("file://", "")) for f in files)
    assert outer.count() == 5
    storage.discard(outer)
    assert not os.path.exists(outer.inputFiles()[0].replace("file://", "")) if outer.inputFiles() else True


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        applicationId = "a"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return spark.sparkContext.getConf()

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            storage.shared_dir(Session())

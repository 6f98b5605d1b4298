"""Shared-folder tables that cut lineage.

A long plan is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir`` and reading it back: every executor sees that folder, so a
lost executor costs nothing but a re-read. Where the setting is absent, a local master
gets a folder once per application, and any other master an error.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; read from the session, made only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="marram-")
    return f"file://{_LOCAL[app]}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def write_through(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table is removed when the Python process ends; until then any number of
    lazily evaluated plans may read it. Shuffle files of plans that nobody holds any
    more are released at once, as the cut would else double what lies on disk.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", compression).parquet(path)
    atexit.register(_drop, spark, path)
    for held in _SCOPES:
        held.append(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: for sessions that run many queries.

    What was made inside must have been read by then; an engine that is to keep its
    indexes is made and first used outside.
    """
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        # by identity: an outer scope may hold equal paths
        _SCOPES[:] = [x for x in _SCOPES if x is not held]
        for path in held:
            _drop(spark, path)
        release(spark)


def discard(df: DataFrame) -> None:
    """Removes the table that :func:`write_through` made for ``df``; no plan may read it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files of another form; removed when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    for held in _SCOPES:
        held.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and broadcasts that are no longer referred to.

    Events that wait for their listeners still hold plans, so they are waited for.
    """
    gc.collect()
    try:
        spark._jsc.sc().listenerBus().waitUntilEmpty(5000)
    except Exception:  # slow listeners only delay the deletion
        pass
    spark._jvm.System.gc()

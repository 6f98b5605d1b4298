"""Scans and sinks: page and source files, chunk lines, embeddings, results.

Tables in Parquet, ORC, CSV or over JDBC are read with Spark's own readers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import text as T
from marram.functions.front_matter import parse
from marram.sources import schemas


def relative_path(file_path: Column, root: str) -> Column:
    """A file's path below ``root``, with forward slashes."""
    full = F.url_decode(F.regexp_replace(F.regexp_replace(file_path, r"\+", "%2B"), r"^file:/+", "/"))
    base = root.rstrip("/").removeprefix("file:").replace("//", "/") + "/"
    return F.when(full.contains(base), F.substring_index(full, base, -1)).otherwise(full)


def scan_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path`` (relative to ``root``, with forward slashes) and ``content`` of whole files below a folder."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return df.select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("content"))


def scan_documents(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Pages: ``doc, content, source, file_path, version, attrs``; keys of the front matter win over the last three.

    Nested values of the front matter are JSON text in ``attrs``.
    """
    t = scan_texts(spark, root, "*.mdx").withColumn("content", F.regexp_replace("content", r"\r\n?", "\n"))
    given = t.select("path", T.body(F.col("content")).alias("content"), T.front_matter(F.col("content")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            attrs = pa.array([list(parse(x).items()) for x in b.column(2).to_pylist()], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), attrs], names=["path", "content", "attrs"])

    t = given.mapInArrow(run, "path string, content string, attrs map<string,string>")
    own = lambda k, default: F.coalesce(F.try_element_at("attrs", F.lit(k)), default)
    return t.select(
        F.col("path").alias("doc"),
        T.clean(F.col("content")).alias("content"),
        F.lit("docs").alias("source"),
        own("file_path", F.col("path")).alias("file_path"),
        own("version", F.lit(version)).alias("version"),
        "attrs",
    )


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    """Source files: ``file, content``."""
    return scan_texts(spark, root, "*.zep").withColumnRenamed("path", "file")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as JSON lines; a line that does not fit the schema is an error."""
    return spark.read.schema(schemas.CHUNK).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, nulls written out, existing files replaced."""
    chunks.select("id", "content", "source", "metadata").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or an array of them, that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """``chunk_id, embedding, model, source`` as Parquet, one folder a model and source."""
    vectors.write.mode("overwrite").partitionBy("model", "source").parquet(path)


def read_retrieval_data(chunks: DataFrame, vectors: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with their vectors, boilerplate texts left out; ids must match one to one.

    An id that only one side has, or that is counted differently, is an error, raised
    when the result is read. Where both tables have an ``ordinal``, the vector at a
    position must belong to the chunk at that position.
    """
    a = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("a"))
    b = vectors.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("b"))
    wrong = a.join(b, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    keys = ["id"]
    v = vectors.withColumnRenamed("chunk_id", "id").drop("source")
    if "ordinal" in chunks.columns and "ordinal" in vectors.columns:
        keys = ["ordinal", "id"]
        pairs = chunks.select("ordinal", F.col("id").alias("x")).join(vectors.select("ordinal", F.col("chunk_id").alias("y")), "ordinal", "full_outer")
        wrong = wrong.select("id").unionByName(pairs.where(~F.col("x").eqNullSafe(F.col("y"))).select(F.coalesce("x", "y").alias("id")))
    # one row; its error ends the job that reads the result
    check = wrong.agg(F.when(F.count(F.lit(1)) > 0, F.raise_error("embeddings do not match the chunks").cast("long")).otherwise(F.lit(0)).alias("n_wrong"))
    return chunks.where(~T.is_noise(F.col("content"), noise)).join(v, keys).join(F.broadcast(check)).where("n_wrong = 0").drop("n_wrong")


def write_result(result: DataFrame, path: str) -> None:
    """Evaluation results as JSON."""
    result.write.mode("overwrite").option("ignoreNullFields", False).json(path)

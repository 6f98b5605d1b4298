"""Incremental ingest: pages that arrive as files become chunks and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marram.functions import text as T
from marram.operators.docs_chunker import chunk_documents
from marram.operators.lexical import postings
from marram.sources.files import relative_path


def page_stream(spark: SparkSession, root: str, files_a_trigger: int = 1000) -> DataFrame:
    """``path, content`` of whole files, as they arrive; ``path`` is relative to ``root``."""
    return (
        spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.mdx").option("maxFilesPerTrigger", files_a_trigger).load(root)
        .select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("content"))
    )


def start_ingest(spark: SparkSession, root: str, target: str, checkpoint: str, files_a_trigger: int = 1000) -> StreamingQuery:
    """Writes chunks and postings of new and changed pages below ``target``, each batch exactly once.

    Batches go to folders named by their number and are overwritten on a retry. Each
    batch also lists its pages, so that :func:`current` can leave out what a later
    batch replaced. A page within one batch is taken once.
    """

    def batch(pages: DataFrame, number: int) -> None:
        pages = pages.dropDuplicates(["path"])
        pages.select("path").write.mode("overwrite").parquet(f"{target}/pages/batch={number}")
        body = T.clean(T.body(F.regexp_replace("content", r"\r\n?", "\n")))
        chunks = chunk_documents(pages.select(F.col("path").alias("doc"), body.alias("content")))
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        stored = pages.sparkSession.read.parquet(f"{target}/chunks/batch={number}")
        postings(stored.select(F.col("id").alias("doc"), F.col("content").alias("text"))).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")

    return page_stream(spark, root, files_a_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, present: DataFrame | None = None) -> DataFrame:
    """Chunks of each page's last batch; with ``present`` (``path``), of pages that still exist."""
    last = spark.read.parquet(f"{target}/pages").withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy(F.col("batch").desc()))).where("at = 1")
    last = last.select(F.col("path").alias("doc"), "batch")
    if present is not None:
        last = last.join(present.select(F.col("path").alias("doc")), "doc", "left_semi")
    return spark.read.parquet(f"{target}/chunks").join(last, ["doc", "batch"]).drop("batch")

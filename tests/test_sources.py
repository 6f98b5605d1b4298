import os

import pytest
from pyspark.sql import functions as F

from marram.sources import files, schemas
from marram.streaming.ingest import current, start_ingest


def test_scan_and_chunk_lines(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x y.mdx").write_text("---\ntitle: T\nversion: 9\n---\n# H\r\ntext\n", encoding="utf-8")
    (tmp_path / "a" / "z.zep").write_text("function f() { }", encoding="utf-8")
    d = files.scan_documents(spark, str(tmp_path), "1.0").collect()
    assert [(r["doc"], r["content"], r["version"], r["attrs"]) for r in d] == [("a/b/x y.mdx", "# H\ntext\n", "9", {"title": "T", "version": "9"})]
    assert [(r["file"], r["content"]) for r in files.scan_sources(spark, str(tmp_path)).collect()] == [("a/z.zep", "function f() { }")]
    chunks = spark.createDataFrame([("i", "c", "docs", None)], schemas.CHUNK)
    files.write_chunks(chunks, str(tmp_path / "out"))
    assert files.read_chunks(spark, str(tmp_path / "out")).collect() == chunks.collect()
    (tmp_path / "bad.json").write_text('{"id": 1, "content": {"x": 1}\n', encoding="utf-8")
    with pytest.raises(Exception):
        files.read_chunks(spark, str(tmp_path / "bad.json")).collect()


def test_embeddings_must_match(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x", "docs", None), ("b", "y", "code", None)], schemas.CHUNK)
    vectors = spark.createDataFrame([("a", [1.0], "m", "docs"), ("b", [0.0], "m", "code")], schemas.EMBEDDING)
    files.write_embeddings(vectors, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert files.read_retrieval_data(chunks, back).count() == 2
    with pytest.raises(Exception, match="do not match"):
        files.read_retrieval_data(chunks, back.where("chunk_id = 'a'")).collect()
    noise = files.read_retrieval_data(chunks, back, noise=("\n x ",))
    assert [r["id"] for r in noise.collect()] == ["b"]


def test_embeddings_must_stand_in_order(spark):
    chunks = spark.createDataFrame([("a", "x", 0), ("b", "y", 1)], "id string, content string, ordinal long")
    vectors = lambda *ids: spark.createDataFrame([(x, [1.0], i) for i, x in enumerate(ids)], "chunk_id string, embedding array<float>, ordinal long").withColumn("source", F.lit("s"))
    assert files.read_retrieval_data(chunks, vectors("a", "b")).count() == 2
    with pytest.raises(Exception, match="do not match"):
        files.read_retrieval_data(chunks, vectors("b", "a")).collect()


def test_stream(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p.mdx").write_text("# A\nsome words here\n## B\nmore words", encoding="utf-8")
    for _ in range(2):
        q = start_ingest(spark, str(pages), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t" / "chunks")).collect()) == ["p.mdx::a", "p.mdx::a::b"]
    assert spark.read.parquet(str(tmp_path / "t" / "postings")).where("term = 'words'").count() == 2


def test_stream_replaces_and_keeps_apart(spark, tmp_path):
    pages = tmp_path / "pages"
    for d in ("a", "b"):
        (pages / d).mkdir(parents=True)
        (pages / d / "index.mdx").write_text(f"# A\ntext of {d}", encoding="utf-8")
    run = lambda: start_ingest(spark, str(pages), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    run()
    (pages / "a" / "index.mdx").unlink()
    (pages / "a" / "new.mdx").write_text("# N\nnew", encoding="utf-8")
    (pages / "b" / "index.mdx").unlink()
    (pages / "b" / "index.mdx").write_text("# A\nchanged text", encoding="utf-8")
    os.utime(pages / "b" / "index.mdx", (2e9, 2e9))
    run()
    got = {r["id"]: r["content"] for r in current(spark, str(tmp_path / "t")).collect()}
    assert set(got) >= {"a/index.mdx::a", "b/index.mdx::a", "a/new.mdx::n"}
    present = spark.createDataFrame([("b/index.mdx",), ("a/new.mdx",)], "path string")
    left = {r["id"] for r in current(spark, str(tmp_path / "t"), present).collect()}
    assert left == {"b/index.mdx::a", "a/new.mdx::n"}

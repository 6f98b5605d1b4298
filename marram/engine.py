"""The ask pipeline as one batch: many questions through retrieval, selection, prompt and answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.config import RetrievalConfig
from marram.operators import dense, fusion, generate, lexical
from marram.operators.models import Embedder, Generator, Reranker, Rewriter, apply_model
from marram.storage import write_through

SOURCES = ("docs", "code")


class Engine:
    """Answers requests over ``doc, id, text, source, file, section, method, start_line, end_line``.

    Models are given as objects (:mod:`marram.operators.models`); without them offline
    stand-ins are used. Each source's lexical index and vectors, and the index of all
    texts, are made on first use and kept; with ``path`` they are kept there, and read
    if they are already there.
    """

    def __init__(
        self,
        corpus: DataFrame,
        config: RetrievalConfig = RetrievalConfig(),
        embedder: Embedder | None = None,
        reranker: Reranker | None = None,
        generator: Generator | None = None,
        rewriter: Rewriter | None = None,
        path: str | None = None,
    ) -> None:
        self.corpus, self.config, self.path = corpus, config, path
        self.embedder = embedder or dense.HashedEmbedder(config.dims)
        self.reranker, self.generator, self.rewriter = reranker, generator, rewriter
        self._indexes: dict[str | None, lexical.Index] = {}
        self._vectors: dict[str | None, DataFrame] = {}

    def _of(self, source: str | None) -> DataFrame:
        return self.corpus if source is None else self.corpus.where(F.col("source") == source)

    def _stored(self, kind: str, source: str | None, marker: str) -> tuple[str | None, bool]:
        if self.path is None:
            return None, False
        spark, folder = self.corpus.sparkSession, f"{self.path}/{kind}-{source or 'all'}"
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}{marker}/_SUCCESS")
        return folder, p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def index(self, source: str | None = None) -> lexical.Index:
        """The lexical index of a source, or of all texts."""
        if source not in self._indexes:
            folder, there = self._stored("index", source, "/df")
            self._indexes[source] = lexical.Index.load(self.corpus.sparkSession, folder) if there else lexical.Index.build(self._of(source), folder)
        return self._indexes[source]

    def vectors(self, source: str | None = None) -> DataFrame:
        """``doc, embedding`` of a source, or of all texts."""
        if source not in self._vectors:
            folder, there = self._stored("vectors", source, "")
            spark, made = self.corpus.sparkSession, None if there else dense.embed(self._of(source), self.embedder)
            if folder is None:
                self._vectors[source] = write_through(made, "vectors")
            else:
                if not there:
                    made.write.mode("overwrite").parquet(folder)
                self._vectors[source] = spark.read.parquet(folder)
        return self._vectors[source]

    def hybrid(self, queries: DataFrame, source: str | None = None) -> DataFrame:
        """``query_id, doc, score, rank``: dense and lexical search of one source, or of all texts, fused."""
        return fusion.hybrid(queries, self._of(source), self.config, self.embedder, self.index(source), self.vectors(source))

    def search(self, queries: DataFrame) -> DataFrame:
        """``query_id, doc, score, rank``: hybrid search of each source, fused."""
        return fusion.multi_source([self.hybrid(queries, s) for s in SOURCES], self.config)

    def rerank(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        """``query_id, doc, score, rank`` of candidates in the reranker's order."""
        if self.reranker is None:
            return fusion.rerank(candidates, self.corpus, queries, index=self.index())
        return fusion.rerank(candidates, self.corpus.withColumn("text", generate.rerank_text()), queries, model=self.reranker)

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """``query_id, doc, source, in_source, position`` of the chunks chosen for ``query_id, query``."""
        c = self.config
        scored = self.rerank(self.search(queries), queries).join(self.corpus.select("doc", "source"), "doc")
        return fusion.select_by_source(scored.withColumn("tie", F.col("rank")), {"docs": c.docs_kept, "code": c.code_kept}).select("query_id", "doc", "source", "in_source", "position")

    def ask(self, requests: DataFrame) -> DataFrame:
        """``query_id, reject, prompt, answer, sources`` of ``query_id, question, context``.

        Rejected requests have null answers. With a context the question is rewritten
        for retrieval only; the answer is given to the question as it was asked.
        """
        v = write_through(generate.validate(requests).select("query_id", "question", "context", "reject"), "requests")
        ok = v.where("reject is null")
        if self.rewriter is None:
            ok = ok.withColumn("query", generate.rewrite(F.col("question"), F.col("context")))
        else:
            with_code = apply_model(ok.where("context <> ''"), self.rewriter, ["question", "context"], "query", "string").withColumn("query", F.trim("query"))
            ok = with_code.unionByName(ok.where("context is null or context = ''").withColumn("query", F.col("question")))
        chunk = F.struct("source", "file", "section", "method", "start_line", "end_line", F.col("text").alias("content"), "id")
        chosen = self.retrieve(ok.select("query_id", "query")).drop("source").join(self.corpus, "doc")
        got = chosen.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", chunk.alias("chunk")))).alias("cs"))
        cs = F.transform(F.coalesce("cs", F.array().cast(dict(got.dtypes)["cs"])), lambda x: x["chunk"])
        answered = ok.join(got, "query_id", "left").select(
            "query_id",
            generate.prompt(F.col("question"), generate.context(cs), F.col("context")).alias("prompt"),
            generate.extract_answer(cs).alias("answer"),
            F.transform(cs, lambda c: F.struct(c["id"].alias("id"), c["source"].alias("type"), c["file"].alias("file"), c["section"].alias("section"), c["method"].alias("method"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"))).alias("sources"),
        )
        if self.generator is not None:
            answered = apply_model(answered.drop("answer"), self.generator, ["prompt"], "answer", "string")
        return v.select("query_id", "reject").join(answered, "query_id", "left").select("query_id", "reject", "prompt", "answer", "sources")

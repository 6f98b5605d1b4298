"""Reciprocal-rank fusion, hybrid and multi-source search, source-aware selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.config import RetrievalConfig
from marram.operators import dense, lexical
from marram.operators.models import Embedder, Reranker, apply_model


def fuse(rankings: list[tuple[DataFrame, float]], k: int, top: int | None = None) -> DataFrame:
    """``query_id, doc, score, rank`` from weighted rankings ``query_id, doc, rank``.

    A doc scores ``weight / (k + rank)`` in each ranking it stands in, as often as it
    stands there; ties go to the doc seen first, by ranking and rank. Empty rankings
    give an empty result.
    """
    parts = [r.select("query_id", "doc", F.col("rank").cast("long").alias("r"), F.lit(i).alias("list"), F.lit(float(w)).alias("w")) for i, (r, w) in enumerate(rankings)]
    # rankings arrive partitioned by query, but each in its own way: a union must not pass for one partitioning
    both = reduce(DataFrame.unionByName, parts).repartition("query_id")
    scored = both.groupBy("query_id", "doc").agg(F.round(F.sum(F.col("w") / (k + F.col("r"))), 9).alias("score"), F.min(F.struct("list", "r")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first"), F.col("doc"))
    ranked = scored.select("query_id", "doc", "score", F.row_number().over(w).cast("long").alias("rank"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def hybrid(
    queries: DataFrame,
    corpus: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    embedder: Embedder | None = None,
    index: lexical.Index | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Dense and lexical candidates of ``query_id, query`` in ``doc, text``, fused and cut to the top.

    With a stored ``index`` and stored ``vectors`` (``doc, embedding``) the corpus is not
    read. Ranks are fused on keys alone; texts are joined by the caller where they are needed.
    """
    e = embedder or dense.HashedEmbedder(config.dims)
    q = dense.embed(queries.select(F.col("query_id").alias("doc"), F.col("query").alias("text")), e).withColumnRenamed("doc", "query_id")
    d = dense.search(q, vectors if vectors is not None else dense.embed(corpus, e), config.candidates)
    l = lexical.search(queries, index or corpus, config.candidates, config)
    return fuse([(d, config.dense_weight), (l, config.lexical_weight)], config.rrf_k, config.top_k)


def multi_source(rankings: list[DataFrame], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Rankings of several sources as one, equal weights; no source is cut short."""
    return fuse([(r, 1.0) for r in rankings], config.rrf_k, len(rankings) * config.top_k)


def rerank(candidates: DataFrame, corpus: DataFrame, queries: DataFrame, index: lexical.Index | None = None, model: Reranker | None = None) -> DataFrame:
    """``query_id, doc, score, rank`` of candidates in the order of a model's scores.

    ``candidates``: ``query_id, doc, rank``; ``corpus``: ``doc, text``; ``queries``:
    ``query_id, query``. Ties keep the candidates' order. Without a model a candidate
    scores the share of the query's distinct terms that it holds, weighted by how rare
    they are in the corpus (whose ``index`` may be given).
    """
    if model is None:
        scored = _term_share(candidates, index or lexical.Index.build(corpus), queries)
    else:
        pairs = candidates.select("query_id", "doc", F.col("rank").alias("before")).join(queries.select("query_id", "query"), "query_id").join(corpus.select("doc", "text"), "doc")
        scored = apply_model(pairs, model, ["query", "text"], "score", "double").select("query_id", "doc", "before", "score")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "before")
    return scored.select("query_id", "doc", "score", F.row_number().over(w).cast("long").alias("rank"))


def _term_share(candidates: DataFrame, index: lexical.Index, queries: DataFrame) -> DataFrame:
    q = queries.select("query_id", F.explode(F.array_distinct(lexical.hashed_terms(F.col("query")))).alias("term")).join(index.df, "term", "left")
    weights = q.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", (1.0 / F.log(F.lit(2.0) + F.coalesce("df", F.lit(0)))).alias("w")))).alias("ts"))
    # the terms of texts, much larger than those of questions, move once a text and not once a candidate
    text = candidates.join(weights, "query_id").join(index.forward.select("doc", F.col("terms").alias("have")), "doc")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["w"])
    return text.select(
        "query_id", "doc", F.col("rank").alias("before"), F.round(total(F.filter("ts", lambda x: F.array_contains("have", x["term"]))) / total(F.col("ts")), 9).alias("score")
    )


def select_by_source(ranked: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """The best rows of each source: ``position`` counts sources in the order of ``quotas``.

    ``ranked``: ``query_id, doc, source, score`` and ``tie`` (earlier is better). Rows of
    other sources are left out.
    """
    order = {s: i for i, s in enumerate(quotas)}
    case = lambda m: F.coalesce(*(F.when(F.col("source") == s, v) for s, v in m.items()))
    w = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc(), "tie")
    kept = ranked.withColumn("in_source", F.row_number().over(w)).where(F.col("in_source") <= case(quotas))
    p = Window.partitionBy("query_id").orderBy(case(order), "in_source")
    return kept.withColumn("position", F.row_number().over(p).cast("long")).withColumn("in_source", F.col("in_source").cast("long"))

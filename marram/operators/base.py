"""What a retriever is: a function on frames."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Retriever(Protocol):
    """Ranks a corpus for many queries at once."""

    def search(self, queries: DataFrame, candidates: int, top_k: int) -> DataFrame:
        """``query_id, doc, score, rank`` of the best ``top_k`` for ``query_id, query``."""
        ...


class HybridRetriever:
    """Dense and lexical search over ``doc, text``, fused; index and vectors are made once."""

    def __init__(self, corpus: DataFrame) -> None:
        from marram.operators import dense, lexical
        from marram.storage import write_through

        self.corpus = corpus
        self._index, self._vectors = lexical.Index.build(corpus), write_through(dense.embed(corpus), "vectors")

    def search(self, queries: DataFrame, candidates: int = 50, top_k: int = 10) -> DataFrame:
        from dataclasses import replace

        from marram.config import RetrievalConfig
        from marram.operators.fusion import hybrid

        return hybrid(queries, self.corpus, replace(RetrievalConfig(), candidates=candidates, top_k=top_k), index=self._index, vectors=self._vectors)

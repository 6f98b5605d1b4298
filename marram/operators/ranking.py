"""Keeping the best of many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over a corpus serves; what is broadcast is this many of them.
BLOCK = 4096
#: Scores that a task holds at once.
CELLS = 4_000_000


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Ranks ``query_id, doc, score`` within each query, ties to the smaller ``doc``, and keeps ``k``.

    The filter on the rank is pushed below the exchange, so that each task that reads
    scores passes on ``k`` rows a query at most.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


class Best:
    """The ``k`` best docs of each of ``n`` queries over many matrices of scores, ties to the smaller doc."""

    def __init__(self, n: int, k: int, positive: bool = False) -> None:
        self.n, self.k = n, k
        # the score to beat; what only equals it may still win by name
        self.least = np.full(n, np.nextafter(0.0, 1.0) if positive else -np.inf)
        self.query, self.scores, self.docs = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, docs: list) -> None:
        """Takes up ``scores[query, doc]``; with ``positive``, scores of zero are no hits."""
        if not len(docs):
            return
        names = np.asarray(docs)
        i, j = np.nonzero(scores >= self.least[:, None])
        if len(i) > 4 * self.n * self.k and len(names) > self.k:
            # hardly anything is known yet: the best of this matrix, with all that tie at the end
            end = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            i, j = np.nonzero(scores >= np.maximum(end, self.least)[:, None])
        if not len(i):
            return
        self.take(i, scores[i, j], names[j])

    def take(self, i: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """Takes up single hits: queries, their scores and docs."""
        keep = scores >= self.least[i]
        i, scores, names = i[keep], scores[keep], names[keep]
        if not len(i):
            return
        query, found, doc = np.concatenate([self.query, i]), np.concatenate([self.scores, scores]), names if self.docs is None else np.concatenate([self.docs, names])
        order = np.lexsort((doc, -found, query))
        query = query[order]
        counts = np.bincount(query, minlength=self.n)
        starts = np.cumsum(counts) - counts
        keep = np.arange(len(query)) - starts[query] < self.k
        self.query, self.scores, self.docs = query[keep], found[order][keep], doc[order][keep]
        full = np.flatnonzero(counts >= self.k)
        ends = np.cumsum(np.minimum(counts, self.k)) - 1
        self.least[full] = np.maximum(self.least[full], self.scores[ends[full]])

    def rows(self) -> tuple[np.ndarray, list, np.ndarray]:
        """Query numbers, docs and scores of what was found."""
        return self.query, [] if self.docs is None else self.docs.tolist(), self.scores


def blocks(rows, size: int):
    """Lists of at most ``size`` rows of an iterator."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def pa_type(kind: str) -> pa.DataType:
    """The Arrow type of a key column of Spark's type ``kind``."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, one list after the other, and the length of each list; a null list is empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many tasks as there are cores at least.

    Costly narrow stages over a table of fewer splits than cores would leave cores idle;
    tables of many splits, which is what large ones are, stay where they lie. Plans that
    move their rows already are left alone.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Join", "Aggregate", "Repartition", "Window", "Sort", "Distinct", "Union", "LogicalRDD", "Limit")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

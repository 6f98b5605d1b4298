"""Lexical index and search (BM25, Lucene's variant)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.config import RetrievalConfig
from marram.functions.text import terms
from marram.operators import jvm, scan
from marram.operators.ranking import flat, pa_type, spread, top_k
from marram.storage import write_through


def postings(corpus: DataFrame) -> DataFrame:
    """``term, doc, tf, dl`` of ``doc, text``; texts without terms have no postings.

    Terms are exploded and counted; the counts are combined before they move.
    """
    t = corpus.select("doc", terms(F.col("text")).alias("ts"))
    exploded = t.select("doc", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term"))
    return exploded.groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc", "tf", "dl")


def hashed_terms(c: Column) -> Column:
    """64-bit hashes of the index terms of a text."""
    return F.transform(terms(c), lambda t: F.xxhash64(t))


class Index:
    """A lexical index: built once, kept as tables, searched many times.

    ``forward``: ``doc, terms, tfs, dl`` with the hashes of a text's distinct terms and
    their counts, sorted by hash; ``df``: ``term, df``; ``n`` and ``avgdl`` over all texts
    with or without terms. Terms are known by 64-bit hashes.
    """

    def __init__(self, forward: DataFrame, df: DataFrame, n: int, avgdl: float) -> None:
        self.forward, self.df, self.n, self.avgdl = forward, df, n, avgdl

    @classmethod
    def build(cls, corpus: DataFrame, path: str | None = None) -> "Index":
        """The index of ``doc, text``, written below ``path`` or into the shared folder. Null texts have no entry."""
        spark = corpus.sparkSession
        kind = dict(corpus.dtypes)["doc"]
        types = pa_type(kind)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hashes, sizes = flat(b.column(1))
                doc = np.repeat(np.arange(b.num_rows), sizes)
                order = np.lexsort((hashes, doc))
                h, d = hashes[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.empty(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(d[first], minlength=b.num_rows))]).astype(np.int32)
                tf = np.diff(np.concatenate([first, [len(h)]])).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (h[first], tf))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(types), *lists, pa.array(sizes, pa.int32())], names=["doc", "terms", "tfs", "dl"])

        given = spread(corpus.where("text is not null").select("doc", "text")).select("doc", hashed_terms(F.col("text")).alias("ts"))
        forward = given.mapInArrow(count, f"doc {kind}, terms array<long>, tfs array<int>, dl int")
        if path is None:
            forward = write_through(forward, "index-forward")
        else:
            forward.write.mode("overwrite").parquet(f"{path}/forward")
            forward = spark.read.parquet(f"{path}/forward")
        df = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        if path is None:
            df = write_through(df, "index-df")
        else:
            df.write.mode("overwrite").parquet(f"{path}/df")
        return cls.load(spark, path) if path else cls._with_statistics(forward, df)

    @classmethod
    def _with_statistics(cls, forward: DataFrame, df: DataFrame) -> "Index":
        r = forward.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).first()
        return cls(forward, df, r["n"], r["dl"] / r["n"] if r["n"] else 0.0)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Index":
        """The index that :meth:`build` wrote below ``path``."""
        return cls._with_statistics(spark.read.parquet(f"{path}/forward"), spark.read.parquet(f"{path}/df"))

    def weighted(self, queries: DataFrame) -> DataFrame:
        """``query_id, ts, ws, dfs``: hashes of each query's terms that the index has, with count times rarity and texts that hold them."""
        q = queries.select("query_id", F.explode(hashed_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        idf = F.log(1.0 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        w = q.join(self.df, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("qtf") * idf).alias("w"), "df"))).alias("t"))
        return w.select("query_id", F.col("t.term").alias("ts"), F.col("t.w").alias("ws"), F.col("t.df").alias("dfs"))


def as_index(corpus: DataFrame | Index) -> Index:
    return corpus if isinstance(corpus, Index) else Index.build(corpus)


class _Asks:
    """The weighted queries of a task: their terms as numbers in ``terms``, the sorted hashes, and the plan of their sums."""

    def __init__(self, batch: pa.RecordBatch, n: int) -> None:
        hashes, self.sizes = flat(batch.column(1))
        self.weights, df = flat(batch.column(2))[0], flat(batch.column(3))[0]
        self.terms, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # hashes by their upper sixteen bits: most places hold one term at most, so that no search is needed
        self.upper = np.searchsorted(self.terms >> 48, np.arange(-32768, 32769)).astype(np.int32)
        # a row for all texts is added faster than more than so many places
        df = df[first]
        whole = np.zeros(len(df), bool)
        whole[np.argsort(-df, kind="stable")[: scan.ROWS]] = True
        self.plan = scan.Plan(self.at, self.weights, self.sizes, whole & (df > n / 24))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms here, in their order, and the terms' numbers."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        upper = (hashes >> 48) + 32768
        first, several = self.upper[upper], self.upper[upper + 1]
        several -= first
        hit = np.flatnonzero(several)
        h, at = hashes[hit], first[hit].astype(np.int64)
        more = np.flatnonzero((several[hit] > 1) & (self.terms[at] != h))
        at[more] = np.minimum(np.searchsorted(self.terms, h[more]), len(self.terms) - 1)
        same = np.flatnonzero(self.terms[at] == h)
        return hit[same], at[same]


class _Tile:
    """Some rows of the forward table, by term."""

    def __init__(self, batch: pa.RecordBatch, asks: _Asks, avgdl: float, config: RetrievalConfig) -> None:
        self.asks, self.names = asks, np.asarray(batch.column(0).to_pylist())
        hashes, sizes = flat(batch.column(1))
        hit, term = asks.find(hashes)
        # sixteen bits are sorted by counting
        order = np.argsort(term.astype(np.uint16) if len(asks.terms) <= 65536 else term, kind="stable")
        term, self.docs = term[order], np.repeat(np.arange(batch.num_rows), sizes)[hit][order]
        tf = flat(batch.column(2))[0][hit][order].astype(np.float64)
        dl = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        self.impact = _impact(tf, dl[self.docs], avgdl, config)
        self.largest = self.impact.max(initial=0.0)
        self.edges = np.searchsorted(term, np.arange(len(asks.terms) + 1)).tolist()
        self.keys = term * np.int64(batch.num_rows) + self.docs
        self.values = (self.impact * asks.plan.unit[term]).astype(np.float32)
        self._rows: dict[int, np.ndarray] = {}

    def sparse(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.edges[term], self.edges[term + 1])
        return self.docs[s], self.values[s]

    def rows(self, term: int) -> np.ndarray:
        if term not in self._rows:
            where, values = self.sparse(term)
            self._rows[term] = row = np.zeros(len(self.names), np.float32)
            row[where] = values
        return self._rows[term]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a text; terms are added in the order of their hashes."""
        out, a = np.zeros(len(i)), self.asks
        for s in range(0, len(i) if len(self.keys) else 0, 200_000):
            q, n = i[s : s + 200_000], a.sizes[i[s : s + 200_000]]
            pair = np.repeat(np.arange(len(q)), n)
            at = np.arange(len(pair)) + np.repeat(a.starts[q] - (np.cumsum(n) - n), n)
            key = a.at[at] * np.int64(len(self.names)) + j[s : s + 200_000][pair]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[s : s + len(q)] = np.bincount(pair[hit], weights=a.weights[at[hit]] * self.impact[place[hit]], minlength=len(q))
        return np.round(out, 9)


def _impact(tf, dl, avgdl: float, config: RetrievalConfig):
    return tf / (tf + config.bm25_k1 * (1.0 - config.bm25_b + config.bm25_b * dl / avgdl))


def _tiles(files: list[str], asks: _Asks, avgdl: float, config: RetrievalConfig) -> Iterator[_Tile]:
    for b in scan.tiles(files, ["doc", "terms", "tfs", "dl"]):
        yield _Tile(b, asks, avgdl, config)


def _tile(batch: pa.RecordBatch) -> bytes | None:
    """Rows of the forward table as the JVM reads them."""
    if batch.column(0).null_count:
        return None
    (hashes, sizes), tfs = flat(batch.column(1)), flat(batch.column(2))[0]
    return jvm.pack(batch.num_rows, len(hashes), batch.column(0).to_numpy(zero_copy_only=False), hashes, sizes.astype(np.int32), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int32), tfs.astype(np.int32))


def _asks(batch: pa.RecordBatch) -> bytes:
    """Weighted queries, with their goals if there are any, as the JVM reads them."""
    hashes, sizes = flat(batch.column(1))
    terms, at = np.unique(hashes, return_inverse=True)
    n, starts = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    # neighbours share their most frequent terms, whose postings then lie in a cache
    often = np.bincount(at, minlength=len(terms))
    ranked = np.append(at[np.lexsort((at, -often[at], np.repeat(np.arange(n), sizes)))], -1)
    order = np.lexsort([np.where(sizes > d, ranked[np.minimum(starts[:-1] + d, len(at))], -1) for d in (2, 1, 0)])
    goals = (batch.column(5).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)) if batch.num_columns > 4 else ()
    return jvm.pack(n, len(terms), len(at), terms, flat(batch.column(2))[0], *goals, *(x.astype(np.int32) for x in (starts, order, at)))


def _scanned(index: Index) -> list[str] | None:
    """The index as tiles for the JVM, where it can be used."""
    if dict(index.forward.dtypes)["doc"] != "bigint" or not jvm.ready(index.forward.sparkSession):
        return None
    return jvm.kept(index.forward.select("doc", "terms", "tfs", "dl"), sorted(index.forward.inputFiles()), "index-tiles", _tile)


def search(queries: DataFrame, corpus: DataFrame | Index, k: int, config: RetrievalConfig = RetrievalConfig(), block: int = scan.GROUP) -> DataFrame:
    """Best ``k`` texts of each query: ``query_id, doc, score, rank``.

    ``queries``: ``query_id, query``; ``corpus``: an :class:`Index`, or ``doc, text``, of
    which one is built. A query term counts as often as it stands in the query. Texts
    that share no term are left out. Ties go to the smaller ``doc``.

    Queries are weighted by a join of terms and spread over the tasks, at most ``block``
    each; a task reads the forward table (:mod:`marram.operators.scan`). Matches of
    queries and texts, which grow with both, so never move: only ``k`` rows a query do.
    """
    index = as_index(corpus)
    kinds = dict(queries.dtypes)["query_id"], dict(index.forward.dtypes)["doc"]
    types, avgdl, total = tuple(pa_type(x) for x in kinds), index.avgdl, index.n

    def make(files: list[str]):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            asks = _Asks(batch, total)
            i, docs, scores = scan.best_of(asks.plan, k, True, _tiles(files, asks, avgdl, config)).rows()
            if docs:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)).cast(types[0]), pa.array(docs, types[1]), pa.array(scores)], names=["query_id", "doc", "score"])

        return run

    if (files_ := _scanned(index)) is not None:
        return top_k(jvm.over(index.weighted(queries), files_, jvm.BEST, k, (config.bm25_k1, config.bm25_b, avgdl), _asks, kinds[1], block), k)
    ddl = f"query_id {kinds[0]}, doc {kinds[1]}, score double"
    return top_k(scan.over(index.weighted(queries), scan.files_of(index.forward, "index-forward"), ddl, make, block), k)


def first_ranks(queries: DataFrame, corpus: DataFrame | Index, relevant: DataFrame, config: RetrievalConfig = RetrievalConfig(), block: int = scan.GROUP) -> DataFrame:
    """Rank of each query's best relevant text among all texts: ``query_id, first_rank``.

    ``relevant``: ``query_id, doc``; order and texts left out are those of :func:`search`
    at any depth, so queries none of whose relevant texts shares a term have no row.

    No ranking is made: the relevant texts of all queries are scored first, and a pass
    over all texts counts those that stand before the best one of each query that has one.
    """
    index = as_index(corpus)
    kinds = dict(queries.dtypes)["query_id"], dict(index.forward.dtypes)["doc"]
    types, avgdl, total = pa_type(kinds[0]), index.avgdl, index.n
    asked = write_through(index.weighted(queries), "weighted")
    pairs = relevant.select("query_id", "doc").distinct().join(asked.drop("dfs"), "query_id").join(index.forward, "doc")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ends = (flat(b.column(x))[0] for x in (2, 3)), np.cumsum(flat(b.column(2))[1])
            (ts, ws), (have, tfs), stops = own, (flat(b.column(x))[0] for x in (4, 5)), np.cumsum(flat(b.column(4))[1])
            dl, scores, s, t = b.column(6).to_pylist(), [], 0, 0
            for e, u, d in zip(ends.tolist(), stops.tolist(), dl):
                held = have[t:u]
                at = np.minimum(np.searchsorted(held, ts[s:e]), max(u - t - 1, 0))
                hit = held[at] == ts[s:e] if u > t else np.zeros(e - s, bool)
                scores.append(sum((ws[s:e][hit] * _impact(tfs[t:u][at[hit]].astype(np.float64), float(d), avgdl, config)).tolist()) if hit.any() else 0.0)
                s, t = e, u
            keep = pa.array(np.flatnonzero(scores := np.round(np.array(scores), 9)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(scores).take(keep)], names=["query_id", "doc", "score"])

    judged = pairs.select("query_id", "doc", "ts", "ws", "terms", "tfs", "dl").mapInArrow(judge, f"query_id {kinds[0]}, doc {kinds[1]}, score double")
    best = judged.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc")).alias("b")).select("query_id", F.col("b.doc").alias("goal"), (-F.col("b.s")).alias("score"))

    def make(files: list[str]):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            asks = _Asks(batch, total)
            n = scan.before(asks.plan, batch.column(5).to_numpy(zero_copy_only=False), np.asarray(batch.column(4).to_pylist()), _tiles(files, asks, avgdl, config))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(types), pa.array(n)], names=["query_id", "n"])

        return run

    goals = asked.join(best, "query_id").select(*asked.columns, "goal", "score")
    if (files_ := _scanned(index)) is not None:
        out = jvm.over(goals, files_, jvm.BEFORE, 0, (config.bm25_k1, config.bm25_b, avgdl), _asks, kinds[1], block)
    else:
        out = scan.over(goals, scan.files_of(index.forward, "index-forward"), f"query_id {kinds[0]}, n long", make, block)
    return out.groupBy("query_id").agg((F.sum("n") + 1).alias("first_rank"))

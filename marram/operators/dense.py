"""Dense vectors: a deterministic embedder and exact search by blocks of queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions.text import terms
from marram.operators import jvm, scan
from marram.operators.ranking import BLOCK, CELLS, blocks, flat, pa_type, spread, top_k

# fixed values: how queries are put to models of these families
QUERY_FORMATS = {"raw": "{q}", "prefix": "Represent this sentence for searching relevant passages: {q}", "instruct": "Instruct: {i}\nQuery: {q}"}

#: A vector's least value may be so many times the number that all its values are multiples of.
PARTS = 8
#: Vectors whose multiples are at most this stand together: so many times as there are terms in most questions stay within 8 bits.
FEW = 10


def format_query(style: str, query, instruction: str = "Retrieve passages that answer the question."):
    """The query column in the form a model family expects."""
    before, after = QUERY_FORMATS[style].replace("{i}", instruction).split("{q}")
    return F.concat(F.lit(before), query, F.lit(after))


class HashedEmbedder:
    """Feature hashing of index terms into ``dims`` signed counts, of length one.

    A stand-in with the interface of a model (:class:`marram.operators.models.Embedder`).
    """

    reads = "terms"

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def make(self) -> Callable[[list[list[str]]], np.ndarray]:
        known: dict[str, tuple[int, int]] = {}

        def at(t: str) -> tuple[int, int]:
            if t not in known:
                if len(known) > 500_000:
                    known.clear()
                h = hashlib.md5(t.encode()).hexdigest()
                known[t] = (int(h[:8], 16) % self.dims, 1 if int(h[8], 16) % 2 == 0 else -1)
            return known[t]

        def embed(texts: list[list[str]]) -> np.ndarray:
            out = np.zeros((len(texts), self.dims))
            for i, ts in enumerate(texts):
                for t in ts:
                    j, sign = at(t)
                    out[i, j] += sign
            return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)[:, None]

        return embed


def embed(rows: DataFrame, embedder: HashedEmbedder = HashedEmbedder()) -> DataFrame:
    """``doc, embedding`` of ``doc, text``; texts without terms get a zero vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = embedder.make()
        for b in batches:
            v = np.asarray(f([x or [] for x in b.column(1).to_pylist()]), np.float64)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(v.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["doc", "embedding"])

    key = dict(rows.dtypes)["doc"]
    given = spread(rows.select("doc", "text"))
    read = F.coalesce("text", F.lit("")) if getattr(embedder, "reads", "terms") == "text" else terms(F.col("text"))
    return given.select("doc", read.alias("given")).mapInArrow(run, f"doc {key}, embedding array<double>")


class _Tile:
    """Some vectors, by dimension."""

    def __init__(self, batch: pa.RecordBatch, asked: np.ndarray) -> None:
        self.names, self.asked = np.asarray(batch.column(0).to_pylist()), asked
        self.vectors = flat(batch.column(1))[0].reshape(batch.num_rows, -1)
        self.largest = float(max(self.vectors.max(initial=0.0), -self.vectors.min(initial=0.0)))
        # of each vector the number that all its values are whole multiples of, if they are
        units, whole, self.units, self._rows = np.ones(batch.num_rows), np.empty(self.vectors.shape, np.int8), None, {}
        self.most, self.order = 0.0, None
        for s in range(0, batch.num_rows, 8192):
            v = self.vectors[s : s + 8192]
            units[s : s + 8192] = u = np.where(np.any(v, axis=1), np.where(v == 0, np.inf, np.abs(v)).min(axis=1, initial=np.inf), 1.0)
            near = np.rint(v / u[:, None])
            off = np.flatnonzero((np.abs(v / u[:, None] - near) > 1e-12 * np.abs(near)).any(axis=1))
            # the least value may itself be a few times the number
            for d in range(2, PARTS + 1):
                if len(off):
                    times = v[off] / (u[off, None] / d)
                    good = (np.abs(times - np.rint(times)) <= 1e-12 * np.abs(times)).all(axis=1)
                    near[off[good]] = np.rint(times[good])
                    units[s + off[good]] /= d
                    off = off[~good]
            self.most = max(self.most, float(np.abs(near).max(initial=0.0)))
            if len(off) or self.most > 127:
                break
            whole[s : s + 8192] = near
        else:
            self.order = np.argsort(-units, kind="stable")
            self.units, self.names, self.whole = units[self.order], self.names[self.order], np.ascontiguousarray(whole[self.order].T)

    def rows(self, dim: int) -> np.ndarray:
        if dim not in self._rows:
            v = self.vectors[:, dim].astype(np.float32)
            self._rows[dim] = v if self.order is None else v[self.order]
        return self._rows[dim]

    def multiples(self, dim: int, kind) -> np.ndarray:
        """The values as multiples of each vector's number."""
        if kind == np.int8:
            return self.whole[dim]
        if (dim, kind) not in self._rows:
            self._rows[dim, kind] = self.whole[dim].astype(kind)
        return self._rows[dim, kind]

    #: every dimension has a row for all vectors
    sparse = None

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Inner products of pairs of a query and a vector."""
        j = j if self.order is None else self.order[j]
        parts = (np.einsum("ij,ij->i", self.asked[i[s : s + 50_000]], self.vectors[j[s : s + 50_000]]) for s in range(0, len(i), 50_000))
        return np.round(np.concatenate([*parts, np.empty(0)]), 9)


def _plan(asked: np.ndarray) -> scan.Plan:
    """Sums of the filled dimensions of each query, as multiples of its smallest value: counts of a few terms are ones."""
    filled = asked != 0
    scale = np.where(filled, np.abs(asked), np.inf).min(axis=1, initial=np.inf)
    scale[~np.isfinite(scale)] = 1.0
    i, at = np.nonzero(filled)
    return scan.Plan(at, asked[i, at] / scale[i], filled.sum(axis=1), np.ones(asked.shape[1], bool), scale, units=False)


def _units(batch: pa.RecordBatch) -> bytes | None:
    """Vectors as multiples of a number each, as the JVM reads them; None if they are no such."""
    batch = batch.filter(batch.column(1).is_valid())
    t = _Tile(batch, np.empty(0))
    if t.order is None or batch.column(0).null_count:
        return None
    v = t.vectors[t.order].T
    # scores are made from the multiples, so these must be the values but for their last bits
    if (np.abs(t.whole * t.units - v) > 2e-15 * np.abs(v)).any():
        return None
    # the few vectors with large multiples apart, as they would take all others out of 8 bits
    most = np.abs(t.whole).max(axis=0, initial=0)
    parts = [x for x in (np.flatnonzero(most <= FEW), np.flatnonzero(most > FEW)) if len(x)]
    return jvm.pack(len(parts)) + b"".join(jvm.pack(len(x), len(t.whole), float(most[x].max()), t.largest, t.names[x], t.units[x], t.whole[:, x]) for x in parts)


def _asks(batch: pa.RecordBatch) -> bytes:
    """The filled dimensions of queries, as they are and as multiples of a query's smallest value."""
    asked = flat(batch.column(1))[0].reshape(batch.num_rows, -1)
    filled = asked != 0
    i, dim = np.nonzero(filled)
    scale = np.where(filled, np.abs(asked), np.inf).min(axis=1, initial=np.inf)
    scale[~np.isfinite(scale)] = 1.0
    exactly = asked[i, dim] / scale[i]
    times = np.bincount(i, weights=np.abs(exactly), minlength=len(asked))
    broken = np.bincount(i, weights=np.abs(exactly - np.rint(exactly)) > 2e-15 * np.abs(exactly), minlength=len(asked))
    starts = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
    whole = np.clip(np.rint(exactly), -128, 128)
    return jvm.pack(len(asked), len(dim), asked[i, dim], scale, times, *(x.astype(np.int32) for x in (starts, dim, whole)), (broken == 0).astype(np.int8))


def search(queries: DataFrame, vectors: DataFrame, k: int, block: int = scan.GROUP) -> DataFrame:
    """Exact best ``k`` vectors of each query by inner product: ``query_id, doc, score, rank``.

    ``queries``: ``query_id, embedding``; ``vectors``: ``doc, embedding``. Queries are
    spread over the tasks, at most ``block`` each, and a task reads the stored vectors
    (:mod:`marram.operators.scan`), so only ``k`` rows a query move. Ties go to the
    smaller ``doc``. Null vectors are left out.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc"]
    types = tuple(pa_type(x) for x in kinds)
    if dict(vectors.dtypes)["embedding"] != "array<double>":
        vectors = vectors.select("doc", F.col("embedding").cast("array<double>").alias("embedding"))

    def make(files: list[str]):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            asked = flat(batch.column(1))[0].reshape(batch.num_rows, -1)

            def tiles() -> Iterator[_Tile]:
                for b in scan.tiles(files, ["doc", "embedding"]):
                    b = b.filter(b.column(1).is_valid())
                    if b.num_rows:
                        yield _Tile(b, asked)

            i, docs, scores = scan.best_of(_plan(asked), k, False, tiles()).rows()
            if docs:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)).cast(types[0]), pa.array(docs, types[1]), pa.array(scores)], names=["query_id", "doc", "score"])

        return run

    given, files_ = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), scan.files_of(vectors, "vectors")
    if kinds[1] == "bigint" and jvm.ready(vectors.sparkSession):
        stored = vectors.sparkSession.read.schema(vectors.select("doc", "embedding").schema).parquet(*files_) if files_ else vectors
        tiles_ = jvm.kept(stored.select("doc", "embedding"), files_, "vector-tiles", _units)
        if tiles_ is not None:
            return top_k(jvm.over(given, tiles_, jvm.NEAREST, k, (0.0, 0.0, 0.0), _asks, kinds[1], block), k)
    return top_k(scan.over(given, files_, f"query_id {kinds[0]}, doc {kinds[1]}, score double", make, block), k)


def first_ranks(queries: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rank of the best other vector of a query's label among all other vectors: ``query_id, first_rank``.

    ``queries``: ``query_id, embedding, label``; ``vectors``: ``doc, embedding, label``,
    with ``query_id`` as a query's own ``doc``. Order and null vectors are as in
    :func:`search`, whatever the depth: one pass finds the best vector of the label, one
    counts those before it. Queries without another vector of their label have no row.
    """
    spark = vectors.sparkSession
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc"]
    given = spread(vectors.where("embedding is not null").select("doc", F.col("embedding").cast("array<double>").alias("embedding"), "label"))
    types = pa_type(kinds[0]), pa_type(kinds[1])
    out, ddl = None, f"query_id {kinds[0]}, n long"

    def one(rows: list) -> DataFrame:
        number: dict = {}
        labels = np.array([-2 if r["label"] is None else number.setdefault(r["label"], len(number)) for r in rows])
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), labels, number))

        def parts(batches: Iterator[pa.RecordBatch]):
            """Docs, scores and labels of few vectors at a time; a query's own score is below all others."""
            ids, q, _, number_ = sent.value
            at_ = {x: i for i, x in enumerate(ids)}
            step = max(1, CELLS // len(ids))
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    docs = part.column(0).to_pylist()
                    scores = np.round(q @ flat(part.column(1))[0].reshape(len(docs), -1).T, 9)
                    for j, d in enumerate(docs):
                        if d in at_:
                            scores[at_[d], j] = -np.inf
                    yield docs, scores, np.array([number_.get(x, -1) for x in part.column(2).to_pylist()])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, _, labels_, _ = sent.value
            best: dict = {}
            for docs, scores, of in parts(batches):
                scores = np.where(labels_[:, None] == of, scores, -np.inf)
                top = scores.max(axis=1, initial=-np.inf)
                for i, j in zip(*np.nonzero((scores == top[:, None]) & (top > -np.inf)[:, None])):
                    best[i] = min(best.get(i, (np.inf, None)), (-top[i], docs[j]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in best], types[0]), pa.array([d for _, d in best.values()], types[1]), pa.array([float(s) for s, _ in best.values()], pa.float64())],
                names=["query_id", "doc", "s"],
            )

        judged = given.mapInArrow(judge, f"query_id {kinds[0]}, doc {kinds[1]}, s double")
        goal = spark.sparkContext.broadcast(
            {r["query_id"]: (-r["b"]["s"], r["b"]["doc"]) for r in judged.groupBy("query_id").agg(F.min(F.struct("s", "doc")).alias("b")).toLocalIterator()}
        )

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = sent.value[0]
            goals = [goal.value.get(q, (np.inf, None)) for q in ids]
            least, n = np.array([s for s, _ in goals])[:, None], np.zeros(len(ids), np.int64)
            for docs, scores, _ in parts(batches):
                n += (scores > least).sum(axis=1)
                for i, j in zip(*np.nonzero(scores == least)):
                    n[i] += docs[j] < goals[i][1]
            own = [i for i, q in enumerate(ids) if q in goal.value]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own], types[0]), pa.array(n[own], pa.int64())], names=["query_id", "n"])

        return given.mapInArrow(count, ddl)

    for held in blocks(queries.where("embedding is not null").select("query_id", "embedding", "label").toLocalIterator(), block):
        out = one(held) if out is None else out.unionByName(one(held))
    out = out if out is not None else spark.createDataFrame([], ddl)
    return out.groupBy("query_id").agg((F.sum("n") + 1).alias("first_rank"))

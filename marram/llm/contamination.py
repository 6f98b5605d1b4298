"""Evaluation texts leaking into training text.

Method: latent semantic retrieval. Passages are the maximal runs of words that occur in
evaluation texts (a shared passage lies inside such a run, so nothing is lost), cut
into overlapping windows. Their TF-IDF matrix, weighted by document frequencies over
all documents, is factorised by a distributed randomised SVD: tasks multiply their rows
with a small random matrix, the sums, whose size depends on the evaluation vocabulary
only, are orthogonalised on the driver, and power iterations repeat this. Windows whose
latent cosine to a window of an evaluation item is high are candidates; a longest run
and a longest common subsequence of words then tell verbatim leaks from paraphrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.counts import _SLICES, add_up, pack_part, task_number
from marram.llm.words import WORD
from marram.operators.ranking import spread
from marram.storage import write_through


@dataclass(frozen=True)
class LeakSearch:
    """Parameters of the search.

    ``min_run``: evaluation words a passage, and a window of it, needs; ``bridge``: other
    words in a row that a passage may step over (none: all its words are evaluation
    words, which loses no verbatim leak); ``window``/``step``: words
    of a document window and how far apart windows start, so that any ``window - step +
    1`` words lie inside one; ``query``/``query_step``: the same for items; ``rank``,
    ``oversample``, ``power``: of the SVD; ``cosine``: least latent cosine of candidates;
    ``items_a_pass``: items searched in one pass, more are searched in further passes.
    """

    min_run: int = 13
    bridge: int = 0
    window: int = 20
    step: int = 8
    query: int = 13
    query_step: int = 3
    rank: int = 96
    oversample: int = 16
    power: int = 1
    cosine: float = 0.6
    seed: int = 7
    items_a_pass: int = 4096


@dataclass
class Items:
    """Evaluation items of one pass: ids, words as vocabulary numbers, and the vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int] = field(default_factory=dict)


def read_items(rows: list[tuple[int, str | None]]) -> Items:
    """Items with at least one word; repeated ids are joined as separate texts."""
    vocabulary: dict[str, int] = {}
    ids, words = [], []
    for i, text in rows:
        ws = WORD.findall((text or "").lower())
        if i is None or not ws:
            continue
        ids.append(i)
        words.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int32))
    return Items(ids, words, vocabulary)


_PASSAGES = "doc_id long, words binary, df binary"


def passages(documents: DataFrame, key: str, column: str, items: Items, p: LeakSearch) -> DataFrame:
    """Runs of evaluation words in all documents, and document frequencies of these words.

    One pass over the texts gives both: rows with ``words`` are passages, rows with
    ``df`` hold one task's counts (``df[0]`` counts its documents).
    """
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)
    size = len(items.vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("df", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        df = np.zeros(size + 1, np.int64)
        for b in batches:
            docs, found = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                df[0] += 1
                if not text:
                    continue
                w = np.array([number.get(x, -1) for x in WORD.findall(text.lower())], np.int32)
                inside = w >= 0
                df[np.unique(w[inside]) + 1] += 1
                edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                starts, ends = edges[::2], edges[1::2]
                if p.bridge and len(starts):
                    apart = np.flatnonzero(starts[1:] - ends[:-1] > p.bridge)
                    starts, ends = starts[np.concatenate([[0], apart + 1])], ends[np.concatenate([apart, [len(ends) - 1]])]
                    w[~inside] = size  # other words have a number without weight
                words = np.concatenate([[0], np.cumsum(inside)])
                for s, e in zip(starts, ends):
                    if words[e] - words[s] >= p.min_run:
                        docs.append(i)
                        found.append(w[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.binary()), pa.nulls(len(docs), pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], schema=schema)

    given = documents.select(F.col(key).cast("long"), F.col(column).cast("string"))
    return write_through(spread(given).mapInArrow(run, _PASSAGES), "passages")


def _sum(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], size: int, dtype: type) -> np.ndarray:
    """Sum over all rows of a vector of fixed size: per task, then slice by slice over tasks in streams."""
    edges = np.linspace(0, size, min(_SLICES, size) + 1).astype(np.int64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, total = make(), np.zeros(size, dtype)
        for b in batches:
            if b.num_rows:
                total += f(b)
        for k, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
            if total[s:e].any():
                yield pack_part(k, task_number(), total[s:e])

    out = np.zeros(size, dtype)
    for k, x in add_up(df.mapInArrow(local, "slice int, part int, counts binary"), dtype).items():
        out[edges[k] : edges[k + 1]] = x
    return out


def _windows(n: int, width: int, step: int) -> np.ndarray:
    """Starts of windows that cover ``n`` words, the last one flush with the end."""
    if n <= width:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - width + step, step)
    return np.unique(np.minimum(s, n - width))


def _cut(texts: list[np.ndarray], width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some texts as a matrix padded with -1, and the text of each."""
    owner, rows = [], []
    for k, w in enumerate(texts):
        for s in _windows(len(w), width, step):
            x = w[s : s + width]
            rows.append(x if len(x) == width else np.concatenate([x, np.full(width - len(x), -1, w.dtype)]))
            owner.append(k)
    return (np.array(rows, np.int64).reshape(len(rows), width), np.array(owner, np.int64))


#: Windows that are multiplied at once; a very long text has many.
_ROWS = 2048


class Weights:
    """TF-IDF rows of windows, as sparse as they are: a window has at most its width of terms."""

    def __init__(self, idf: np.ndarray) -> None:
        self._idf = np.concatenate([idf, [0.0]])  # the last one is padding

    def scales(self, w: np.ndarray) -> np.ndarray:
        """Weight of each word of each window, so that a row has length one.

        A word that stands c times in a window gets weight c * idf by being added c times.
        """
        v = self._idf[w]
        # squared length of the summed row: words that are equal add up
        same = (w[:, :, None] == w[:, None, :]) & (w[:, :, None] >= 0)
        length = np.sqrt(np.einsum("ij,ijk,ik->i", v, same, v))
        return v / np.maximum(length, 1e-12)[:, None]

    def times(self, w: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Rows times a matrix with one row per term, a bounded number of rows at a time."""
        padded = np.concatenate([m, np.zeros((1, m.shape[1]), m.dtype)])
        out = np.empty((len(w), m.shape[1]))
        for at in range(0, len(w), _ROWS):
            x = w[at : at + _ROWS]
            out[at : at + _ROWS] = np.einsum("ij,ijk->ik", self.scales(x), padded[x])
        return out

    def transposed_times(self, w: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
        """Transposed rows times a matrix with one row per window."""
        out = np.zeros((terms + 1, y.shape[1]))
        for at in range(0, len(w), _ROWS):
            x, part = w[at : at + _ROWS], y[at : at + _ROWS]
            s = self.scales(x)
            for j in range(w.shape[1]):
                np.add.at(out, x[:, j], s[:, j, None] * part)
        return out[:-1]


def latent_space(found: DataFrame, items: Items, idf: np.ndarray, p: LeakSearch) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the leading right singular vectors.

    The matrix is that of all passages, with the windows of the items below it, weighted
    so that both parts have the same mass. Each pass over the passages moves one
    ``terms x (rank + oversample)`` matrix per task.
    """
    spark = found.sparkSession
    terms = len(idf)
    width = min(p.rank + p.oversample, terms)
    weights = Weights(idf)
    mine, _ = _cut(items.words, p.query, p.query_step)
    rows = found.where("words is not null").select("words")

    def gram(m: np.ndarray) -> np.ndarray:
        """Aᵀ A m over all rows; the last column of the sum counts the rows."""
        sent = spark.sparkContext.broadcast((m, idf))

        def make():
            m_, idf_ = sent.value
            wt = Weights(idf_)

            def f(b: pa.RecordBatch) -> np.ndarray:
                out = np.zeros((terms, m_.shape[1] + 1))
                texts = [np.frombuffer(x, np.int32) for x in b.column(0).to_pylist()]
                for at in range(0, len(texts), 2000):
                    w, _ = _cut(texts[at : at + 2000], p.window, p.window)
                    out[:, :-1] += wt.transposed_times(w, wt.times(w, m_), terms)
                    out[0, -1] += len(w)
                return out.ravel()

            return f

        total = _sum(rows, make, terms * (m.shape[1] + 1), np.float64).reshape(terms, -1)
        n = total[0, -1]
        own = weights.transposed_times(mine, weights.times(mine, m), terms)
        return total[:, :-1] + own * (max(n, 1.0) / max(len(mine), 1))

    q, _ = np.linalg.qr(gram(np.random.default_rng(p.seed).standard_normal((terms, width))))
    for _ in range(p.power):
        z = gram(q)
        q, _ = np.linalg.qr(z)
    # Rayleigh and Ritz: the leading directions inside the range found
    small = q.T @ gram(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(values)[::-1][: p.rank]]


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest shared run and longest common subsequence of many pairs of texts at once.

    ``a`` and ``b`` hold one text a row, as word numbers padded with -1 and -2. The
    tables of both programs are filled row by row for all pairs together.
    """
    n, width = b.shape
    run, best = np.zeros((n, width + 1), np.int16), np.zeros(n, np.int16)
    lcs = np.zeros((n, width + 1), np.int16)
    for j in range(a.shape[1]):
        hit = b == a[:, j : j + 1]
        run[:, 1:] = np.where(hit, run[:, :-1] + 1, 0)
        best = np.maximum(best, run.max(axis=1))
        grown = np.where(hit, lcs[:, :-1] + 1, lcs[:, 1:])
        lcs[:, 1:] = np.maximum.accumulate(np.maximum(grown, lcs[:, 1:]), axis=1)
    return best.astype(np.int32), lcs[:, -1].astype(np.int32)


_LEAKS = "doc_id long, item_id long, cosine double, longest_run int, common int, lcs_share double"


def _search(documents: DataFrame, key: str, column: str, items: Items, p: LeakSearch) -> DataFrame:
    spark = documents.sparkSession
    found = passages(documents, key, column, items, p)
    counts = _sum(
        found.where("df is not null").select("df"),
        lambda: lambda b: sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in b.column(0)),
        len(items.vocabulary) + 1,
        np.int64,
    )
    idf = np.log((1.0 + counts[0]) / (1.0 + counts[1:])) + 1.0
    basis = latent_space(found, items, idf, p)
    queries, owner = _cut(items.words, p.query, p.query_step)
    latent = Weights(idf).times(queries, basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
    sent = spark.sparkContext.broadcast((basis.astype(np.float32), idf, latent.astype(np.float32), owner, items.ids, items.words))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("longest_run", pa.int32()), ("common", pa.int32()), ("lcs_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis_, idf_, latent_, owner_, ids, words = sent.value
        wt = Weights(idf_)
        ids_ = np.array(ids, np.int64)
        order = np.argsort(owner_, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(owner_[order]) > 0]))
        members = owner_[order][starts]
        widest = max(map(len, words))
        padded = np.array([np.concatenate([x, np.full(widest - len(x), -2, x.dtype)]) for x in words])
        for b in batches:
            docs, texts = np.array(b.column(0).to_pylist(), np.int64), [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
            for at in range(0, len(texts), 500):
                all_windows, all_of = _cut(texts[at : at + 500], p.window, p.step)
                if p.bridge:  # windows of too few evaluation words
                    enough = ((all_windows >= 0) & (all_windows < len(idf_))).sum(axis=1) >= p.min_run
                    all_windows, all_of = all_windows[enough], all_of[enough]
                for w, of in ((all_windows[x : x + _ROWS], all_of[x : x + _ROWS]) for x in range(0, len(all_of), _ROWS)):
                    v = wt.times(w, basis_).astype(np.float32)
                    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                    # best cosine of any of an item's windows
                    cos = np.maximum.reduceat((v @ latent_.T)[:, order], starts, axis=1)
                    k, j = np.nonzero(cos >= p.cosine)
                    for lo in range(0, len(k), 5000):
                        kk, jj = k[lo : lo + 5000], j[lo : lo + 5000]
                        run_, common = align(w[kk], padded[members[jj]])
                        share = common / np.maximum((w[kk] >= 0).sum(axis=1), 1)
                        got = (docs[at + of[kk]], ids_[members[jj]], cos[kk, jj].astype(np.float64), run_, common, share)
                        yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(got, schema)], schema=schema)

    return found.where("words is not null").select("doc_id", "words").mapInArrow(run, _LEAKS)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", p: LeakSearch = LeakSearch()) -> DataFrame:
    """``doc_id, item_id`` of every candidate, with its best evidence.

    ``items``: ``item_id, text``. Result columns: ``cosine`` (latent), ``longest_run``
    (shared consecutive words, up to a window), ``common`` and ``lcs_share`` (words, and part,
    of the window that are a common subsequence). Null and empty texts have no passages; empty tables give
    an empty result; repeated documents count once per id.

    The items are the stated query set: the driver reads and broadcasts them pass by
    pass, ``items_a_pass`` at a time, so what it holds and sends has a fixed bound.
    """
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator()
    out = None
    while held := list(islice(rows, p.items_a_pass)):
        block = read_items([(r["item_id"], r["text"]) for r in held])
        if block.ids:
            part = _search(documents, key, column, block, p)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], _LEAKS)
    return out.groupBy(F.col("doc_id").alias(key), "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("longest_run").alias("longest_run"), F.max("common").alias("common"), F.max("lcs_share").alias("lcs_share")
    )


def verbatim(found: DataFrame, words: int = 13) -> DataFrame:
    """Leaks that share at least ``words`` consecutive words."""
    return found.where(F.col("longest_run") >= words)


def kinds(found: DataFrame, words: int = 13, share: float = 0.8) -> DataFrame:
    """Verbatim leaks and paraphrases: enough words of a window in the item's order, but no run of ``words``."""
    paraphrase = (F.col("lcs_share") >= share) & (F.col("common") >= words)
    return found.withColumn("kind", F.when(F.col("longest_run") >= words, "verbatim").when(paraphrase, "paraphrase")).where("kind is not null")

"""Many queries against stored texts: each task holds a group of queries and reads all texts tile by tile.

Queries are spread over the tasks, and a task reads the stored table itself, a tile of
texts at a time. Its thresholds rise from tile to tile, so hardly a match has to be
scored exactly or kept, and only results move. Where there are fewer groups of queries
than cores, the files of the table are divided too.

Inside a tile scores are summed from rows of weights (a term's, or a dimension's, for
all texts of the tile), with a bound on their error: for the best texts in 16 bits where
a query takes each row a whole number of times, as most do, and in 32 bits otherwise.
Texts whose values are whole multiples of one number (counts over a length) are summed
as these multiples, in 8 bits where they suffice, and stand in the order of that number,
so that one bar serves neighbours.
Queries are put in an order in which neighbours share leading rows, whose sums are made
once. What is within the error of a threshold is scored again in 64 bits; results depend
on these scores only. Ranks are counted in 32 bits, as many texts stand near a goal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marram.operators.ranking import Best
from marram.storage import write_through

#: Texts of one tile and of the first one, which gives the first thresholds; queries of one task, pairs that are scored again at once.
TILE, FIRST, GROUP, PAIRS = 65_536, 8_192, 32_768, 1_000_000
#: Rows that are kept for all texts of a tile, and sums that are kept for the next query.
ROWS, DEPTH = 512, 12
#: Queries that are multiplied at once where most dimensions are filled.
DENSE = 64
#: Largest sum in 16 bits, and the most times that rows are taken in it. Queries that can reach more than so many times
#: the median are left to 32 bits, as they would make the steps of all others coarse.
MOST, TIMES, ABOVE = 32_000, 500, 4.0
#: Neighbours in the order of their numbers that have one bar.
SEGMENT = 1024
#: Queries whose marks are looked through together.
MARKS = 16


def files_of(df: DataFrame, name: str) -> list[str]:
    """The files that hold ``df`` and nothing else; it is written first unless it is a stored table as it is."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = write_through(df, name)
    return sorted(df.inputFiles())


def tiles(files: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of stored files in batches of ``TILE``, the first and the last one smaller."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    held, n, size = [], 0, FIRST
    for uri in files:
        fs, path = FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(TILE, columns=columns, use_threads=False):
                while b.num_rows:
                    part = b.slice(0, size - n)
                    held.append(part)
                    n, b = n + part.num_rows, b.slice(part.num_rows)
                    if n == size:
                        yield pa.concat_batches(held)
                        held, n, size = [], 0, TILE
    if held:
        yield pa.concat_batches(held)


def over(queries: DataFrame, files: list[str], ddl: str, make: Callable[[list[str]], Callable], group: int) -> DataFrame:
    """``ddl``: what ``make(files)``, a function of all rows of a task, gives for groups of ``queries`` and parts of the files."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    queries = write_through(queries, "queries")
    n = queries.count()
    if not n or not files:
        return queries.sparkSession.createDataFrame([], ddl)
    # whole rounds of the cores; a group is never larger than asked for
    groups = -(-n // group)
    groups = -(-groups // cores) * cores if n >= 64 * cores else groups
    splits = min(len(files), max(1, cores // groups))

    def one(own: list[str]) -> DataFrame:
        f = make(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                yield from f(pa.concat_batches(held))

        return queries.repartition(groups).mapInArrow(run, ddl)

    return reduce(DataFrame.unionByName, (one(files[i::splits]) for i in range(splits)))


class Plan:
    """Weights of many queries over rows, in the order in which they are summed.

    ``at`` and ``weight``: rows and their weights of all queries, one query after the
    other; ``sizes``: how many each has; ``whole``: the rows that a tile has for all its
    texts; ``unit``: by what a row is multiplied in the tile (1 without ``units``), and
    ``scale``: by what a query's sums are, so that most weights are 1.
    """

    def __init__(self, at: np.ndarray, weight: np.ndarray, sizes: np.ndarray, whole: np.ndarray, scale: np.ndarray | None = None, units: bool = True) -> None:
        n, m = len(sizes), len(whole)
        self.scale = np.ones(n) if scale is None else scale
        self.unit = np.full(m, np.inf)
        if units:
            np.minimum.at(self.unit, at, np.abs(weight))
        self.unit[~np.isfinite(self.unit) | (self.unit == 0)] = 1.0
        ends = np.cumsum(sizes)
        query = np.repeat(np.arange(n), sizes)
        # often asked rows first: these are what neighbours share
        often = np.bincount(at, minlength=m)
        order = np.lexsort((at, -often[at], ~whole[at], query))
        rows, times = at[order], (weight[order] / self.unit[at[order]]).astype(np.float32)
        self.lists = [(rows[s:e].tolist(), times[s:e].tolist(), int(w)) for s, e, w in zip((ends - sizes).tolist(), ends.tolist(), np.bincount(query, weights=whole[at], minlength=n).tolist())]
        self.full = len(at) > n * m / 6 or len(at) > 16 * n and bool(whole.all())
        if self.full:
            self.matrix = np.zeros((n, m), np.float32)
            self.matrix[query, at] = (weight / self.unit[at]).astype(np.float32)
        total = np.bincount(query, weights=np.abs(weight), minlength=n)
        self.most = 1.5e-7 * ((m if self.full else sizes) + 4) * total * self.scale
        self.signed = bool((weight < 0).any())
        exactly = weight / self.unit[at]
        self.times = np.bincount(query, weights=np.abs(exactly), minlength=n)
        broken = np.bincount(query, weights=np.abs(exactly - np.rint(exactly)) > 1e-12 * np.abs(exactly), minlength=n)
        self.short = (broken == 0) & (self.times <= TIMES) & (not self.full)
        if self.short.any():
            self.short &= total <= ABOVE * np.median(total[self.short])
        self.reach = total[self.short].max(initial=0.0)
        keys = [(not short, *zip(a[: min(w, DEPTH)], t)) for short, (a, t, w) in zip(self.short.tolist(), self.lists)]
        self.order = sorted(range(n), key=keys.__getitem__)
        self.same = [0] * n
        for x, y in zip(self.order, self.order[1:]):
            both = min(len(keys[x]), len(keys[y]))
            alike = 0
            while alike < both and keys[x][alike] == keys[y][alike]:
                alike += 1
            self.same[y] = max(alike - 1, 0)

    def steps(self, largest: float, lifted: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        """What a row is multiplied by for 16 bits, what one unit of each query's sums stands for, and the bound of a score's error.

        It holds where no row has a value above ``largest``, and includes rounding to nine
        digits. ``lifted``: values above 0 stay so in 16 bits.
        """
        by = (MOST - TIMES) / (self.reach * largest) if self.reach * largest > 0 else 1.0
        error = np.where(self.short, (1.01 if lifted else 0.51) * self.times * self.scale / by, self.most * largest)
        return by, np.where(self.short, self.scale / by, self.scale), error + 2e-9

    def multiples(self, tile) -> tuple[np.ndarray, np.ndarray]:
        """The bytes in which each query's sums of the tile's multiples surely fit (4 are for its values as they are), and the bound of a score's error."""
        reach = self.times * max(tile.most, 1.0)
        size = np.where(self.short & (reach <= 32_767), np.where(reach <= 127, 1, 2), 4)
        return size, np.where(size < 4, 1e-10 * self.times * self.scale, self.most) * tile.largest + 3e-9

    def sums(self, tile, by: float | None = None, lifted: bool = False, size: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each query's number and its sums for the texts of a tile; the array is used again.

        They are in 16 bits where :meth:`steps` gave ``by``, and those of the tile's
        multiples where :meth:`multiples` gave ``size``.
        """
        if self.full:
            all_ = np.stack([tile.rows(j) for j in range(self.matrix.shape[1])])
            for s in range(0, len(self.matrix), DENSE):
                yield from enumerate(self.matrix[s : s + DENSE] @ all_, s)
            return
        n, rows, sparse = len(tile.names), tile.rows, tile.sparse
        kept_rows: dict[int, np.ndarray] = {}
        kept_places: dict[int, tuple] = {}

        def cut(values: np.ndarray) -> np.ndarray:
            v = values * np.float32(by)
            out = np.rint(v).astype(np.int16)
            if lifted:
                out[(out == 0) & (v > 0)] = 1
            return out

        def short_rows(j: int) -> np.ndarray:
            if j not in kept_rows:
                if sparse is None:
                    kept_rows[j] = cut(rows(j))
                else:
                    where, values = sparse(j)
                    kept_rows[j] = row = np.zeros(n, np.int16)
                    row[where] = cut(values)
            return kept_rows[j]

        def short_places(j: int) -> tuple:
            if j not in kept_places:
                where, values = sparse(j)
                kept_places[j] = where, cut(values)
            return kept_places[j]

        def multiple_rows(kind) -> Callable:
            return lambda j: tile.multiples(j, kind)

        ways = {np.float32: (rows, sparse), np.int16: (short_rows, short_places)}
        if size is not None:
            ways |= {kind: (multiple_rows(kind), None) for kind in (np.int8, np.int16)}
            kinds = [{1: np.int8, 2: np.int16, 4: np.float32}[x] for x in size.tolist()]
        else:
            kinds = [np.int16 if x else np.float32 for x in (self.short & (by is not None)).tolist()]
        stacks: dict = {}
        alike: dict = {}
        for i in self.order:
            kind = kinds[i]
            if kind not in stacks:
                stacks[kind], alike[kind] = ([np.zeros(n, kind) for _ in range(DEPTH + 1)], np.empty(n, kind)), 0
            for x in alike:
                alike[x] = min(alike[x], self.same[i])
            (row_of, places_of), (stack, spare) = ways[kind], stacks[kind]
            at, times, whole = self.lists[i]
            kept = min(whole, DEPTH)
            start, alike[kind] = alike[kind], DEPTH
            for d in range(start, kept):
                t, row, into = times[d], row_of(at[d]), stack[d + 1]
                if t == 1.0:
                    np.add(stack[d], row, out=into)
                elif t == -1.0:
                    np.subtract(stack[d], row, out=into)
                else:
                    np.multiply(row, kind(t), out=into)
                    into += stack[d]
            out = stack[kept]
            if len(at) > kept:
                np.copyto(spare, out)
                out = spare
                for d in range(kept, len(at)):
                    if d < whole:
                        out += row_of(at[d]) * kind(times[d])
                    else:
                        where, values = places_of(at[d])
                        out[where] += values if times[d] == 1.0 else values * kind(times[d])
            yield i, out


def _whole(x: np.ndarray) -> np.ndarray:
    """Numbers of 16 bits, those beyond them at their end."""
    return np.clip(x, -32768, 32767).astype(np.int16)


def _true(mask: np.ndarray) -> np.ndarray:
    """Places that are set in marks of whole words of 64; words with none are passed over at once."""
    words = np.flatnonzero(np.packbits(mask).view(np.uint64))
    at = np.flatnonzero(mask.reshape(-1, 64)[words])
    return words[at >> 6] * 64 + (at & 63)


class _Marks:
    """Marks of ``n`` texts for some queries, which are looked through together, as each call costs as much as thousands of texts."""

    def __init__(self, n: int) -> None:
        self.n, self.width, self.who = n, -(-n // 64) * 64, []
        self.room = np.zeros((MARKS, self.width), bool)

    def row(self) -> np.ndarray:
        """Room for the next query's marks; it is free again until :meth:`keep`."""
        return self.room[len(self.who), : self.n]

    def places(self) -> np.ndarray:
        """What is marked in :meth:`row`."""
        return _true(self.room[len(self.who)])

    def keep(self, i: int) -> bool:
        """Takes up the row as that of query ``i``; whether there is no more room."""
        self.who.append(i)
        return len(self.who) == MARKS

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and texts of all marks kept."""
        at = _true(self.room[: len(self.who)].reshape(-1))
        row, place = np.divmod(at, self.width)
        who, self.who = np.array(self.who, np.int64)[row], []
        return who, place


def _apart(bars: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Least multiples that can reach each query's bar, for each segment of texts; where the bar is below zero, so for the least number."""
    low, high = (f.reduceat(units, np.arange(0, len(units), SEGMENT)) for f in (np.minimum, np.maximum))
    out = np.empty((len(bars), len(low)), np.int16)
    for s in range(0, len(bars), 4096):
        b = bars[s : s + 4096, None]
        out[s : s + 4096] = _whole(np.ceil(np.where(b > 0, b / high, b / low)))
    return out


def best_of(plan: Plan, k: int, positive: bool, tiles_: Iterator) -> Best:
    """The ``k`` best of every query; ``tiles_`` gives tiles with ``names``, ``rows``, ``sparse`` and ``exact``."""
    best = Best(len(plan.lists), k, positive)
    least = best.least.copy()
    waiting: list[tuple] = []

    def settle(enough: int) -> None:
        # all that is known is sorted each time, so not for a few
        if sum(len(x[0]) for x in waiting) > enough:
            best.take(*(np.concatenate(x) for x in zip(*waiting)))
            waiting.clear()

    for tile in tiles_:
        n, held, many = len(tile.names), [], 0
        marks = _Marks(n)
        units = None if positive or plan.full else getattr(tile, "units", None)
        if units is None:
            (by, step, error), size = plan.steps(tile.largest, positive), None
            multiple = [False] * len(plan.lists)
        else:
            by, step = None, plan.scale
            size, error = plan.multiples(tile)
            multiple = (size < 4).tolist()

        def take() -> None:
            pairs = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
            scores = tile.exact(*pairs)
            keep = scores >= best.least[pairs[0]]
            waiting.append((pairs[0][keep], scores[keep], tile.names[pairs[1][keep]]))
            held.clear()

        bars = (least - error) / step
        # sums of what is above 0 are so themselves; where signs are mixed they are within the error
        bars = np.where(positive & (bars <= 0), -error / step if plan.signed else np.where(plan.short, 1, np.nextafter(np.float32(0), np.float32(1))), bars)
        with np.errstate(invalid="ignore"):
            whole, broken = _whole(np.ceil(bars)), bars.astype(np.float32)
        if units is not None:
            apart, head = _apart(bars, units), n // SEGMENT * SEGMENT
            less = np.clip(apart, -128, 127).astype(np.int8)
        for i, scores in plan.sums(tile, by, positive, size):
            row = marks.row()
            if not multiple[i]:
                np.greater_equal(scores, whole[i] if scores.dtype == np.int16 else broken[i], out=row)
            else:
                bar = less[i] if scores.dtype == np.int8 else apart[i]
                np.greater_equal(scores[:head].reshape(-1, SEGMENT), bar[: head // SEGMENT, None], out=row[:head].reshape(-1, SEGMENT))
                if head < n:
                    np.greater_equal(scores[head:], bar[-1], out=row[head:])
            if np.count_nonzero(row) > 4 * k:
                # hardly anything is known yet
                found = marks.places()
                own = scores[found].astype(np.float64) * step[i]
                if multiple[i]:
                    own *= units[found]
                end = -np.partition(-own, k - 1)[k - 1]
                found = found[own >= end - 2 * error[i]]
                least[i] = max(least[i], end - error[i])
                held.append((np.full(len(found), i), found))
            elif marks.keep(i):
                held.append(marks.found())
            else:
                continue
            many += len(held[-1][0])
            if many > PAIRS:
                take()
                many = 0
        if marks.who:
            held.append(marks.found())
        if held:
            take()
        settle(len(plan.lists) * k // 2)
        np.maximum(least, best.least, out=least)
    settle(0)
    return best


def before(plan: Plan, goals: np.ndarray, names: np.ndarray, tiles_: Iterator) -> np.ndarray:
    """How many texts stand before one with the score ``goals`` and the name ``names``, for every query."""
    n = np.zeros(len(goals), np.int64)
    for tile in tiles_:
        held, many = [], 0
        error = plan.most * tile.largest + 2e-9
        first, last = (((goals + e) / plan.scale).astype(np.float32) for e in (-error, error))
        size = len(tile.names)
        marks, above = _Marks(size), np.empty(size, bool)

        def take() -> None:
            i, j = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
            s = tile.exact(i, j)
            np.add.at(n, i[(s > goals[i]) | (s == goals[i]) & (tile.names[j] < names[i])], 1)
            held.clear()

        for i, scores in plan.sums(tile):
            from_ = marks.row()
            np.greater_equal(scores, first[i], out=from_)
            all_ = np.count_nonzero(from_)
            if not all_:
                continue
            np.greater(scores, last[i], out=above)
            sure = np.count_nonzero(above)
            n[i] += sure
            if all_ > sure:
                np.not_equal(from_, above, out=from_)
                if marks.keep(i):
                    held.append(marks.found())
                    many += len(held[-1][0])
                    if many > PAIRS:
                        take()
                        many = 0
        if marks.who:
            held.append(marks.found())
        if held:
            take()
    return n

"""Fixed-size count tables over a whole collection.

A count table is a few channels of ``2**bits`` counters. Each task adds its rows to
its own table in NumPy (so the map side is combined before anything moves), tables
are summed slice by slice in a stream, and the sum, whose size depends only on
``channels`` and ``bits``, may be held by the driver and broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLICES = 64
#: Tasks whose sums are merged by one task of the first level.
_FAN = 64
_SCHEMA = "slice int, part int, counts binary"
_ARROW = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def pack_part(s: int, part: int, x: np.ndarray) -> pa.RecordBatch:
    """One compressed piece of a table of sums."""
    return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(x).tobytes(), 1)], pa.binary())], schema=_ARROW)


def add_up(parts: DataFrame, dtype: type) -> dict[int, np.ndarray]:
    """Sums of ``slice, part, counts`` by slice.

    Two levels of streams: the parts of 64 tasks are summed where many tasks can do
    it, then their sums; no task holds more than the slices it sums, and what comes
    to the driver is one table.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for s, part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x, k = np.frombuffer(zlib.decompress(raw.as_py()), dtype), (s, part // _FAN)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.copy()
        for (s, part), x in sums.items():
            yield pack_part(s, part, x)

    first = parts.repartition("slice", F.floor(F.col("part") / _FAN)).mapInArrow(merge, _SCHEMA)
    last = first.repartition(8, "slice").mapInArrow(merge, _SCHEMA)
    out: dict[int, np.ndarray] = {}
    for r in last.collect():
        x = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype)
        out[r["slice"]] = out[r["slice"]] + x if r["slice"] in out else x
    return out


def task_number() -> int:
    from pyspark import TaskContext

    c = TaskContext.get()
    return c.partitionId() if c else 0


def count_table(df: DataFrame, channels: int, bits: int, make: Callable[[], Callable[[pa.RecordBatch], list[np.ndarray]]]) -> np.ndarray:
    """Counters ``[channels, 2**bits]`` (uint32) of the hashes that ``make()`` gives per batch.

    ``make`` is called once per task; its function returns one uint64 array of hashes
    per channel. A hash falls into the counter of its lowest bits. Every row of ``df``
    counts. An empty ``df`` gives zeros.
    """
    size, mask = 1 << bits, np.uint64((1 << bits) - 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, f = np.zeros((channels, size), np.uint32), make()
        for b in batches:
            for c, h in enumerate(f(b)):
                # few hashes: touch only their counters
                if len(h) * 16 < size:
                    at, n = np.unique(h & mask, return_counts=True)
                    table[c, at] += n.astype(np.uint32)
                elif len(h):
                    table[c] += np.bincount((h & mask).astype(np.int64), minlength=size).astype(np.uint32)
        parts = table.reshape(channels, _SLICES, -1)
        for s in range(_SLICES):
            if parts[:, s].any():
                yield pack_part(s, task_number(), parts[:, s])

    out = np.zeros((channels, _SLICES, size // _SLICES), np.uint32)
    for s, x in add_up(df.mapInArrow(local, _SCHEMA), np.uint32).items():
        out[:, s] = x.reshape(channels, -1)
    return out.reshape(channels, size)

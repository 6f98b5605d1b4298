"""Interfaces of the pipeline's models, and how they run inside a plan.

A model is an object whose ``make()`` loads it and returns a function on lists; it is
called once per task, so that weights are loaded once, and the function gets one Arrow
batch at a time. Models that wrap a remote service follow the same interface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


class Embedder(Protocol):
    """Texts to vectors of length one. ``reads``: what it is given, ``text`` or index ``terms``."""

    reads: str

    def make(self) -> Callable[[list], np.ndarray]: ...


class Reranker(Protocol):
    """Scores of pairs of a query and a text; larger is better."""

    def make(self) -> Callable[[list[str], list[str]], list[float]]: ...


class Generator(Protocol):
    """Prompts to answers."""

    def make(self) -> Callable[[list[str]], list[str]]: ...


class Rewriter(Protocol):
    """Questions and the code they are about to queries for retrieval."""

    def make(self) -> Callable[[list[str], list[str]], list[str]]: ...


def apply_model(df: DataFrame, model, given: list[str], out: str, kind: str) -> DataFrame:
    """``df`` with the column ``out`` of Spark's type ``kind``: what ``model`` makes of the columns ``given``."""
    schema = StructType([*df.schema.fields, StructField(out, _parse_datatype_string(kind))])
    places = [df.columns.index(c) for c in given]
    arrow = to_arrow_type(schema.fields[-1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            f = f or model.make()
            made = pa.array(f(*(b.column(i).to_pylist() for i in places)), arrow) if b.num_rows else pa.array([], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)

"""Methods of source files and their chunks.

Parsing is inherently sequential, so both steps are Arrow-batched Python stages; each
is narrow, and files and methods are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marram.config import RetrievalConfig
from marram.functions import source as S

_METHODS = "id string, name string, content string, start_line int, end_line int, file string"
_CHUNKS = "parent_id string, method string, file string, occurrence long, chunk_index int, content string, start_line int, end_line int"


def _stage(df: DataFrame, ddl: str, rows) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for r in zip(*(c.to_pylist() for c in b.columns)) for x in rows(*r)]
            cols = list(zip(*got)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def parse_methods(files: DataFrame) -> DataFrame:
    """Methods of ``file, content``; content is the raw text, ids repeat for overloads.

    Null content has no methods; a body that is never closed is skipped.
    """

    def rows(file, text):
        for name, s, e, first, last in S.methods(text or ""):
            yield f"{file}::{name}", name, text[s:e], first, last, file

    return _stage(files.select("file", "content"), _METHODS, rows)


def chunk_methods(methods: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Chunks of ``id, name, content, start_line, end_line, file``.

    Short methods are one chunk; others are cut at braces and statements. Neighbours
    are linked within their method by a window over it, which holds a method's chunks
    only. Methods of one id keep apart by ``occurrence``. Null content gives no chunk.
    """

    def rows(mid, name, text, first, last, file, occurrence):
        if text is None:
            return
        if len(text) <= config.max_code_chars:
            yield mid, name, file, occurrence, 0, text, first, last
            return
        r = S.merge_small(S.structural_ranges(text, config.max_code_chars), config.min_code_chars, config.max_code_chars)
        for i, (s, e) in enumerate(r):
            yield mid, name, file, occurrence, i, text[s:e], first + text.count("\n", 0, s), first + text.count("\n", 0, e)

    given = methods.select("id", "name", "content", "start_line", "end_line", "file", F.monotonically_increasing_id().alias("occurrence"))
    c = _stage(given, _CHUNKS, rows).withColumn("id", F.concat_ws("::", "parent_id", F.col("chunk_index").cast("string")))
    # a method's chunks leave the parser together, so the window needs no other key
    w = Window.partitionBy("occurrence").orderBy("chunk_index")
    return c.select("*", F.lag("id").over(w).alias("prev_chunk_id"), F.lead("id").over(w).alias("next_chunk_id")).drop("occurrence")

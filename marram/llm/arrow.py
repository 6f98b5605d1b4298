"""Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marram.operators.ranking import spread


def stage(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]]) -> DataFrame:
    """Run a column function over Arrow batches.

    ``make`` is called once per task and returns a function from a dict of column
    lists to a dict of output columns; models or tables are so loaded once per task.
    """
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            got = f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in arrow], schema=arrow)

    return spread(df).mapInArrow(run, out)

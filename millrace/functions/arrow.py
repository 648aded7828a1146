"""Arrow batches in and out of Python stages, without pandas in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: About as many bytes of a batch are Python objects at a time.
BATCH_BYTES = 8 << 20


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str | T.StructType) -> DataFrame:
    """Run ``fn(column, column, ...)`` over every Arrow batch of ``df``.

    ``fn`` gets each column of ``df``, in order, as a Python list and returns a
    dict of equally long lists or arrays, one for each field of ``schema``.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                out = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                arrays = [pa.array(out[f.name], type=f.type) for f in target]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, struct)

"""Rows of Python values as Arrow batches of a Spark schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows that are handed on at a time; those of one input row stay together.
ROWS = 2000


def map_rows(df: DataFrame, make: Callable[..., list[dict]], ddl: str) -> DataFrame:
    """A DataFrame of the rows (dictionaries; what is missing is null) that ``make`` gives for each row's values."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held += make(*values)
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(run, schema)

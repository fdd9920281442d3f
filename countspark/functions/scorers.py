"""A user's Python function over whole Arrow batches, for models that the library doesn't have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def score_batches(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], columns: list[str], to: str = "risk") -> DataFrame:
    """df with what score() gives for each row, from a batch's rows of these columns as a pandas table; it must give one number a row.

    The function and what it needs are pickled to the workers; a batch has at most spark.sql.execution.arrow.maxRecordsPerBatch rows. A column
    of the name `to` is replaced. Nothing is sent to Python but the batches, and no row leaves its partition.
    """
    kept = [c for c in df.columns if c != to]
    at = [df.columns.index(c) for c in columns]
    keep = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pd.DataFrame({c: batch.column(i).to_pandas() for c, i in zip(columns, at)})
            found = score(rows)
            if len(found) != batch.num_rows:
                raise ValueError(f"the function gave {len(found)} numbers for {batch.num_rows} rows")
            numbers = pa.array(pd.Series(found).astype(float).to_numpy(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), numbers], names=[*kept, to])

    schema = StructType([*(df.schema[c] for c in kept), StructField(to, DoubleType())])
    return df.mapInArrow(run, schema)

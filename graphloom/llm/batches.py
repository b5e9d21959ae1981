"""Bounds on what a Python worker makes at once.

Spark ends a batch at a number of bytes (spark.sql.execution.arrow.maxBytesPerBatch) or rows, whichever comes first; functions go
through it in slices, so that what they make of it stays small too. No session setting is touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa

#: Rows of a slice; texts can be long.
ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parts(batches: Iterator[pd.Series], rows: int = ROWS) -> Iterator[pd.Series]:
    for column in batches:
        for at in range(0, len(column), rows):
            yield column.iloc[at : at + rows]

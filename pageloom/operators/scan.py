"""Ordered folds whose state passes from row to row: one pass over sorted rows, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def segmented_scan(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: Sequence[str], step: Callable[..., tuple], adds: str) -> DataFrame:
    """df with the columns of the schema string `adds`, made by a fold over each group's rows in order.

    step(state, *values) gives the next state and a tuple of the new columns; the state of a group's
    first row is None. A window deals groups out by key, unless they are dealt out so already, and sorts
    them within their task, and rows stream through it, so a group's size costs time in proportion and no memory beyond its state. A step
    depends on the one before it: the rows of one group are one task's work, by nature of the fold.
    Rows that tie in `order` come in no stated order; null keys form a group.
    """
    new = StructType.fromDDL(adds)
    clash = {c.lower() for c in df.columns} & {c.lower() for c in new.names}
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already")
    out = StructType([*df.schema.fields, *new.fields])
    keys, fed, types = [df.columns.index(c) for c in by], [df.columns.index(c) for c in values], to_arrow_schema(new).types

    def run(batches):
        key, state = None, None
        for b in batches:
            made = []
            for k, v in zip(zip(*(b.column(i).to_pylist() for i in keys)), zip(*(b.column(i).to_pylist() for i in fed))):
                if k != key:
                    key, state = k, None
                state, row = step(state, *v)
                made.append(row)
            columns = zip(*made) if made else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types))], [*b.schema.names[:-1], *new.names])

    place = "place"
    while place.lower() in {c.lower() for c in df.columns}:
        place = f"_{place}"
    placed = df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return placed.sortWithinPartitions(*by, *order).mapInArrow(run, out)

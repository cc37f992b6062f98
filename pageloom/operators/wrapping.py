"""Texts of any length as lines, in Arrow batches: linear time, and nothing is dealt out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pageloom.functions import fitting

#: Lines, about, that are put together before they are passed on.
LINES = 50_000


def wrapped_lines(rows: DataFrame, key: list[str], wide: float, size: float, text: str = "text") -> DataFrame:
    """key, line_no (from 1) and line of each text, broken greedily at white space.

    A word counts 0.6 sizes for each byte; a longer one stands alone. An empty line of the text stays,
    one of white space alone goes, so a text of those has no row; an empty text is one empty line and
    a null text none. `key` names a row. A row becomes lines where it is: words are no rows, none is
    sorted or moved, and lines are passed on as they come.
    """
    n = len(key)

    def run(batches):
        for b in batches:
            at, numbers, out = [], [], []
            for i, t in enumerate(b.column(n)):
                if t.is_valid:
                    made = fitting.broken(t.as_py(), wide, size)
                    at += [i] * len(made)
                    numbers += range(1, len(made) + 1)
                    out += made
                if out and (len(out) >= LINES or i == b.num_rows - 1):
                    keys = [b.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(numbers, pa.int32()), pa.array(out, pa.string())], [*b.schema.names[:n], "line_no", "line"])
                    at, numbers, out = [], [], []

    fields = StructType([*rows.select(*key).schema.fields, StructField("line_no", IntegerType()), StructField("line", StringType())])
    return rows.select(*key, text).mapInArrow(run, fields)

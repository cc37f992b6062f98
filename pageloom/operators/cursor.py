"""Rows of a whole table in one order: global ordinals, and the nth page of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.store import cut

_BITS = 33  # monotonically_increasing_id() counts rows of a partition in so many low bits


def ordinals(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """df with the place of each row, from 0, in the order given.

    The rows are dealt out in ranges and sorted within each; a row's place is the number of rows in
    the ranges before it and its place in its own, so no task sorts more than one range. The driver
    gets one count for each range. Rows that tie in `order` have places next to each other, in no
    stated order; nulls come first unless the order says otherwise. The rows are kept in the
    checkpoint folder, as a place is true for one layout of them only. A name that df has is refused.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already")
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part, place = F.shiftright(F.col(name), _BITS), F.col(name).bitwiseAND(F.lit((1 << _BITS) - 1))
    before, starts = 0, []
    for at, rows in sorted(laid.groupBy(part.alias("part")).count().collect()):
        starts.append((at, before))
        before += rows
    if len(starts) <= 1:
        return laid.withColumn(name, place)
    of = df.sparkSession.createDataFrame(starts, f"{name}_part bigint, {name}_before bigint")
    laid = laid.join(F.broadcast(of), part == F.col(f"{name}_part"))
    return laid.withColumn(name, place + F.col(f"{name}_before")).drop(f"{name}_part", f"{name}_before")


def page(rows: DataFrame, number: int, size: int, name: str = "ordinal") -> DataFrame:
    """Page `number`, from 0, of `size` rows of a table with ordinals; no row beyond its end."""
    if number < 0 or size < 1:
        raise ValueError("a page has a number from 0 and a size from 1")
    return rows.where(F.col(name).between(number * size, (number + 1) * size - 1))


def after(df: DataFrame, key: list[str], last: tuple, size: int) -> DataFrame:
    """The `size` rows that follow the row with key `last`, in the order of key: no rows before it are kept.

    The first column of the key bounds the scan, so that files and row groups before it are skipped.
    The columns of the key hold no nulls.
    """
    if len(key) != len(last):
        raise ValueError("the last key has one value for each column")
    later = F.lit(False)
    for i, (c, v) in enumerate(zip(key, last)):
        same = F.lit(True)
        for d, w in zip(key[:i], last[:i]):
            same = same & (F.col(d) == F.lit(w))
        later = later | (same & (F.col(c) > F.lit(v)))
    return df.where((F.col(key[0]) >= F.lit(last[0])) & later).orderBy(*key).limit(size)

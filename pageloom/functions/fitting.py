"""Text in a box: lines of words, their count, and the size at which they fit, as columns made in Arrow batches.

A word is a run of other than white space and counts 0.6 sizes for each byte of UTF-8. Texts, widths,
heights and sizes are SQL expressions, so each row can have its own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Fit(NamedTuple):
    """How text is fitted: bounds of its size, line height in sizes, space left free, and what may change."""

    least: float = 6.0
    most: float = 24.0
    spacing: float = 1.2
    padding: float = 2.0
    shrink: bool = True
    grow: bool = False
    rounds: int = 20
    align: str = "left"


#: A word: what Java's (?U)\s leaves; str.split() would part words at four control characters too.
_WORD = re.compile("[^\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _paragraphs(text: str) -> list[list[int] | None]:
    """Of each line of the text the running sums of its words' bytes and one space each; None if it is empty."""
    return [list(accumulate((len(w.encode()) + 1 for w in _WORD.findall(line)), initial=0)) if line else None for line in text.split("\n")]


def _room(wide: float | None, size: float | None) -> float:
    """The most bytes that a line has room for; -1 if none. NaN is larger than any number, as in SQL."""
    if wide is None or size is None:
        return -1
    unit = size * 0.6
    if math.isnan(wide) or wide == math.inf:
        return math.inf
    if math.isnan(unit) or unit == math.inf or wide < 0:
        return -1
    if unit <= 0 or wide / unit > 1e15:
        return math.inf
    most = int(wide / unit)
    while most * unit > wide:
        most -= 1
    while (most + 1) * unit <= wide:
        most += 1
    return most


def _ends(sums: list[int], room: float) -> list[int]:
    """The place behind the last word of each line, greedily; a longer word stands alone."""
    out, at = [], 0
    while at < len(sums) - 1:
        at = max(at + 1, bisect_right(sums, sums[at] + room + 1) - 1)
        out.append(at)
    return out


def _count(paras: list[list[int] | None], room: float) -> int:
    return sum(1 if p is None else len(_ends(p, room)) for p in paras)


def _column(run, kind: str, *parts: str) -> Column:
    """run over batches of the values of SQL expressions: a text and numbers."""
    return F.arrow_udf(run, kind)(*[F.expr(p if i == 0 else f"cast({p} as double)") for i, p in enumerate(parts)])


def _found(paras: list[list[int] | None], wide: float | None, high: float | None, top: float | None, fit: Fit) -> float | None:
    if high is None or top is None or high <= 0 or (wide is not None and wide <= 0):
        return None
    low, best = fit.least, None
    for _ in range(fit.rounds):
        if top - low <= 0.1:
            break
        size = (low + top) / 2
        if math.isnan(high) or _count(paras, _room(wide, size)) * (size * fit.spacing) <= high:
            best = size
            if not fit.grow:
                break
            low = size
        elif fit.shrink:
            top = size
        else:
            break
    return best


def _broken(text: str, paras: list[list[int] | None], room: float) -> list[str]:
    out = []
    for line, sums in zip(text.split("\n"), paras):
        words, at = _WORD.findall(line), 0
        for end in [] if sums is None else _ends(sums, room):
            out.append(" ".join(words[at:end]))
            at = end
        if sums is None:
            out.append("")
    return out


def broken(text: str, wide: float, size: float) -> list[str]:
    """The lines of one text; an empty line stays, one of white space alone goes."""
    return _broken(text, _paragraphs(text), _room(wide, size))


def _box(width: str, height: str, fit: Fit) -> tuple[str, str]:
    free = f"{2 * fit.padding!r}D"
    return f"({width} - {free})", f"({height} - {free})"


def fitted_size(text: str, width: str, height: str, fit: Fit = Fit(), most: str | None = None) -> Column:
    """The size that bisection finds for a text in a box; null if none that it tries fits.

    Sizes from fit.least to `most` (fit.most if not given) are halved from the midpoint on, while they
    are over 0.1 apart and for fit.rounds at most. A size that fits is kept, and ends the search unless
    fit.grow; one that doesn't ends it unless fit.shrink. A box that padding leaves empty fits none. A
    text's words are measured once; each size takes a step for each line.
    """

    def run(texts: pa.Array, wide: pa.Array, high: pa.Array, top: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), wide.to_pylist(), high.to_pylist(), top.to_pylist())
        return pa.array((None if t is None else _found(_paragraphs(t), w, h, m, fit) for t, w, h, m in rows), pa.float64())

    return _column(run, "double", text, *_box(width, height, fit), most or f"{fit.most!r}D")


def smaller_size(text: str, width: str, height: str, size: str, fit: Fit = Fit()) -> Column:
    """fitted_size() below `size` of a text that is too high for its box at `size`; null if it fits or none does.

    Words are measured once, and only texts that are too high are searched. NaN is larger than any number.
    """

    def too_high(paras: list[list[int] | None], wide: float | None, high: float, size: float) -> bool:
        takes = _count(paras, _room(wide, size)) * (size * fit.spacing)
        return takes > high or (math.isnan(takes) and not math.isnan(high))

    def run(texts: pa.Array, wide: pa.Array, high: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for t, w, h, s in zip(texts.to_pylist(), wide.to_pylist(), high.to_pylist(), sizes.to_pylist()):
            paras = None if t is None or h is None or s is None else _paragraphs(t)
            out.append(_found(paras, w, h, s, fit) if paras is not None and too_high(paras, w, h, s) else None)
        return pa.array(out, pa.float64())

    return _column(run, "double", text, *_box(width, height, fit), size)


def fitted_lines(text: str, width: str, height: str, fit: Fit = Fit()) -> Column:
    """Struct (size, lines): fitted_size() and the lines() of that size, or the text as the only line if none fits."""

    def run(texts: pa.Array, wide: pa.Array, high: pa.Array) -> pa.Array:
        sizes, broken = [], []
        for t, w, h in zip(texts.to_pylist(), wide.to_pylist(), high.to_pylist()):
            paras = [] if t is None else _paragraphs(t)
            size = None if t is None else _found(paras, w, h, fit.most, fit)
            sizes.append(size)
            broken.append([t] if size is None else _broken(t, paras, _room(w, size)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.float64()), pa.array(broken, pa.list_(pa.string()))], ["size", "lines"])

    return _column(run, "struct<size:double,lines:array<string>>", text, *_box(width, height, fit))


def lines(text: str, wide: str, size: str) -> Column:
    """The lines of a text in a width, greedily; a longer word stands alone, an empty line stays."""

    def run(texts: pa.Array, wide: pa.Array, size: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), wide.to_pylist(), size.to_pylist())
        return pa.array((None if t is None else _broken(t, _paragraphs(t), _room(w, s)) for t, w, s in rows), pa.list_(pa.string()))

    return _column(run, "array<string>", text, wide, size)


def line_count(text: str, wide: str, size: str) -> Column:
    """The number of lines() without making them."""

    def run(texts: pa.Array, wide: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array((None if t is None else _count(_paragraphs(t), _room(w, s)) for t, w, s in zip(texts.to_pylist(), wide.to_pylist(), size.to_pylist())), pa.int32())

    return _column(run, "int", text, wide, size)

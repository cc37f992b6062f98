"""Affine matrices as structs (a..f), and the graphics state along a page's drawing operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.layout import PAGE
from pageloom.operators.scan import segmented_scan

NAMES = "abcdef"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Fixed value: a determinant nearer to 0 has no inverse.
FLAT = 0.0001


def matrix(*values: Column | float) -> Column:
    """A matrix of six numbers."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip(NAMES, values, strict=True)])


def multiply(m: Column, n: Column) -> Column:
    """The matrix that applies m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def inverse(m: Column) -> Column:
    """The matrix that undoes m; the identity where m is flat."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    back = matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)
    return F.when((det > -FLAT) & (det < FLAT), matrix(*IDENTITY)).otherwise(back)


def point(m: Column, x: Column, y: Column) -> Column:
    """Struct (x, y) of a point under m."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def rectangle(m: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Struct (min_x, min_y, max_x, max_y) around the corners of a rectangle under m."""
    corners = [point(m, p, q) for p in (x, x + width) for q in (y, y + height)]
    return F.struct(*[how(*[c[axis] for c in corners]).alias(f"{n}_{axis}") for n, how in (("min", F.least), ("max", F.greatest)) for axis in "xy"])


def _times(m: tuple, n: tuple) -> tuple:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def graphics_states(operators: DataFrame) -> DataFrame:
    """operators with the state after each: depth, ctm, line_width, stroke and fill (r, g, b).

    operators have PAGE, op_seq, op and args, a list of numbers. q saves the state and Q takes back the
    last one saved, or nothing if there is none; cm multiplies the matrix, w sets the line width, RG and
    rg the colours. Other operators, and those with too few or null numbers, change nothing. One scan of a
    page in order; memory holds the states it has saved.
    """

    def step(at, op, args):
        (ctm, width, stroke, fill), saved, depth = at or ((IDENTITY, 1.0, (0.0,) * 3, (0.0,) * 3), (), 0)
        need = {"cm": 6, "w": 1, "RG": 3, "rg": 3}.get(op, 0)
        given = tuple(args[:need]) if args else ()
        if op == "q":
            saved, depth = (saved, (ctm, width, stroke, fill)), depth + 1
        elif op == "Q" and saved:
            (saved, (ctm, width, stroke, fill)), depth = saved, depth - 1
        elif need and len(given) == need and None not in given:
            if op == "cm":
                ctm = _times(ctm, given)
            elif op == "w":
                width = given[0]
            elif op == "RG":
                stroke = given
            else:
                fill = given
        ink = [dict(zip("rgb", c)) for c in (stroke, fill)]
        return ((ctm, width, stroke, fill), saved, depth), (depth, dict(zip(NAMES, ctm)), width, *ink)

    color = "struct<r:double,g:double,b:double>"
    return segmented_scan(operators, PAGE, ["op_seq"], ["op", "args"], step, f"depth int, ctm {MATRIX}, line_width double, stroke {color}, fill {color}")


def page_matrices(states: DataFrame) -> DataFrame:
    """PAGE and page_ctm, the numbers of the first cm of a page that stands outside any saved state."""
    own = matrix(*[F.col("args")[i] for i in range(6)])
    return states.where((F.col("op") == "cm") & (F.col("depth") == 0) & (F.size("args") >= 6)).groupBy(*PAGE).agg(F.min_by(own, "op_seq").alias("page_ctm"))

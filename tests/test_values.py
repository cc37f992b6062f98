"""Dates, strings, fitting and geometry on single values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pageloom.functions import values as V
from pageloom.functions.text import wrap


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, local, offset",
    [
        ("D:20240229123456+09'00'", dt.datetime(2024, 2, 29, 12, 34, 56), 540),
        ("D:2024", dt.datetime(2024, 1, 1), 0),
        ("20241301", dt.datetime(2025, 1, 1), 0),
        ("D:20240101000000Z", dt.datetime(2024, 1, 1), 0),
        ("D:20240101000000-03'30'", dt.datetime(2024, 1, 1), -210),
    ],
)
def test_dates_parse(spark, text, local, offset):
    assert tuple(one(spark, V.parse_date(F.lit(text)))) == (local, offset)


def test_dates_without_year_and_nulls(spark):
    assert one(spark, V.parse_date(F.lit("D:x"))) is None
    assert one(spark, V.parse_date(F.lit(None).cast("string"))) is None
    assert one(spark, V.format_date(F.lit(None).cast("timestamp"), F.lit(0))) == ""
    assert one(spark, V.format_date(F.lit(dt.datetime(2024, 5, 6, 7, 8, 9)), F.lit(-30))) == "D:20240506070809-00'30'"


@pytest.mark.parametrize("text", ["", "plain", "a(b)\\c", "Ünï 😀", "日本"])
def test_strings_round_trip(spark, text):
    assert one(spark, V.decode_string(V.encode_string(F.lit(text)))) == text


def plain_fit(text, width, height, low=6.0, high=24.0, spacing=1.2, padding=2.0):
    best = None
    for _ in range(20):
        if high - low <= 0.1:
            break
        mid, n = (low + high) / 2, 0
        for p in text.split("\n"):
            line = None
            for w in p.split():
                size = len(w.encode())
                if line is not None and (line + 1 + size) * (mid * 0.6) <= width - 2 * padding:
                    line += 1 + size
                else:
                    line, n = size, n + 1
            n += p == ""
        if n * mid * spacing <= height - 2 * padding:
            best = low = mid
        else:
            high = mid
    return best


@pytest.mark.parametrize("text, width, height", [("some words that have to wrap", 100.0, 60.0), ("a\n\nb  c", 50.0, 40.0), ("", 30.0, 30.0), ("word " * 400, 60.0, 30.0), ("ひらがな と 漢字", 90.0, 80.0)])
def test_fit(spark, text, width, height):
    got = spark.createDataFrame([(text,)], "t string").select(V.fit_size("t", width, height)).first()[0]
    assert got == plain_fit(text, width, height)


def test_box_smaller_than_its_padding(spark):
    assert one(spark, V.fit_size("'x'", 4.0, 50.0)) is None


def test_wrap_counts_lines(spark):
    assert one(spark, wrap("'aa bb cc\\n\\ndddddddd'", 30.0, 10.0)) == ["aa bb", "cc", "", "dddddddd"]


def test_colours_and_geometry(spark):
    assert tuple(one(spark, V.cmyk_to_rgb(F.lit(0.0), F.lit(0.5), F.lit(1.0), F.lit(0.2)))) == (204, 102, 0)
    assert tuple(one(spark, V.ruby_layout(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(10.0), F.lit(12.0)))) == (10.0, 20.0, 32.0, 30.0)
    assert one(spark, V.ruby_text(F.lit("漢"), F.lit("かん"))) == "漢(かん)"
    path = one(spark, V.circle(F.lit(0.0), F.lit(0.0), F.lit(100.0))).split("\n")
    assert path[:2] == ["100.00 0.00 m", "100.00 55.23 55.23 100.00 0.00 100.00 c"] and path[-1].endswith("100.00 -0.00 c") or path[-1].endswith("100.00 0.00 c")


def test_fit_of_all_documents(spark):
    from pageloom.plans import catalog

    data = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    got = dict(catalog.queries()["fitted_sizes"](spark, data).collect())
    assert got == {k: plain_fit(v, 400.0, 600.0) for k, v in texts.items()}


def test_unknown_kinds_and_strategies_are_refused(spark):
    from pageloom.operators import layout

    blocks = spark.createDataFrame([(1, 1, "text", 0.0, 0.0, 5.0, 5.0)], "page_id bigint, block_seq int, block_type string, x double, y double, width double, height double")
    with pytest.raises(ValueError):
        layout.adjust_layout(blocks, "sideways")
    with pytest.raises(ValueError):
        layout.move_block(blocks, "table", 0, 1.0, 1.0)
    assert layout.move_block(blocks, "text", 3, 1.0, 1.0).collect() == blocks.collect()


def test_pages_whose_lines_differ_from_their_order(spark):
    from pageloom.operators import layout

    rows = [(1, 0, 0, "b", 50.0, 99.0, 10.0), (1, 0, 1, "a", 10.0, 100.0, 10.0), (1, 0, 2, "d", 90.0, 94.0, 10.0), (1, 0, 3, "c", 70.0, 95.0, 10.0), (2, 0, 0, "x", 0.0, 0.0, 0.0)]
    e = spark.createDataFrame(rows, "doc_id bigint, page_num int, elem_seq int, text string, x double, y double, size double")
    got = {(r.doc_id, r.elem_seq): (r.line_no, r["rank"]) for r in layout.sorted_elements(e).collect()}
    assert got == {(1, 1): (1, 1), (1, 0): (1, 2), (1, 3): (1, 3), (1, 2): (2, 4), (2, 0): (1, 1)}
    assert {r.doc_id: r.text for r in layout.sorted_text(e).collect()} == {1: "a b c d", 2: "x"}
    assert layout.sorted_text(e.where("doc_id = 0")).count() == 0

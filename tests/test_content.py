"""Content blocks, scans and fitted text on hand-made pages."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from pageloom.functions import fitting
from pageloom.operators import content as C
from pageloom.operators import layout as L
from pageloom.operators.scan import segmented_scan

ELEMENTS = "doc_id bigint, page_num int, elem_seq int, text string, x double, y double, width double, height double, size double, font string"
IMAGES = f"doc_id bigint, page_num int, image_seq int, name string, x double, y double, placed_width double, placed_height double, pixel_width int, pixel_height int, format string, transform {C.MATRIX}"
PAGES = f"doc_id bigint, page_num int, width double, height double, page_ctm {C.MATRIX}"


def page(spark, elements, images=(), flip=False, pages=((1, 0),)):
    e = spark.createDataFrame([(*p, i, t, x, y, 20.0, 10.0, 10.0, f) for p, i, t, x, y, f in elements], ELEMENTS)
    i = spark.createDataFrame([(*p, n, f"Im{n}", x, y, 50.0, h, 5, 5, "png", (50.0, 0.0, 0.0, h, x, y)) for p, n, x, y, h in images], IMAGES)
    p = spark.createDataFrame([(*k, 300.0, 400.0, (1.0, 0.0, 0.0, -1.0 if flip else 1.0, 0.0, 400.0) if flip is not None else None) for k in pages], PAGES)
    return e, i, p


P = (1, 0)


@pytest.mark.parametrize("flip", [False, True, None])
def test_blocks_are_turned_back(spark, flip):
    e, i, p = page(spark, [(P, 0, "a", 10.0, 300.0, "F1"), (P, 1, "b", 10.0, 290.0, "F1"), (P, 2, "c", 10.0, 100.0, "F1")], [(P, 1, 20.0, 150.0, 40.0)], flip)
    got = sorted(C.content_blocks(e, i, p).collect(), key=lambda r: r.block_seq)
    assert [(r.block_type, r.text) for r in got] == [("text", "a\nb"), ("text", "c"), ("image", None)]
    ys = [(290.0, 20.0), (100.0, 10.0), (150.0, 40.0)]
    assert [(r.y, r.height) for r in got] == [((400 - y - h) if flip else y, h) for y, h in ys]
    assert [x.y for x in got[0].elements] == ([100.0, 110.0] if flip else [300.0, 290.0])
    assert tuple(got[0].color) == (0.0, 0.0, 0.0) and got[2].image.name == "Im1" and got[2].elements is None


def test_pages_without_blocks_keep_their_layout(spark):
    e, i, p = page(spark, [(P, 0, "a", 10.0, 300.0, "F1")], [((1, 2), 1, 0.0, 0.0, 9.0)], None, [(1, 0), (1, 1), (1, 2)])
    b = C.content_blocks(e, i, p)
    got = {r.page_num: (len(r.text_blocks), len(r.images), r.page_ctm) for r in C.page_layouts(b, p).collect()}
    assert got == {0: (1, 0, None), 1: (0, 0, None), 2: (0, 1, None)}
    assert C.content_blocks(e.limit(0), i.limit(0), p).count() == 0
    assert C.drawn(b.limit(0)).count() == C.merged_stream(b.limit(0)).count() == 0


def test_a_stream_joins_texts_across_pages_and_breaks_at_images(spark):
    q = (1, 1)
    e, i, p = page(spark, [(P, 0, "a", 10.0, 300.0, "F1"), (q, 1, "b", 10.0, 350.0, "F1"), (q, 2, "c", 10.0, 100.0, "F1"), (q, 3, "d", 10.0, 20.0, "F2")], [(q, 1, 20.0, 200.0, 40.0)], False, [P, q])
    b = C.content_blocks(e, i, p)
    got = sorted(C.merged_stream(b).collect(), key=lambda r: r.run)
    assert [(r.text, r.block_type, r.n_blocks, len(r.elements)) for r in got] == [("a\nb", "text", 2, 2), (None, "image", 1, 0), ("c", "text", 1, 1), ("d", "text", 1, 1)]
    assert (got[0].y, got[0].height, got[0].page_num) == (300.0, 60.0, 0)
    assert [r.text for r in sorted(C.flattened(b).collect(), key=lambda r: r.stream_seq)] == ["a", "b", None, "c", "d"]


def test_layouts_chain(spark):
    e, i, p = page(spark, [(P, 0, "a", 10.0, 300.0, "F1"), (P, 1, "b", 200.0, 295.0, "F1")], [(P, 1, 20.0, 298.0, 40.0)])
    b = C.content_blocks(e, i, p)
    moved = b.drop("y").join(L.adjust_layout(b, "flow_down", page=L.PAGE).withColumnRenamed("new_y", "y"), [*L.PAGE, "block_seq"])
    assert L.overlaps(b, L.PAGE).count() > 0 and L.overlaps(moved, L.PAGE).count() == 0
    assert L.adjust_layout(b, "fit_content", page=L.PAGE).count() == b.count()


def box(spark, text, width, height, size):
    return spark.createDataFrame([(1, 0, 1, "text", 10.0, 50.0, width, height, "F1", size, None, text, None, None)], f"doc_id int, page_num int, block_seq int, block_type string, x double, y double, width double, height double, font string, font_size double, color {C.COLOR}, text string, elements array<string>, image string")


@pytest.mark.parametrize("text, width, height, want", [("fits", 100.0, 20.0, 12.0), ("", 1.0, 1.0, 12.0), (None, 1.0, 1.0, 12.0), ("far too long for its box " * 4, 120.0, 60.0, 9.0), ("never " * 100, 20.0, 10.0, 12.0)])
def test_content_keeps_its_size_where_it_fits(spark, text, width, height, want):
    assert C.fit_content(box(spark, text, width, height, 12.0)).first().font_size == want


@pytest.mark.parametrize("align, x", [("left", 10.0), ("center", 10.0 + (100.0 - 2 * 15 * 0.6) / 2), ("right", 110.0 - 2 * 15 * 0.6)])
def test_lines_are_drawn_from_the_top(spark, align, x):
    got = C.drawn(box(spark, "aa\n\nbb", 100.0, 90.0, 12.0), fitting.Fit(align=align)).orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.size) for r in got] == [(1, "aa", 15.0), (3, "bb", 15.0)]
    assert [r.x for r in got] == pytest.approx([x, x]) and [r.y for r in got] == pytest.approx([140.0 - 18, 140.0 - 54])


def test_a_text_without_room_is_drawn_as_it_is(spark):
    got = C.drawn(box(spark, "never " * 100, 20.0, 10.0, 12.0)).collect()
    assert [(r.x, r.y, r.size, r.line_no) for r in got] == [(10.0, 50.0, 12.0, 1)]


def test_long_documents_take_linear_time(spark):
    def blocks(n):
        return spark.range(n).selectExpr("1L as doc_id", "cast(id / 1000 as int) as page_num", "cast(id % 1000 as int) as block_seq", "'text' as block_type", "0D as x", "cast(1000 - id % 1000 as double) as y", "10D as width", "1D as height", "concat('F', id % 2) as font", "10D as font_size", f"cast(null as {C.COLOR}) as color", "'t' as text", "cast(null as array<string>) as elements", "cast(null as string) as image")

    took = {}
    for n in (1000, 100_000):
        began = time.time()
        assert C.merged_stream(blocks(n)).count() == n
        assert L.split_pages(blocks(n), page=("doc_id",)).agg(F.max("out_page")).first()[0] == (n - 1) // 73
        took[n] = time.time() - began
    assert took[100_000] < 30 + 20 * took[1000]


def test_a_scan_refuses_names_in_use_and_groups_null_keys(spark):
    d = spark.createDataFrame([(1, 1), (None, 2), (None, 1), (1, 3)], "k int, v int")
    step = lambda s, v: ((s or 0) + v, ((s or 0) + v,))
    got = segmented_scan(d, ["k"], ["v"], ["v"], step, "total int").collect()
    assert sorted(((r.k or 0), r.v, r.total) for r in got) == [(0, 1, 1), (0, 2, 3), (1, 1, 1), (1, 3, 4)]
    assert segmented_scan(d.limit(0), ["k"], ["v"], ["v"], step, "total int").count() == 0
    with pytest.raises(ValueError):
        segmented_scan(d, ["k"], ["v"], ["v"], step, "V int")


def test_blocks_are_laid_out_once_to_be_drawn(spark):
    """Texts and images of a page go one way: blocks are read once, by no union, and a text is fitted once."""
    e, i, p = page(spark, [(P, 0, "a b", 10.0, 300.0, "F1"), (P, 1, "c", 10.0, 100.0, "F1")], [(P, 1, 20.0, 150.0, 40.0)])
    b = C.content_blocks(e, i, p).drop("elements", "image")
    out = C.drawn(b.localCheckpoint(), fitting.Fit(align="right"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1
    assert [(r["rank"], r.kind, r.text, r.width) for r in out.orderBy("rank", "line_no").collect()] == [(1, "text", "a b", None), (2, "image", None, 50.0), (3, "text", "c", None)]


ODD = ["a b  c\n\n d", "", " ", None, "ab\x1cc\xa0d　e \x85f", "é\U0001f600 x\nyy zz", "word " * 50, "long" * 30 + " a b"]


@pytest.mark.parametrize("wide, size", [(30.0, 10.0), (6.0, 10.0), (-1.0, 5.0), (None, 5.0), (30.0, None), (float("nan"), 5.0), (30.0, float("nan")), (float("inf"), 9.0), (13.200000000000001, 1.1)])
def test_lines_are_those_of_a_fold(spark, wide, size):
    d = spark.createDataFrame([(i, t, wide, size) for i, t in enumerate(ODD)], "i int, text string, wide double, size double")
    fits = "octet_length(concat(element_at(a, -1), ' ', w)) * (size * 0.6D) <= wide"
    fold = f"aggregate(filter(split(p, '(?U)\\\\s+'), w -> w <> ''), cast(array() as array<string>), (a, w) -> if(size(a) > 0 and {fits}, concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), ' ', w))), concat(a, array(w))))"
    want = F.expr(f"flatten(transform(split(text, '\\n'), p -> if(p = '', array(''), {fold})))")
    rows = d.select("text", want.alias("want"), fitting.lines("text", "wide", "size").alias("got"), fitting.line_count("text", "wide", "size").alias("n")).collect()
    for r in rows:
        assert r.got == r.want and r.n == (None if r.want is None else len(r.want)), (r.text, wide, size)


def test_counted_blocks_merge_as_those_with_elements(spark):
    e, i, p = page(spark, [(P, 0, "a", 10.0, 300.0, "F1"), (P, 1, "b", 10.0, 290.0, "F1"), (P, 2, "c", 10.0, 100.0, "F1"), ((2, 0), 0, "d", 10.0, 100.0, "F2")], [(P, 1, 20.0, 150.0, 40.0), ((3, 0), 1, 20.0, 150.0, 40.0)], True)
    whole, counted = (C.merged_stream(C.content_blocks(e, i, p, nested=n, parts=3)).orderBy("doc_id", "run").collect() for n in (True, False))
    assert [len(r.elements) for r in whole] == [r.n_elements for r in counted] and sum(r.n_elements for r in counted) == 4
    assert [(r.text, r.x, r.y, r.width, r.height) for r in whole] == [(r.text, r.x, r.y, r.width, r.height) for r in counted]


def test_a_split_stream_makes_its_blocks_once(spark):
    e, i, p = page(spark, [(P, 0, "a", 10.0, 300.0, "F1"), (P, 1, "b", 10.0, 100.0, "F1")], [(P, 1, 20.0, 150.0, 40.0)])
    out = C.split_stream(C.content_blocks(e, i, p, parts=3))
    assert out._jdf.queryExecution().executedPlan().toString().count("Union") == 1
    assert [(r.text, len(r.elements or []), r.out_page, r.y) for r in out.orderBy("block_seq").collect()] == [("a", 1, 0, 782.0), ("b", 1, 0, 712.0), (None, 0, 0, 732.0)]


def test_blocks_in_more_parts_are_the_same(spark):
    e, i, p = page(spark, [((d, 0), 0, f"w{d}", 10.0, 300.0, "F1") for d in range(20)], [((d, 0), 1, 20.0, 150.0, 40.0) for d in range(0, 20, 3)])
    few, many = (C.content_blocks(e, i, p, parts=n) for n in (2, 31))
    assert many.rdd.getNumPartitions() == 31 and sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


@pytest.mark.parametrize("height", [5.0, 30.0, 200.0, None])
def test_a_smaller_size_is_that_of_a_text_too_high_only(spark, height):
    b = spark.createDataFrame([(t, 60.0, height, s) for t in ("some words in a box", "", "one", None) for s in (8.0, 12.0, None)], "text string, width double, height double, font_size double")
    fit = fitting.Fit(padding=0.0)
    high = fitting.line_count("text", "width", "font_size") * (F.col("font_size") * F.lit(1.2))
    want = F.when(high > F.col("height"), fitting.fitted_size("text", "width", "height", fit, most="font_size"))
    assert all(r.a == r.b for r in b.select(want.alias("a"), fitting.smaller_size("text", "width", "height", "font_size", fit).alias("b")).collect())

"""Derived tables: what is moved to lay out pages."""

from __future__ import annotations

from pageloom.operators import content as C
from pageloom.operators import joins
from pageloom.operators import layout as L
from pageloom.operators import wrapping
from pageloom.plans import contents, marks
from pageloom.sources import derived

SMALL = "/root/testdata/sf0.001"


def test_no_element_is_dealt_out_again(spark):
    e = derived.elements(spark, SMALL)
    for out in (L.text_blocks(e), L.page_text(e)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id#" in plan and "page_num" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_parts_grow_with_the_texts(spark, monkeypatch):
    few = derived.documents(spark, SMALL).rdd.getNumPartitions()
    monkeypatch.setattr(derived, "PART", 10_000)
    assert derived.documents(spark, SMALL).rdd.getNumPartitions() > few


def test_pages_are_those_of_the_elements(spark):
    want = derived.elements(spark, SMALL).select("doc_id", "page_num").distinct().collect()
    got = derived.pages(spark, SMALL).select("doc_id", "page_num").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.doc_id for r in derived.images(spark, SMALL).collect()} == {r.doc_id for r in want if r.doc_id % 3 == 0}


def test_a_gap_counts_within_a_line_only(spark):
    rows = [(1, 0, 0, "a", 0.0, 100.0), (1, 0, 1, "b", 100.0, 100.0), (1, 0, 2, "c", 400.0, 50.0), (1, 0, 3, "d", 0.0, 0.0)]
    e = spark.createDataFrame([(*r, 10.0, 10.0, 10.0, "F1") for r in rows], "doc_id int, page_num int, elem_seq int, text string, x double, y double, width double, height double, size double, font string")
    assert [(r.line_no, r.text) for r in L.lines(e).orderBy("line_no").collect()] == [(1, "a b"), (2, "c"), (3, "d")]


def test_blocks_flow_in_three_sorts_of_one_part_each(spark, monkeypatch):
    """No block is dealt out twice, the order of ranks needs no sort of its own, and parts grow in number with the rows."""
    plan = L.flow_down(derived.blocks(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count(" Sort [") == 3
    few = derived.blocks(spark, SMALL).rdd.getNumPartitions()
    monkeypatch.setattr(derived, "ROWS", 100)
    assert derived.blocks(spark, SMALL).rdd.getNumPartitions() > few


def test_a_scan_takes_groups_where_they_are(spark):
    plan = L.sorted_elements(derived.elements(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_pairs_of_pages_without_images_stay(spark):
    b = C.content_blocks(derived.elements(spark, SMALL), derived.placed_images(spark, SMALL), derived.pages(spark, SMALL))
    b = b.select(*L.PAGE, "block_seq", "x", "y", "width", "height")
    assert sorted(map(tuple, L.overlaps(b, L.PAGE).collect())) == sorted(map(tuple, L.overlaps(b.localCheckpoint(), L.PAGE).collect()))


def test_layers_and_ruby_move_texts_once_and_no_element(spark):
    for name in ("text_layers", "ruby_runs"):
        plan = marks.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 1 and "hashpartitioning(doc_id#" in plan


def test_texts_become_lines_where_they_are(spark, monkeypatch):
    plan = contents.queries()["wrapped_documents"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Generate", "Sort", "Window", "Aggregate"))
    texts = {1: "aa bb cc\n\n \t\ndd\x1cee\u3000f", 2: None, 3: "", 4: " \t ", 5: "abcdefghijkl m\n", 6: None}
    want = [(1, 1, "aa bb"), (1, 2, "cc"), (1, 3, ""), (1, 4, "dd\x1cee"), (1, 5, "f"), (3, 1, ""), (5, 1, "abcdefghijkl"), (5, 2, "m"), (5, 3, "")]
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    for n in (1, 4, 1000):
        monkeypatch.setattr(wrapping, "LINES", n)
        assert sorted(map(tuple, wrapping.wrapped_lines(rows, ["doc_id"], 30.0, 10.0).collect())) == want


def test_pages_dealt_out_as_texts_have_the_same_elements(spark, tmp_path):
    odd = ["", " \n ", "a", "\n b  c\n", " ".join(f"w{i}" for i in range(100)), "  ".join(f"é{i}\n" for i in range(201)), None, "a\tb \x0bc \U0001f600 d"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), SMALL):
        for make in (derived.elements, derived.pages, derived.placed_images):
            plain, paged = make(spark, d), make(spark, d, 7, True)
            assert paged.dtypes == plain.dtypes and paged.rdd.getNumPartitions() == 7
            assert sorted(map(repr, paged.collect())) == sorted(map(repr, plain.collect()))


def test_blocks_are_made_where_their_pages_are(spark):
    plan = contents.queries()["content_blocks"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "hashpartitioning(doc_id#" in plan
    layouts = contents.queries()["page_layouts"](spark, SMALL)
    assert layouts.count() == derived.pages(spark, SMALL).count()
    assert "ENSURE_REQUIREMENTS" not in layouts._jdf.queryExecution().executedPlan().toString()


def test_words_are_translated_where_they_are_and_alike_by_a_large_dictionary(spark, monkeypatch):
    out = marks.queries()["translated_blocks"](spark, SMALL)
    assert "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(repr, out.collect()))
    monkeypatch.setattr(joins, "TEXTS", 0)
    assert sorted(map(repr, marks.queries()["translated_blocks"](spark, SMALL).collect())) == few

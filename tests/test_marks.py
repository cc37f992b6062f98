"""Graphics states, lookups, ordinals, dictionaries, widths, typed values and ruby on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import drawing as D
from pageloom.functions import text as T
from pageloom.functions import typed
from pageloom.operators import cursor, joins
from pageloom.operators import matrix as X
from pageloom.sources import derived

OPS = "doc_id bigint, page_num int, op_seq int, op string, args array<double>"


def states(spark, *ops):
    rows = spark.createDataFrame([(1, 0, i, op, args) for i, (op, args) in enumerate(ops)], OPS)
    return X.graphics_states(rows).orderBy("op_seq").collect()


def test_states_are_saved_and_taken_back(spark):
    shift = [1.0, 0.0, 0.0, 1.0, 5.0, 7.0]
    got = states(spark, ("Q", None), ("cm", [2.0, 0.0, 0.0, 2.0, 0.0, 0.0]), ("q", []), ("cm", shift), ("w", [3.0]), ("Q", None), ("cm", [1.0]), ("cm", [None] * 6), ("RG", [0.5, 0.25, 1.0]), ("Tj", None))
    assert [r.depth for r in got] == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0]
    assert tuple(got[3].ctm) == (2.0, 0.0, 0.0, 2.0, 5.0, 7.0) and got[4].line_width == 3.0
    assert tuple(got[-1].ctm) == (2.0, 0.0, 0.0, 2.0, 0.0, 0.0) and got[-1].line_width == 1.0 and tuple(got[-1].stroke) == (0.5, 0.25, 1.0)


def test_the_first_matrix_outside_saved_states_is_the_pages(spark):
    rows = spark.createDataFrame([(1, 0, 0, "q", None), (1, 0, 1, "cm", [9.0] * 6), (1, 0, 2, "Q", None), (1, 0, 3, "cm", [1.0, 0.0, 0.0, -1.0, 0.0, 9.0]), (1, 0, 4, "cm", [8.0] * 6), (1, 1, 0, "q", None)], OPS)
    assert [(r.page_num, r.page_ctm.d) for r in X.page_matrices(X.graphics_states(rows)).collect()] == [(0, -1.0)]


def test_matrices_undo_themselves(spark):
    m, x, y = X.matrix(2, 0.5, 0.25, -1, 3, 4), F.lit(3.0), F.lit(-2.0)
    there = X.point(m, x, y)
    r = spark.range(1).select(X.point(X.inverse(m), there["x"], there["y"]).alias("p"), X.inverse(X.matrix(1, 1, 1, 1, 0, 0)).alias("flat"), X.multiply(m, X.inverse(m)).alias("one"), X.rectangle(m, x, y, F.lit(1.0), F.lit(2.0)).alias("r")).first()
    assert tuple(r.p) == pytest.approx((3.0, -2.0)) and tuple(r.flat) == X.IDENTITY and tuple(r.one) == pytest.approx(X.IDENTITY)
    assert tuple(r.r) == pytest.approx((8.5, 5.5, 11.0, 8.0))


def test_common_keys_join_as_others_do(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "c"), (None, "n"), (9, "z")], "k int, w string")
    want = sorted(map(repr, left.join(right, "k", "left").collect()))
    for rows in (1, 50, 10_000):
        assert sorted(map(repr, joins.spread_join(left, right, ["k"], rows=rows).collect())) == want
    assert joins.spread_join(left.limit(0), right, ["k"]).count() == 0
    assert joins.spread_join(left, right.limit(0), ["k"], rows=1).where("w is not null").count() == 0


def test_repeated_ranges_and_empty_texts_add_no_rows(spark, tmp_path):
    c = spark.createDataFrame([("A", 5), ("A", 12), ("A", 7)], "font string, code bigint")
    chars = spark.createDataFrame([("A", 7, 70)] * 2, "font string, code bigint, char bigint")
    r = spark.createDataFrame([("A", 1, 0, 9, 100), ("A", 2, 0, 20, 500)] * 3 + [("A", 1, 3, 9, 900)], "font string, range_seq bigint, low bigint, high bigint, start bigint")
    assert sorted(tuple(x) for x in joins.code_map(c, chars, r, ["font"]).collect()) == [("A", 5, 105), ("A", 7, 70), ("A", 12, 512)]
    spark.createDataFrame([(0, ""), (1, "ab"), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.codes for x in derived.coded(spark, str(tmp_path)).collect()} == {0: [], 1: [97, 98], 2: None}


def test_codes_find_their_first_range(spark):
    rng = random.Random(4)
    ranges = [("A", i, lo := rng.randint(-50, 70000), lo + rng.choice([0, 1, 7, 300, 9000, -1]), rng.randint(0, 999)) for i in range(300)] + [("A", 900, None, 5, 1), ("B", 1, 0, 1 << 40, 7)]
    codes = [("A", rng.randint(-60, 80000)) for _ in range(500)] + [("A", None), ("B", 1 << 39), ("B", 5), ("B", 5), ("C", 5), (None, 5)]
    r = spark.createDataFrame(ranges, "font string, range_seq bigint, low bigint, high bigint, start bigint")
    c = spark.createDataFrame(codes, "font string, code bigint")
    want = {}
    for f, code in codes:
        hit = min(((s, lo) for g, s, lo, hi, _ in ranges if g == f and None not in (lo, code) and lo <= code <= hi), default=None)
        if hit:
            want[f, code] = (hit[0], code - hit[1])
    out = joins.range_lookup(c, r, ["font"])
    assert {(x.font, x.code): (x.range_seq, x.offset) for x in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert joins.range_lookup(c, r.limit(0), ["font"]).count() == 0


def test_strings_are_decoded(spark):
    strings = spark.createDataFrame([(1, "A", [1, 2, 3, 65, 1]), (2, "A", []), (3, "A", None), (4, "B", [1, 0x1F600])], "id int, font string, codes array<bigint>")
    chars = spark.createDataFrame([("A", 1, 233)], "font string, code bigint, char bigint")
    ranges = spark.createDataFrame([("A", 2, 1, 2, 0x3041), ("A", 1, 2, 2, 0x4E00), ("A", 3, 3, 9, 0x1F600)], "font string, range_seq bigint, low bigint, high bigint, start bigint")
    got = {r.id: r.text for r in joins.decoded(strings, chars, ranges, ["font"], ["id"]).collect()}
    assert got == {1: "é一\U0001f600Aé", 2: "", 3: "", 4: "\x01\U0001f600"}


def test_each_text_is_translated_once(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", None, "a", "c", ""] * 5)], "id int, text string")
    words = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", None), (None, "n"), ("", "empty")], "source string, target string")
    got = {r.id: r.text for r in joins.translated(rows, words).collect()}
    assert [got[i] for i in range(6)] == ["y", "b", None, "y", "c", "empty"] and len(got) == 30
    by_code = {r.id: r.text for r in joins.translate_with(rows, lambda t: t.upper() if t != "c" else None).collect()}
    assert [by_code[i] for i in range(6)] == ["A", "B", None, "A", "c", ""]


def test_widths_add_up(spark):
    rows = spark.createDataFrame([("abé", "F", 10.0), ("", "F", 10.0), (None, "F", 10.0), ("a", "G", 10.0), ("a", None, 10.0), ("\U0001f600a", "F", 20.0)], "text string, font string, size double")
    widths = spark.createDataFrame([("F", 97, 100.0), ("F", 98, 300.0), ("F", 233, 600.0), ("F", 0x1F600, 1.0)], "font string, code int, advance double")
    got = [(r.text, r.font, r.width) for r in joins.text_widths(rows, widths).collect()]
    assert sorted(got, key=repr) == sorted([("abé", "F", 10.0), ("", "F", 0.0), (None, "F", None), ("a", "G", 5.0), ("a", None, None), ("\U0001f600a", "F", 12.0)], key=repr)


def test_ordinals_number_all_rows(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = cursor.ordinals(d, "k", F.desc("v"))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [tuple(r) for r in got.orderBy("ordinal").select("k", "v").collect()] == want
    assert sorted(r.ordinal for r in got.collect()) == list(range(500))
    pages = [[tuple(r) for r in cursor.page(got, n, 120).orderBy("ordinal").select("k", "v").collect()] for n in range(6)]
    assert pages == [want[:120], want[120:240], want[240:360], want[360:480], want[480:], []]
    assert cursor.ordinals(d.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        cursor.ordinals(d, "k", name="V")
    with pytest.raises(ValueError):
        cursor.page(got, -1, 5)


def test_rows_after_a_key(spark):
    d = spark.createDataFrame([(a, b) for a in range(5) for b in range(5)], "a int, b int")
    assert [tuple(r) for r in cursor.after(d, ["a", "b"], (1, 3), 4).collect()] == [(1, 4), (2, 0), (2, 1), (2, 2)]
    assert cursor.after(d, ["a", "b"], (4, 4), 4).count() == 0


def test_types_are_not_cast(spark):
    d = spark.createDataFrame([("1",), ('"1"',), ("true",), ("null",), (None,), ("1.5",)], "j string").select(F.parse_json("j").alias("v"))
    got = [tuple(r.x) for r in d.select(typed.extract_as(F.col("v"), "bigint").alias("x")).collect()]
    assert got == [(1, True), *[(None, False)] * 5]
    assert d.limit(1).select(typed.must_extract_as(F.col("v"), "bigint", "first")).first()[0] == 1
    with pytest.raises(Exception, match="first: expected type string, got bigint"):
        d.limit(1).select(typed.must_extract_as(F.col("v"), "string", "first")).collect()
    with pytest.raises(ValueError):
        typed.extract_as(F.col("v"), "date")


def test_ruby_advances(spark):
    d = spark.createDataFrame([(1, 0, "ab", "x"), (1, 1, "c", "long ruby"), (1, 2, "d", "")], "k int, pair_seq int, base string, ruby string")
    got = D.ruby_run(d, ["k"], F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit("F1")).orderBy("pair_seq").collect()
    assert [r.base_x for r in got] == pytest.approx([0.0, 12.0, 39.0]) and got[1].ruby_x == pytest.approx(12.0 + (6.0 - 27.0) / 2) and got[0].ruby_y == 11.0
    pairs = spark.createDataFrame([(["a", "b", "c"],), ([],), (["a"],)], "t array<string>").select(D.ruby_pairs(F.col("t")).alias("p"))
    assert [[tuple(x) for x in r.p] for r in pairs.collect()] == [[("a", "b")], [], []]


def test_presets_and_fonts(spark):
    words = [T.preset(n) for n in ("default", "restricted", "print_only")]
    got = [tuple(r.f) for r in spark.createDataFrame([(w,) for w in words], "w int").select(T.permission_flags(F.col("w")).alias("f")).collect()]
    assert got == [(True,) * 8, (False,) * 8, (True, *(False,) * 6, True)]
    fonts = spark.createDataFrame([("Symbol",), ("Courier",), ("Arial",), (None,)], "n string").select(D.standard_font(F.col("n")).alias("f"), D.is_standard_font(F.col("n")).alias("ok"))
    assert [(r.f and r.f.encoding, r.ok) for r in fonts.collect()] == [("BuiltIn", True), ("WinAnsiEncoding", True), (None, False), (None, False)]
    assert spark.createDataFrame([("a b\té\n",), ("\x00​x",), ("",)], "t string").select(T.unprintable(F.col("t"))).collect() == [(0,), (2,), (0,)]


def test_characters_are_never_rows(spark):
    """Strings and rows stay where they are: no exchange has a row for each character."""
    strings = spark.range(40).selectExpr("cast(id % 2 as string) as font", "id", "transform(sequence(1, 3000), i -> if(id % 3 = 0, null, cast(97 + (i + id) % 20 as bigint))) as codes")
    chars = spark.createDataFrame([("0", 100, 233), ("1", 101, 0x1F600)], "font string, code bigint, char bigint")
    ranges = spark.createDataFrame([("0", 1, 110, 112, 0x3041)], "font string, range_seq bigint, low bigint, high bigint, start bigint")
    one = {(f, c): chr(c) for f in "01" for c in range(97, 117)} | {("0", 100): "é", ("1", 101): "\U0001f600"} | {("0", c): chr(0x3041 + c - 110) for c in (110, 111, 112)}
    want = {i: "" if i % 3 == 0 else "".join(one[str(i % 2), 97 + (k + i) % 20] for k in range(1, 3001)) for i in range(40)}
    for bound in (0, 1000):
        out = joins.decoded(strings, chars, ranges, ["font"], ["id"], broadcast_rows=bound)
        assert {r.id: r.text for r in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_widths_of_few_and_many_advances(spark, monkeypatch):
    rows = spark.createDataFrame([("abca", "F", 10.0, 1), ("a" * 1000, "G", 2.0, 2), ("aa", "F", None, 3), (None, "F", 1.0, 4), ("", "G", 1.0, 5), ("x", "H", 1.0, 6)], "text string, font string, size double, id int")
    widths = spark.createDataFrame([("F", 97, 100.0), ("F", 97, 90.0), ("F", 98, None), ("G", 97, 1.0), (None, 97, 7.0)], "font string, code int, advance double")
    got = []
    for bound in (0, 1000):
        monkeypatch.setattr(joins, "BROADCAST", bound)
        out = joins.text_widths(rows, widths, default=500.0)
        got.append(sorted((r.id, r.width) for r in out.collect()))
    assert got[0] == got[1] == [(1, 12.0), (2, 2.0), (3, None), (4, None), (5, 0.0), (6, 0.5)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()

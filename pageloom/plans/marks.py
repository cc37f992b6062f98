"""Queries on drawing operators, codes, ordinals, dictionaries, widths and typed values; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions import drawing as D
from pageloom.functions import text as T
from pageloom.functions import typed
from pageloom.operators import cursor, joins
from pageloom.operators import layout as L
from pageloom.operators import matrix as X
from pageloom.plans.tables import BLOCKS, ELEMENTS, text_block_ctes
from pageloom.sources.derived import PAGED, blocks, code_ranges, coded, elements, images, operators, parts, table

_KEY = (*L.PAGE, "elem_seq")


def _states(spark, d):
    s = X.graphics_states(operators(spark, d))
    box = X.rectangle(F.col("ctm"), F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(8.0))
    back = X.inverse(F.col("ctm"))
    return s.select(*L.PAGE, "op_seq", "op", "depth", "ctm.*", "line_width", F.col("fill.r").alias("red"), F.col("fill.g").alias("green"), box["min_x"].alias("min_x"), box["min_y"].alias("min_y"), box["max_x"].alias("max_x"), box["max_y"].alias("max_y"), back["a"].alias("back_a"), back["e"].alias("back_e"))


def _page_matrices(spark, d):
    return X.page_matrices(X.graphics_states(operators(spark, d))).select(*L.PAGE, "page_ctm.*")


def _single(spark, d):
    """Every fifth code that occurs stands for a character of its own."""
    codes = coded(spark, d).select("font", F.explode(F.array_distinct("codes")).alias("code"))
    return codes.where("code % 5 = 0").distinct().withColumn("char", F.col("code") + 32)


def _code_map(spark, d):
    codes = coded(spark, d).select("font", F.explode(F.array_distinct("codes")).alias("code"))
    return joins.code_map(codes, _single(spark, d), code_ranges(spark, d), ["font"])


def _decoded(spark, d):
    return joins.decoded(coded(spark, d), _single(spark, d), code_ranges(spark, d), ["font"], ["doc_id"])


def _ordinals(spark, d):
    o = cursor.ordinals(elements(spark, d).select(*_KEY, "text"), *_KEY)
    last = F.lead("elem_seq").over(Window.partitionBy("doc_id").orderBy("page_num", "elem_seq")).isNull()
    return o.select(*_KEY, "ordinal", F.floor(F.col("ordinal") / 1000).alias("page"), last.alias("ends_document"), "text")


def _element_page(spark, d):
    o = cursor.ordinals(elements(spark, d).select(*_KEY, "text"), *_KEY)
    return cursor.page(o, 7, 1000)


def _dictionary(spark, d):
    """A made-up language for words of even length."""
    words = elements(spark, d).select("text").distinct().where("octet_length(text) % 2 = 0")
    return words.select(F.col("text").alias("source"), F.concat(F.lit("<"), F.reverse("text"), F.lit(">")).alias("target"))


def _translated(spark, d):
    return joins.translated(elements(spark, d).select(*_KEY, "text"), _dictionary(spark, d))


def _translated_blocks(spark, d):
    """Blocks of words that were translated before they were laid out.

    Pages are dealt out as texts; words that a large dictionary moved are dealt out by page again.
    """
    n = parts(spark, d, PAGED)
    words = joins.translated(elements(spark, d, n, True), _dictionary(spark, d)).repartition(n, *L.PAGE)
    return L.text_blocks(words, images(spark, d, n, True)).select(*L.PAGE, "block_seq", "x", "y", "width", "text")


def _widths(spark, d):
    seen = coded(spark, d).select("font", F.explode(F.array_distinct("codes")).alias("code")).distinct().where("code % 11 <> 0")
    advances = seen.withColumn("advance", F.when(F.col("font") == "F1", 250 + F.col("code") * 37 % 600).otherwise(300 + F.col("code") * 53 % 500).cast("double"))
    return joins.text_widths(elements(spark, d).select(*_KEY, "text", "font", "size"), advances)


def _fonts(spark, d):
    names = F.array(*[F.lit(n) for n in (*D.FONTS, "Arial", "helvetica")])
    c = table(spark, d, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % 16 + 1).cast("int")).alias("font"), "c_nationkey")
    page = D.oriented(F.lit(595.0), F.col("c_nationkey").cast("double"), F.col("c_custkey") % 2 == 0)
    return c.select("c_custkey", "font", D.is_standard_font(F.col("font")).alias("is_standard"), D.standard_font(F.col("font"))["encoding"].alias("encoding"), page["width"].alias("width"), page["height"].alias("height"))


def _typed(spark, d):
    raw = F.expr("case l_linenumber % 5 when 0 then cast(l_partkey as string) when 1 then concat('\"', l_returnflag, '\"') when 2 then if(l_partkey % 2 = 0, 'true', 'false') when 3 then 'null' else concat('{\"k\": ', l_suppkey, '}') end")
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.parse_json(raw).alias("v"))
    number, text = typed.extract_as(F.col("v"), "bigint"), typed.extract_as(F.col("v"), "string")
    checked = typed.must_extract_as(F.when(number["ok"], F.col("v")).otherwise(F.parse_json(F.lit("-1"))), "bigint")
    return v.select("l_orderkey", "l_linenumber", "l_partkey", number["value"].alias("number"), number["ok"].alias("is_number"), text["value"].alias("text"), typed.extract_as(F.col("v"), "boolean")["value"].alias("flag"), typed.mismatch(F.col("v"), "bigint", "line").alias("said"), checked.alias("checked"))


def _drawing(spark, d):
    b = blocks(spark, d)
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    parts = [D.line_width(h / 8), D.stroke_color(x / 1024, y / 1024, h / 64), D.fill_color(h / 64, F.lit(0.5), F.lit(0.25)), F.lit(D.line_cap("round")), F.lit(D.line_join("bevel")), D.line(x, y, x + w, y + h), D.rectangle(x, y, w, h), D.rectangle(x, y, w, h, "both"), D.image(F.concat(F.lit("Im"), "block_seq"), x, y, w, h), D.shown(F.concat(F.lit("(b)"), "block_seq"), x, y, F.col("font"), F.col("font_size"))]
    return b.select("page_id", "block_seq", F.concat_ws("\n", *parts).alias("content"), F.substring(D.circle(x, y, h, "fill"), -1, 1).alias("ends"))


def _text_layers(spark, d):
    e = elements(spark, d).select(*L.PAGE, F.col("elem_seq").alias("word_seq"), "text", "x", "y", "width", F.when(F.col("elem_seq") % 9 == 0, 0.0).otherwise(F.col("height")).alias("height"))
    return D.text_layer(e, [*L.PAGE], (F.lit(1190.0), F.lit(1684.0)), (F.lit(595.0), F.lit(842.0)))


def _ruby(spark, d):
    e = elements(spark, d).select("doc_id", "page_num", F.col("elem_seq").alias("pair_seq"), F.col("text").alias("base"), F.when(F.col("elem_seq") % 2 == 0, F.concat("text", "text", "text")).otherwise(F.lit("r")).alias("ruby"))
    return D.ruby_run(e, [*L.PAGE], F.lit(50.0), F.lit(700.0), F.lit(12.0), F.lit("F1"), D.Ruby(copy="both"), marked=True)


def _ruby_pairs(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.expr("filter(split(text, '[ \\\\n]+'), w -> w <> '')").alias("w"))
    pairs = D.ruby_pairs(F.col("w"))
    return words.select("doc_id", F.size(pairs).alias("n"), F.array_join(F.transform(pairs, lambda p: F.concat(p["base"], F.lit("="), p["ruby"])), " ").alias("pairs"))


def _permissions(spark, d):
    named = list(T.PRESETS)
    c = blocks(spark, d).select("page_id", "block_seq", F.element_at(F.array(*[F.lit(T.preset(n)) for n in named]), (F.col("block_seq") % 3 + 1).cast("int")).bitwiseXOR(F.when(F.col("page_id") % 2 == 0, 1 << T.PERMISSION_BITS["copy"]).otherwise(0)).alias("word"))
    return c.select("page_id", "block_seq", "word", T.permission_flags(F.col("word")).alias("p")).select("page_id", "block_seq", "word", "p.*")


def queries():
    return {
        "graphics_states": _states,
        "page_matrices": _page_matrices,
        "code_map": _code_map,
        "decoded_strings": _decoded,
        "element_ordinals": _ordinals,
        "element_page": _element_page,
        "translated_elements": _translated,
        "translated_blocks": _translated_blocks,
        "text_widths": _widths,
        "standard_fonts": _fonts,
        "typed_values": _typed,
        "drawing_operators": _drawing,
        "text_layers": _text_layers,
        "ruby_runs": _ruby,
        "ruby_pairs": _ruby_pairs,
        "permission_flags": _permissions,
        "printable": lambda s, d: table(s, d, "documents").select("doc_id", T.unprintable(F.concat("text", F.lit("\x01​"))).alias("n_unprintable")),
    }


_OPERATORS = """ops AS (SELECT l_orderkey // 10 AS doc_id, CAST(l_orderkey % 10 AS INT) AS page_num, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS op_seq,
 CASE (l_partkey + l_linenumber) % 7 WHEN 0 THEN 'q' WHEN 1 THEN 'Q' WHEN 2 THEN 'w' WHEN 3 THEN 'rg' WHEN 4 THEN 'q' ELSE 'cm' END AS op,
 {'a': 1 + (l_suppkey % 3 - 1) * CAST(0.5 AS DOUBLE), 'b': (l_partkey % 3 - 1) * CAST(0.25 AS DOUBLE), 'c': l_linenumber % 2 * CAST(0.5 AS DOUBLE), 'd': CAST(CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE), 'e': CAST(l_quantity AS DOUBLE), 'f': CAST(l_partkey % 100 AS DOUBLE)} AS m,
 CAST(l_partkey % 8 AS DOUBLE) AS w, l_partkey % 4 / CAST(4 AS DOUBLE) AS r, l_suppkey % 4 / CAST(4 AS DOUBLE) AS g FROM lineitem)"""
#: Up to st, each operator's state s = (ctm, width, red, green) and the list of saved ones.
_STATES = f"""WITH RECURSIVE {_OPERATORS}, o AS MATERIALIZED (SELECT * FROM ops),
st AS (SELECT doc_id, page_num, 0 AS op_seq, '' AS op, {{'m': {{'a': 1.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'd': 1.0::DOUBLE, 'e': 0.0::DOUBLE, 'f': 0.0::DOUBLE}}, 'w': 1.0::DOUBLE, 'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE}} AS s,
 CAST([] AS STRUCT(m STRUCT(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, f DOUBLE), w DOUBLE, r DOUBLE, g DOUBLE)[]) AS saved FROM (SELECT DISTINCT doc_id, page_num FROM o) UNION ALL
SELECT o.doc_id, o.page_num, o.op_seq, o.op, CASE WHEN o.op = 'Q' AND len(saved) > 0 THEN saved[len(saved)]
 WHEN o.op = 'cm' THEN {{'m': {{'a': s.m.a * o.m.a + s.m.b * o.m.c, 'b': s.m.a * o.m.b + s.m.b * o.m.d, 'c': s.m.c * o.m.a + s.m.d * o.m.c, 'd': s.m.c * o.m.b + s.m.d * o.m.d, 'e': s.m.e * o.m.a + s.m.f * o.m.c + o.m.e, 'f': s.m.e * o.m.b + s.m.f * o.m.d + o.m.f}}, 'w': s.w, 'r': s.r, 'g': s.g}}
 WHEN o.op = 'w' THEN {{'m': s.m, 'w': o.w, 'r': s.r, 'g': s.g}} WHEN o.op = 'rg' THEN {{'m': s.m, 'w': s.w, 'r': o.r, 'g': o.g}} ELSE s END,
 CASE WHEN o.op = 'q' THEN list_append(saved, s) WHEN o.op = 'Q' AND len(saved) > 0 THEN list_slice(saved, 1, len(saved) - 1) ELSE saved END
 FROM st JOIN o ON o.doc_id = st.doc_id AND o.page_num = st.page_num AND o.op_seq = st.op_seq + 1)"""
_CORNERS = {a: ", ".join(f"s.m.{p} * {x} + s.m.{q} * {y} + s.m.{r}" for x in (1, 5) for y in (2, 10)) for a, (p, q, r) in {"x": "ace", "y": "bdf"}.items()}
_CODED = """coded AS (SELECT doc_id, 'F' || CAST(1 + doc_id % 2 AS VARCHAR) AS font, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
codes AS (SELECT DISTINCT font, CAST(unicode(ch) AS BIGINT) AS code FROM coded),
ranges AS (SELECT 'F' || CAST(1 + p_partkey % 2 AS VARCHAR) AS font, p_partkey AS range_seq, p_partkey * 37 % 400 AS low, p_partkey * 37 % 400 + p_partkey % 60 AS high, 65 + p_partkey % 500 AS start FROM part),
found AS (SELECT c.font, c.code, CASE WHEN c.code % 5 = 0 THEN c.code + 32 ELSE CAST(arg_min(start + code - low, range_seq) AS BIGINT) END AS char FROM codes c LEFT JOIN ranges r ON r.font = c.font AND c.code BETWEEN low AND high GROUP BY c.font, c.code)"""
_TARGET = "CASE WHEN strlen(text) % 2 = 0 THEN '<' || reverse(text) || '>' ELSE text END"


def oracle_sql():
    flags = ", ".join(f"word & {1 << b} <> 0 AS {n}" for n, b in T.PERMISSION_BITS.items())
    words = f"[{', '.join(str(T.preset(n)) for n in T.PRESETS)}][block_seq % 3 + 1]"
    names = "[" + ", ".join(f"'{n}'" for n in (*D.FONTS, "Arial", "helvetica")) + "]"
    return {
        "graphics_states": f"""{_STATES} SELECT doc_id, page_num, op_seq, op, CAST(len(saved) AS INT) AS depth, s.m.a AS a, s.m.b AS b, s.m.c AS c, s.m.d AS d, s.m.e AS e, s.m.f AS f, s.w AS line_width, s.r AS red, s.g AS green,
 least({_CORNERS["x"]}) AS min_x, least({_CORNERS["y"]}) AS min_y, greatest({_CORNERS["x"]}) AS max_x, greatest({_CORNERS["y"]}) AS max_y,
 CASE WHEN abs(s.m.a * s.m.d - s.m.b * s.m.c) < CAST(0.0001 AS DOUBLE) THEN 1 ELSE s.m.d / (s.m.a * s.m.d - s.m.b * s.m.c) END AS back_a,
 CASE WHEN abs(s.m.a * s.m.d - s.m.b * s.m.c) < CAST(0.0001 AS DOUBLE) THEN 0 ELSE (s.m.c * s.m.f - s.m.d * s.m.e) / (s.m.a * s.m.d - s.m.b * s.m.c) END AS back_e FROM st WHERE op_seq > 0""",
        "page_matrices": f"""{_STATES}, p AS (SELECT st.doc_id, st.page_num, arg_min(o.m, st.op_seq) AS m FROM st JOIN o ON o.doc_id = st.doc_id AND o.page_num = st.page_num AND o.op_seq = st.op_seq WHERE st.op = 'cm' AND len(saved) = 0 GROUP BY ALL)
SELECT doc_id, page_num, m.a AS a, m.b AS b, m.c AS c, m.d AS d, m.e AS e, m.f AS f FROM p""",
        "code_map": f"WITH {_CODED} SELECT font, code, char FROM found WHERE char IS NOT NULL",
        "decoded_strings": f"""WITH {_CODED}, t AS (SELECT doc_id, string_agg(chr(CAST(coalesce(char, code) AS INT)), '' ORDER BY i) AS text FROM coded JOIN found ON found.font = coded.font AND found.code = unicode(ch) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(t.text, '') AS text FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id""",
        "element_ordinals": f"""WITH {ELEMENTS}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id, page_num, elem_seq) - 1 AS ordinal, lead(elem_seq) OVER (PARTITION BY doc_id ORDER BY page_num, elem_seq) IS NULL AS ends_document FROM elements)
SELECT doc_id, page_num, elem_seq, ordinal, ordinal // 1000 AS page, ends_document, text FROM o""",
        "element_page": f"WITH {ELEMENTS}, o AS (SELECT doc_id, page_num, elem_seq, text, row_number() OVER (ORDER BY doc_id, page_num, elem_seq) - 1 AS ordinal FROM elements) SELECT * FROM o WHERE ordinal BETWEEN 7000 AND 7999",
        "translated_elements": f"WITH {ELEMENTS} SELECT doc_id, page_num, elem_seq, {_TARGET} AS text FROM elements",
        "translated_blocks": f"""WITH {text_block_ctes(True)}, tl AS (SELECT doc_id, page_num, line_no, string_agg(CASE WHEN piece <> text THEN ' ' ELSE '' END || {_TARGET}, '' ORDER BY rank) AS t FROM e6 GROUP BY ALL)
SELECT l3.doc_id, l3.page_num, block_seq, min(min_x) AS x, min(min_y) AS y, max(max_x) - min(min_x) AS width, string_agg(t, chr(10) ORDER BY l3.line_no) AS text FROM l3 JOIN tl ON tl.doc_id = l3.doc_id AND tl.page_num = l3.page_num AND tl.line_no = l3.line_no GROUP BY l3.doc_id, l3.page_num, block_seq""",
        "text_widths": f"""WITH {ELEMENTS}, c AS (SELECT doc_id, page_num, elem_seq, unicode(ch) AS code, font FROM (SELECT doc_id, page_num, elem_seq, font, unnest(string_split(text, '')) AS ch FROM elements)),
w AS (SELECT doc_id, page_num, elem_seq, sum(CASE WHEN code % 11 = 0 THEN 500 WHEN font = 'F1' THEN 250 + code * 37 % 600 ELSE 300 + code * 53 % 500 END) AS total FROM c GROUP BY ALL)
SELECT e.doc_id, e.page_num, e.elem_seq, text, font, size, CAST(total AS DOUBLE) * size / 1000 AS width FROM elements e JOIN w ON w.doc_id = e.doc_id AND w.page_num = e.page_num AND w.elem_seq = e.elem_seq""",
        "standard_fonts": f"""SELECT c_custkey, font, is_standard, CASE WHEN NOT is_standard THEN NULL WHEN font IN ('Symbol', 'ZapfDingbats') THEN 'BuiltIn' ELSE 'WinAnsiEncoding' END AS encoding, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 595 END AS DOUBLE) AS width, CAST(CASE WHEN c_custkey % 2 = 0 THEN 595 ELSE c_nationkey END AS DOUBLE) AS height
 FROM (SELECT *, {names}[c_custkey % 16 + 1] AS font, c_custkey % 16 < 14 AS is_standard FROM customer)""",
        "typed_values": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 0 THEN CAST(l_partkey AS BIGINT) END AS number, k = 0 AS is_number, CASE WHEN k = 1 THEN l_returnflag END AS text, CASE WHEN k = 2 THEN l_partkey % 2 = 0 END AS flag,
 CASE k WHEN 1 THEN 'line: expected type bigint, got string' WHEN 2 THEN 'line: expected type bigint, got boolean' WHEN 3 THEN 'line: expected type bigint, got void' WHEN 4 THEN 'line: expected type bigint, got object<k: bigint>' END AS said, CASE WHEN k = 0 THEN CAST(l_partkey AS BIGINT) ELSE -1 END AS checked FROM (SELECT *, l_linenumber % 5 AS k FROM lineitem)""",
        "drawing_operators": f"""WITH {BLOCKS} SELECT page_id, block_seq, concat_ws(chr(10), printf('%.2f w', height / 8), printf('%.2f %.2f %.2f RG', x / 1024, y / 1024, height / 64), printf('%.2f 0.50 0.25 rg', height / 64), '1 J', '2 j', printf('%.2f %.2f m', x, y), printf('%.2f %.2f l', x + width, y + height), 'S',
 printf('%.2f %.2f %.2f %.2f re', x, y, width, height), 'S', printf('%.2f %.2f %.2f %.2f re', x, y, width, height), 'B', 'q', printf('%.2f 0.00 0.00 %.2f %.2f %.2f cm', width, height, x, y), '/Im' || CAST(block_seq AS VARCHAR) || ' Do', 'Q',
 'BT', '0 0 0 rg', '/' || font || printf(' %.2f Tf', font_size), printf('%.2f %.2f Td', x, y), '(\\(b\\)' || CAST(block_seq AS VARCHAR) || ') Tj', 'ET') AS content, 'f' AS ends FROM blocks""",
        "text_layers": f"""WITH {ELEMENTS}, p AS (SELECT *, CASE WHEN elem_seq % 9 = 0 THEN 0 ELSE height END / 2 AS h FROM elements)
SELECT doc_id, page_num, 'q' || chr(10) || '/GS1 gs' || chr(10) || string_agg(concat_ws(chr(10), 'BT', printf('/F1 %.2f Tf', CASE WHEN h > 0 THEN h ELSE CAST(12 AS DOUBLE) END), '3 Tr', printf('%.2f %.2f Td', x * CAST(0.5 AS DOUBLE), CAST(842 AS DOUBLE) - y * CAST(0.5 AS DOUBLE) - h), '(' || replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)') || ') Tj', 'ET'), chr(10) ORDER BY elem_seq) || chr(10) || 'Q' AS content FROM p GROUP BY doc_id, page_num""",
        "ruby_runs": f"""WITH {ELEMENTS}, p AS (SELECT doc_id, page_num, elem_seq AS pair_seq, text AS base, CASE WHEN elem_seq % 2 = 0 THEN text || text || text ELSE 'r' END AS ruby FROM elements),
q AS (SELECT *, strlen(base) * (CAST(12 AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS wide, strlen(ruby) * (CAST(12 AS DOUBLE) * CAST(0.5 AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS over FROM p),
r AS (SELECT *, greatest(wide, over) AS advance, 50 + coalesce(sum(greatest(wide, over)) OVER (PARTITION BY doc_id, page_num ORDER BY pair_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_x FROM q),
s AS (SELECT *, base_x + (wide - over) / 2 AS ruby_x, CAST(713 AS DOUBLE) AS ruby_y, replace(replace(replace(base, '\\', '\\\\'), '(', '\\('), ')', '\\)') AS eb, replace(replace(replace(ruby, '\\', '\\\\'), '(', '\\('), ')', '\\)') AS er FROM r)
SELECT doc_id, page_num, pair_seq, base, ruby, advance, base_x, ruby_x, ruby_y, concat_ws(chr(10), '/Span <</ActualText (' || eb || '\\(' || er || '\\))>> BDC', 'BT', '0 0 0 rg', '/F1 6.00 Tf', printf('%.2f %.2f Td', ruby_x, ruby_y), '(' || er || ') Tj', 'ET', 'BT', '0 0 0 rg', '/F1 12.00 Tf', printf('%.2f 700.00 Td', base_x), '(' || eb || ') Tj', 'ET', 'EMC') AS content FROM s""",
        "ruby_pairs": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) // 2 AS INT) AS n, array_to_string(list_transform(range(1, len(w) // 2 + 1), lambda i: w[i * 2 - 1] || '=' || w[i * 2]), ' ') AS pairs FROM w""",
        "permission_flags": f"WITH {BLOCKS}, p AS (SELECT page_id, block_seq, xor({words}, CASE WHEN page_id % 2 = 0 THEN 16 ELSE 0 END) AS word FROM blocks) SELECT page_id, block_seq, word, {flags} FROM p",
        "printable": r"SELECT doc_id, CAST(len(regexp_extract_all(text || chr(1) || chr(8203), '[^\p{L}\p{M}\p{N}\p{P}\p{S} \t\n\r]')) AS INT) AS n_unprintable FROM documents",
    }

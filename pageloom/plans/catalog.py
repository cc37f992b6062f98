"""Every query of the layout engine by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions import values as V
from pageloom.operators import layout as L
from pageloom.plans import contents, marks
from pageloom.plans.tables import ANCHORED, BLOCKS, ELEMENTS, LINES, ORDER, TEXT_BLOCK, merged_run_ctes, text_block_ctes
from pageloom.sources import pdf, pdfsink
from pageloom.sources.derived import blocks, elements, images, table

FLAGSHIP = "text_blocks"

def _numbers(spark, d):
    """Ordered quantities of each order: the rows that the collection operators work on."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda r: r["l_quantity"].cast("int")).alias("v"))


def _collections(spark, d):
    v = F.col("v")
    return _numbers(spark, d).select(
        "l_orderkey", F.array_join(F.transform(v, lambda x: x * 2), ",").alias("mapped"), F.array_join(F.filter(v, lambda x: x % 2 == 0), ",").alias("kept"), F.array_join(F.filter(v, lambda x: x % 2 != 0), ",").alias("others"),
        F.aggregate(v, F.lit(0), lambda a, x: a + x).alias("reduced"), F.array_join(F.array_distinct(v), ",").alias("unique"), F.exists(v, lambda x: x > 45).alias("any_over_45"), F.forall(v, lambda x: x > 5).alias("all_over_5"),
        F.try_element_at(F.filter(v, lambda x: x > 30), F.lit(1)).alias("found"), F.array_join(F.flatten(F.transform(v, lambda x: F.array(x, x + 1))), ",").alias("flat"),
    )


def _strings(spark, d):
    dirty = F.concat(F.col("text"), F.lit("\x01 \t end "))
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean(dirty)).alias("clean"), T.has_control(dirty).alias("has_control"), F.md5(T.escape(F.concat(F.lit("(\\"), "text", F.lit(")")))).alias("escaped"), F.md5(T.unescape(T.escape(F.col("text")))).alias("round_trip"), T.width(F.col("text"), 12.0).alias("width"))


def _numbers_of_pages(spark, d):
    b = blocks(spark, d)
    flag = {n: F.col("block_seq") % (i + 2) == 0 for i, n in enumerate(T.PERMISSION_BITS)}
    px = T.pixel_rect(F.col("x"), F.col("y"), F.col("width"), F.col("height"), (1000.0, 1000.0), (500.0, 1000.0))
    return b.select("page_id", "block_seq", T.permissions(flag).alias("word"), *[c.alias(n) for c, n in zip(px, ("px", "py", "pw", "ph"))])


def _dates(spark, d):
    offset = ((F.col("o_orderkey") % 25 - 12) * 60 + F.col("o_orderkey") % 2 * 30).cast("int")
    o = table(spark, d, "orders").select("o_orderkey", V.format_date(F.col("o_orderdate"), offset).alias("formatted"))
    p = V.parse_date(F.col("formatted"))
    return o.select("o_orderkey", "formatted", F.date_format(p["local"], "yyyy-MM-dd HH:mm:ss").alias("parsed"), p["offset_minutes"].alias("offset_minutes"))


def _geometry(spark, d):
    b = blocks(spark, d)
    ruby = V.ruby_layout(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("font_size"), 2.0)
    ink = V.cmyk_to_rgb(F.col("x") / 1024, F.col("y") / 1024, F.col("width") / 1024, F.col("height") / 1024)
    return b.select("page_id", "block_seq", V.position(F.col("y"), 842.0).alias("third"), ruby["ruby_x"].alias("ruby_x"), ruby["ruby_y"].alias("ruby_y"), ruby["advance"].alias("advance"), ink["r"].alias("r"), ink["g"].alias("g"), ink["b"].alias("b"))


def _sealed(spark, d):
    lock = pdfsink.Lock("reader", "owner", T.PERMISSION_BASE | 1 << T.PERMISSION_BITS["print"])
    names = table(spark, d, "supplier").selectExpr("s_suppkey as doc_id", "0 as page_num", "0 as elem_seq", "s_name as text", "50D as x", "700D as y", "12D as size", "'F1' as font")
    return pdf.text_elements(pdfsink.to_pdf(names, lock=lock), "doc_id", "owner").select("doc_id", "text", "x", "y")


def _doc_blocks(spark, d):
    return blocks(spark, d).withColumn("doc_id", F.floor(F.col("page_id") / 10).cast("bigint")).withColumn("page_num", (F.col("page_id") % 10).cast("int"))


def _text_doc_blocks(spark, d):
    b = _doc_blocks(spark, d)
    return b.withColumn("text", F.concat(F.lit("b"), F.col("block_seq").cast("string"))).withColumn("color", F.when(F.col("page_id") % 3 == 0, "red").otherwise("black"))


def _adjusted(spark, d):
    b = blocks(spark, d)
    parts = [L.adjust_layout(b, n).withColumn("strategy", F.lit(n)) for n in ("flow_down", "compact", "even_spacing", "preserve_position")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _keyed(spark, d):
    """Maps from return flag to ordered line numbers: grouping, keys, values and a default."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")), ",").alias("group"))
    m = items.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_returnflag", "group")))).alias("m"))
    default = F.coalesce(F.try_element_at("m", F.lit("R")), F.lit("none"))
    return m.select("l_orderkey", F.array_join(F.map_keys("m"), ";").alias("keys"), F.array_join(F.map_values("m"), ";").alias("groups"), default.alias("returned"))


def _wrapped(spark, d):
    lines = T.wrap("text", 200.0, 10.0)
    return table(spark, d, "benchmark").where("text is not null").select("item_id", F.array_join(lines, "\n").alias("lines"), F.size(lines).alias("n_lines"), (F.size(lines) * F.lit(10.0 * 1.2)).alias("total_height"), T.normalize_space(F.concat("text", F.lit("\t x  y \n z "))).alias("normal"))


def _encoded(spark, d):
    names = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" (\\)")).alias("name"))
    wide = V.encode_string(F.concat(F.lit("é"), F.lit("\U0001f600")))
    return names.select("s_suppkey", V.encode_string(F.col("name")).alias("literal"), V.decode_string(V.encode_string(F.col("name"))).alias("back"), wide.alias("wide"), V.decode_string(wide).alias("wide_back"), V.ruby_text(F.col("name"), F.lit("r")).alias("ruby"))


def _drawn(spark, d):
    b = blocks(spark, d)
    ink = V.rgb(F.col("x"), F.col("y"), F.col("height"))
    word = T.permissions({"print": F.col("block_seq") % 2 == 0})
    return b.select("page_id", "block_seq", V.circle(F.col("x"), F.col("y"), F.col("height")).alias("path"), ink["r"].alias("r"), ink["g"].alias("g"), ink["b"].alias("b"), T.has_permission(word, "print").alias("may_print"))


def queries():
    return {
        "elements": elements,
        "chained_lines": lambda s, d: L.lines(elements(s, d)).drop("sum_size"),
        "text_blocks": lambda s, d: L.text_blocks(elements(s, d), images(s, d)),
        "text_blocks_without_images": lambda s, d: L.text_blocks(elements(s, d)),
        "anchored_lines": lambda s, d: L.anchored_lines(elements(s, d)),
        "page_text": lambda s, d: L.page_text(elements(s, d)),
        "document_text": lambda s, d: L.document_text(elements(s, d)),
        "reading_order": lambda s, d: L.reading_order(blocks(s, d)),
        "overlaps": lambda s, d: L.overlaps(blocks(s, d)),
        "compact": lambda s, d: L.compact(blocks(s, d)),
        "even_spacing": lambda s, d: L.even_spacing(blocks(s, d)),
        "flow_down": lambda s, d: L.flow_down(blocks(s, d)),
        "split_pages": lambda s, d: L.split_pages(blocks(s, d)),
        "merge_across_pages": lambda s, d: L.merge_across_pages(_doc_blocks(s, d)),
        "pdf_elements": lambda s, d: pdf.text_elements(pdfsink.to_pdf(elements(s, d)), "doc_id"),
        "pdf_documents": lambda s, d: pdf.documents(pdfsink.to_pdf(elements(s, d)), "doc_id").select("doc_id", "n_pages", "producer", "encrypted", "error"),
        "dates": _dates,
        "geometry": _geometry,
        "sealed_files": _sealed,
        "collections": _collections,
        "strings": _strings,
        "sorted_elements": lambda s, d: L.sorted_elements(elements(s, d)).select(*L.PAGE, "elem_seq", "line_no", "rank"),
        "sorted_text": lambda s, d: L.sorted_text(elements(s, d)),
        "merged_blocks": lambda s, d: L.merged_blocks(_text_doc_blocks(s, d)),
        "move_block": lambda s, d: L.move_block(blocks(s, d), "text", 1, 5.0, -3.0),
        "resize_block": lambda s, d: L.resize_block(blocks(s, d), "image", 0, 64.0, 48.0),
        "adjust_layout": _adjusted,
        "keyed_collections": _keyed,
        "wrapped_lines": _wrapped,
        "encoded_strings": _encoded,
        "drawn_values": _drawn,
        "permissions_and_pixels": _numbers_of_pages,
    } | contents.queries() | marks.queries()


def _more_sql(sql):
    """SQL of the queries that build on that of others."""
    ranked = f"""WITH RECURSIVE {ELEMENTS}, {ANCHORED}, z AS (SELECT s.doc_id, s.page_num, s.elem_seq, s.text, s.y, s.size, CAST(f.n AS INT) AS line_no, CAST(row_number() OVER (PARTITION BY s.doc_id, s.page_num ORDER BY f.n, s.x, s.elem_seq) AS INT) AS rank
 FROM s JOIN f ON s.doc_id = f.doc_id AND s.page_num = f.page_num AND s.k = f.k)"""
    merge = f"WITH RECURSIVE {BLOCKS}, {merged_run_ctes(True)}"
    place = "block_type = '{}' AND row_number() OVER (PARTITION BY page_id, block_type ORDER BY block_seq) = {}"
    moved, sized = place.format("text", 2), place.format("image", 1)
    curves = [((0, 1), (1, 0)), ((-1, 0), (0, 1)), ((0, -1), (-1, 0)), ((1, 0), (0, -1))]
    path = ["printf('%.2f %.2f m', x + height, y)"]
    for end, start in curves:
        spots = [f"x + height * {start[0]} + k * {end[0]}", f"y + height * {start[1]} + k * {end[1]}", f"x + height * {end[0]} + k * {start[0]}", f"y + height * {end[1]} + k * {start[1]}", f"x + height * {end[0]}", f"y + height * {end[1]}"]
        path.append(f"printf('%.2f %.2f %.2f %.2f %.2f %.2f c', {', '.join(spots)})")
    return {
        "sorted_elements": f"{ranked} SELECT doc_id, page_num, elem_seq, line_no, rank FROM z",
        "sorted_text": f"""{ranked}, v AS (SELECT *, CASE WHEN rank = 1 THEN '' WHEN abs(y - lag(y) OVER (PARTITION BY doc_id, page_num ORDER BY rank)) > size * 0.5 THEN chr(10) ELSE ' ' END || text AS piece FROM z)
SELECT doc_id, page_num, string_agg(piece, '' ORDER BY rank) AS text FROM v GROUP BY ALL""",
        "merged_blocks": f"""{merge} SELECT f.doc_id, f.island, f.run, arg_min(f.page_num, (f.page_num, f.block_seq)) AS page_num, arg_min(f.block_seq, (f.page_num, f.block_seq)) AS block_seq, arg_min(d.block_type, (f.page_num, f.block_seq)) AS block_type, arg_min(d.font, (f.page_num, f.block_seq)) AS font, arg_min(d.font_size, (f.page_num, f.block_seq)) AS font_size,
 min(d.x) AS x, min(d.y) AS y, max(d.x + d.width) - min(d.x) AS width, max(d.y + d.height) - min(d.y) AS height, count(*) AS n_blocks, string_agg(d.text, chr(10) ORDER BY f.page_num, f.block_seq) AS text FROM f JOIN d ON d.doc_id = f.doc_id AND d.page_num = f.page_num AND d.block_seq = f.block_seq GROUP BY 1, 2, 3""",
        "move_block": f"WITH {BLOCKS}, m AS (SELECT *, {moved} AS hit FROM blocks) SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN x + 5 ELSE x END AS x, CASE WHEN hit THEN y - 3 ELSE y END AS y) FROM m",
        "resize_block": f"WITH {BLOCKS}, m AS (SELECT *, {sized} AS hit FROM blocks) SELECT * EXCLUDE (hit) REPLACE (CASE WHEN hit THEN CAST(64 AS DOUBLE) ELSE width END AS width, CASE WHEN hit THEN CAST(48 AS DOUBLE) ELSE height END AS height) FROM m",
        "adjust_layout": " UNION ALL ".join(f"SELECT page_id, block_seq, new_y, '{n}' AS strategy FROM ({sql[n]})" for n in ("flow_down", "compact", "even_spacing")) + f" UNION ALL SELECT page_id, block_seq, y AS new_y, 'preserve_position' AS strategy FROM (WITH {BLOCKS} SELECT * FROM blocks)",
        "keyed_collections": """WITH g AS (SELECT l_orderkey, l_returnflag, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS grp FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(l_returnflag, ';' ORDER BY l_returnflag) AS keys, string_agg(grp, ';' ORDER BY l_returnflag) AS groups, coalesce(max(CASE WHEN l_returnflag = 'R' THEN grp END), 'none') AS returned FROM g GROUP BY 1""",
        "wrapped_lines": r"""WITH p AS (SELECT item_id, text, i, list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '') AS ws, q FROM (SELECT item_id, text, unnest(string_split(text, chr(10))) AS q, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark)),
f AS (SELECT item_id, text, i, q, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(ws, lambda a, w: CASE WHEN strlen(regexp_extract(a, '[^\n]*$') || ' ' || w) * (CAST(10 AS DOUBLE) * CAST(0.6 AS DOUBLE)) <= 200 THEN a || ' ' || w ELSE a || chr(10) || w END) END AS folded FROM p WHERE q = '' OR len(ws) > 0),
l AS (SELECT item_id, any_value(text) AS text, string_agg(folded, chr(10) ORDER BY i) AS lines FROM f GROUP BY 1)
SELECT item_id, lines, CAST(len(string_split(lines, chr(10))) AS INT) AS n_lines, len(string_split(lines, chr(10))) * CAST(12 AS DOUBLE) AS total_height, array_to_string(list_transform(string_split(text || chr(9) || ' x  y ' || chr(10) || ' z ', chr(10)), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), chr(10)) AS normal FROM l""",
        "encoded_strings": r"""SELECT s_suppkey, '(' || s_name || ' \(\\\))' AS literal, s_name || ' (\)' AS back, '<FEFF00E9D83DDE00>' AS wide, 'é' || chr(128512) AS wide_back, s_name || ' (\)(r)' AS ruby FROM supplier""",
        "drawn_values": f"WITH {BLOCKS}, b AS (SELECT *, height * CAST({V.KAPPA!r} AS DOUBLE) AS k FROM blocks) SELECT page_id, block_seq, concat_ws(chr(10), {', '.join(path)}) AS path, x / CAST(255 AS DOUBLE) AS r, y / CAST(255 AS DOUBLE) AS g, height / CAST(255 AS DOUBLE) AS b, block_seq % 2 = 0 AS may_print FROM b",
    }


def oracle_sql():
    bits = " | ".join(f"(CASE WHEN block_seq % {i + 2} = 0 THEN {1 << b} ELSE 0 END)" for i, b in enumerate(T.PERMISSION_BITS.values()))
    sql = {
        "elements": f"WITH {ELEMENTS} SELECT * FROM elements",
        "pdf_elements": f"WITH {ELEMENTS} SELECT * REPLACE (CAST(elem_seq % 100 AS INT) AS elem_seq) FROM elements",
        "pdf_documents": f"WITH {ELEMENTS} SELECT doc_id, CAST(max(page_num) + 1 AS INT) AS n_pages, 'pageloom' AS producer, false AS encrypted, CAST(NULL AS VARCHAR) AS error FROM elements GROUP BY doc_id",
        "chained_lines": f"WITH {LINES} SELECT * EXCLUDE (sum_size) FROM lines",
        "text_blocks": f"WITH {text_block_ctes(True)} {TEXT_BLOCK}",
        "text_blocks_without_images": f"WITH {text_block_ctes(False)} {TEXT_BLOCK}",
        "anchored_lines": f"WITH RECURSIVE {ELEMENTS}, {ANCHORED} SELECT doc_id, page_num, CAST(max(n) AS INT) AS n_lines FROM f GROUP BY ALL",
        "page_text": f"WITH {ELEMENTS} SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY elem_seq) AS text FROM elements GROUP BY ALL",
        "document_text": f"WITH {ELEMENTS}, p AS (SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY elem_seq) AS text FROM elements GROUP BY ALL) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM p GROUP BY ALL",
        "reading_order": f"WITH {ORDER} SELECT * FROM o",
        "overlaps": f"""WITH {ORDER}, p AS (SELECT a.page_id, a.block_seq AS left_block, b.block_seq AS right_block, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS w, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS h FROM o a JOIN o b ON a.page_id = b.page_id AND a.rank < b.rank)
SELECT page_id, left_block, right_block, w * h AS area FROM p WHERE w > 0 AND h > 0""",
        "compact": f"WITH {ORDER} SELECT page_id, block_seq, rank, 822.0 - sum(height) OVER (PARTITION BY page_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - (rank - 1) * CAST(10 AS DOUBLE) AS new_y FROM o",
        "even_spacing": f"""WITH {ORDER}, q AS (SELECT *, 802.0 - sum(height) OVER (PARTITION BY page_id) AS free, count(*) OVER (PARTITION BY page_id) AS n FROM o)
SELECT page_id, block_seq, rank, 822.0 - sum(height) OVER (PARTITION BY page_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - (rank - 1) * (CASE WHEN free < 0 THEN CAST(10 AS DOUBLE) ELSE greatest(free / greatest(n - 1, 1), CAST(10 AS DOUBLE)) END) AS new_y FROM q""",
        "flow_down": f"""WITH RECURSIVE {ORDER}, o2 AS MATERIALIZED (SELECT page_id, block_seq, rank, y, height FROM o), f AS (SELECT page_id, block_seq, rank, y AS new_y FROM o2 WHERE rank = 1 UNION ALL
SELECT o2.page_id, o2.block_seq, o2.rank, CASE WHEN o2.y + o2.height > f.new_y - 10.0 THEN f.new_y - 10.0 - o2.height ELSE o2.y END FROM f JOIN o2 ON o2.page_id = f.page_id AND o2.rank = f.rank + 1) SELECT page_id, block_seq, rank, new_y FROM f""",
        "split_pages": f"""WITH RECURSIVE {ORDER}, o2 AS MATERIALIZED (SELECT page_id, block_seq, rank, height FROM o), f AS (SELECT page_id, block_seq, rank, 0 AS out_page, CAST(822.0 AS DOUBLE) - height AS new_y FROM o2 WHERE rank = 1 UNION ALL
SELECT o2.page_id, o2.block_seq, o2.rank, CASE WHEN f.new_y - 10.0 - o2.height < 20.0 THEN f.out_page + 1 ELSE f.out_page END, CASE WHEN f.new_y - 10.0 - o2.height < 20.0 THEN CAST(822.0 AS DOUBLE) ELSE f.new_y - 10.0 END - o2.height FROM f JOIN o2 ON o2.page_id = f.page_id AND o2.rank = f.rank + 1) SELECT page_id, block_seq, out_page, new_y FROM f""",
        "merge_across_pages": f"WITH RECURSIVE {BLOCKS}, {merged_run_ctes(False)} SELECT doc_id, island, page_num, block_seq, run FROM f",
        "dates": """WITH o AS (SELECT o_orderkey, o_orderdate, CAST((o_orderkey % 25 - 12) * 60 + o_orderkey % 2 * 30 AS INT) AS offset_minutes FROM orders)
SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || CASE WHEN offset_minutes < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(offset_minutes) // 60 AS VARCHAR), 2, '0') || chr(39) || lpad(CAST(abs(offset_minutes) % 60 AS VARCHAR), 2, '0') || chr(39) AS formatted,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed, offset_minutes FROM o""",
        "geometry": f"""WITH {BLOCKS} SELECT page_id, block_seq, CASE WHEN y / 842.0::DOUBLE > 0.66::DOUBLE THEN 'top' WHEN y / 842.0::DOUBLE > 0.33::DOUBLE THEN 'middle' ELSE 'bottom' END AS third, x + (width - height) / 2 AS ruby_x, y + font_size + 2 AS ruby_y, greatest(width, height) AS advance,
 CAST(floor(255.0::DOUBLE * (1 - x / 1024) * (1 - height / 1024)) AS INT) AS r, CAST(floor(255.0::DOUBLE * (1 - y / 1024) * (1 - height / 1024)) AS INT) AS g, CAST(floor(255.0::DOUBLE * (1 - width / 1024) * (1 - height / 1024)) AS INT) AS b FROM blocks""",
        "sealed_files": "SELECT s_suppkey AS doc_id, s_name AS text, CAST(50 AS DOUBLE) AS x, CAST(700 AS DOUBLE) AS y FROM supplier",
        "collections": """WITH n AS (SELECT l_orderkey, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_partkey, l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(v, lambda x: x * 2), ',') AS mapped, array_to_string(list_filter(v, lambda x: x % 2 = 0), ',') AS kept, array_to_string(list_filter(v, lambda x: x % 2 <> 0), ',') AS others, CAST(list_sum(v) AS INT) AS reduced,
 array_to_string(list_transform(list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_position(v, v[i]) = i THEN v[i] END), lambda x: x IS NOT NULL), lambda x: x), ',') AS "unique", len(list_filter(v, lambda x: x > 45)) > 0 AS any_over_45, len(list_filter(v, lambda x: NOT x > 5)) = 0 AS all_over_5, list_filter(v, lambda x: x > 30)[1] AS found, array_to_string(flatten(list_transform(v, lambda x: [x, x + 1])), ',') AS flat FROM n""",
        "strings": r"""SELECT doc_id, md5(regexp_replace(text || chr(1) || ' ' || chr(9) || ' end ', '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS clean, true AS has_control, md5(replace(replace(replace('(\' || text || ')', '\', '\\'), '(', '\('), ')', '\)')) AS escaped, md5(text) AS round_trip, strlen(text) * (CAST(12 AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS width FROM documents""",
        "permissions_and_pixels": f"WITH {BLOCKS} SELECT page_id, block_seq, -3904 | {bits} AS word, x * CAST(0.5 AS DOUBLE) AS px, 1000.0 - y * CAST(1 AS DOUBLE) - height * CAST(1 AS DOUBLE) AS py, width * CAST(0.5 AS DOUBLE) AS pw, height * CAST(1 AS DOUBLE) AS ph FROM blocks",
    }
    return sql | _more_sql(sql) | contents.oracle_sql() | marks.oracle_sql()

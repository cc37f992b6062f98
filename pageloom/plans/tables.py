"""SQL of the derived tables, shared by the SQL of queries: each is the text of common table expressions."""

from __future__ import annotations

ELEMENTS = """words AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS l FROM documents)),
g AS (SELECT doc_id, text, CAST(i AS INT) AS elem_seq, CAST(FLOOR(i / 100) AS INT) AS page_num, CAST(i % 5 AS INT) AS col, CAST(FLOOR((i % 100) / 5) AS INT) AS row_no FROM words),
elements AS (SELECT doc_id, page_num, elem_seq, text, CAST(50 + col * 80 + (doc_id % 7) * 5 + CASE WHEN row_no = 4 THEN 60 ELSE 0 END AS DOUBLE) AS x,
 CAST(800 - row_no * 16 - CASE WHEN row_no >= 10 THEN 12 ELSE 0 END - CASE WHEN row_no >= 15 THEN 40 ELSE 0 END AS DOUBLE) - CASE WHEN doc_id % 4 = 0 THEN col * CAST(1.75 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + ((elem_seq * 7 + doc_id) % 3) * CAST(0.5 AS DOUBLE) AS y,
 strlen(text) * (CAST(10 + 2 * (doc_id % 2) AS DOUBLE) * CAST(0.6 AS DOUBLE)) AS width, CAST(10 + 2 * (doc_id % 2) AS DOUBLE) AS height, CAST(10 + 2 * (doc_id % 2) AS DOUBLE) AS size, CONCAT('F', CAST(1 + doc_id % 2 AS VARCHAR)) AS font FROM g)"""
BLOCKS = """blocks AS (SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS block_seq,
 CASE WHEN l_returnflag = 'R' THEN 'image' ELSE 'text' END AS block_type, CAST(40 + (l_partkey % 5) * 90 AS DOUBLE) AS x, CAST(60 + (l_suppkey * 37 + l_partkey * 11) % 600 AS DOUBLE) AS y, CAST(100 + (l_partkey % 4) * 30 AS DOUBLE) AS width,
 CAST(12 + l_linenumber * 6 AS DOUBLE) AS height, CONCAT('F', CAST(1 + l_suppkey % 2 AS VARCHAR)) AS font, CAST(10 + (l_linenumber % 3) AS DOUBLE) AS font_size FROM lineitem)"""
ORDER = BLOCKS + """, t AS (SELECT *, y + height AS top FROM blocks), b1 AS (SELECT *, lag(top) OVER (PARTITION BY page_id ORDER BY top DESC, x, block_seq) - top AS fall FROM t),
b2 AS (SELECT *, sum(CASE WHEN fall > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY top DESC, x, block_seq ROWS UNBOUNDED PRECEDING) AS band FROM b1),
o AS (SELECT page_id, block_seq, block_type, x, y, width, height, font, font_size, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, x, block_seq) AS INT) AS rank FROM b2)"""
LINES = ELEMENTS + """, e1 AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page_num ORDER BY y DESC, x, elem_seq) - y AS fall FROM elements),
e2 AS (SELECT *, sum(CASE WHEN fall >= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num ORDER BY y DESC, x, elem_seq ROWS UNBOUNDED PRECEDING) AS band FROM e1),
e3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY band, x, elem_seq) AS rank FROM e2),
e4 AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) >= 0.5 * ((size + lag(size) OVER w) / 2) THEN 1 ELSE 0 END AS brk FROM e3 WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY rank)),
e5 AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id, page_num ORDER BY rank ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS line_no FROM e4),
e6 AS (SELECT *, CASE WHEN x - (lag(x) OVER w + lag(width) OVER w) > CAST(0.35 AS DOUBLE) * lag(size) OVER w THEN ' ' ELSE '' END || text AS piece FROM e5 WINDOW w AS (PARTITION BY doc_id, page_num, line_no ORDER BY rank)),
lines AS (SELECT doc_id, page_num, line_no, min(x) AS min_x, max(x + width) AS max_x, min(y) AS min_y, max(y + height) AS max_y, avg(size) AS avg_size, sum(size) AS sum_size, count(*) AS n, arg_min(font, rank) AS font, string_agg(piece, '' ORDER BY rank) AS text FROM e6 GROUP BY ALL)"""


def text_block_ctes(images: bool) -> str:
    """Up to l3, lines with the number of their block."""
    cut = "exists(SELECT 1 FROM img i WHERE i.doc_id = l1.doc_id AND i.page_num = l1.page_num AND up > max_y AND 620.0 <= up AND max_y <= 640.0)" if images else "false"
    return f"""{LINES}, img AS (SELECT DISTINCT doc_id, page_num FROM elements WHERE doc_id % 3 = 0),
l1 AS (SELECT *, lag(min_y) OVER w AS up, lag(min_x) OVER w AS up_x, lag(avg_size) OVER w AS up_size FROM lines WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY line_no)),
l2 AS (SELECT *, CASE WHEN up IS NOT NULL AND NOT (up - max_y <= 1.5 * ((up_size + avg_size) / 2) AND abs(up_x - min_x) <= 50 AND NOT {cut}) THEN 1 ELSE 0 END AS brk FROM l1),
l3 AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id, page_num ORDER BY line_no ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS block_seq FROM l2)"""


TEXT_BLOCK = """SELECT doc_id, page_num, block_seq, min(min_x) AS x, min(min_y) AS y, max(max_x) - min(min_x) AS width, max(max_y) - min(min_y) AS height,
 sum(sum_size) / sum(n) AS font_size, arg_min(font, line_no) AS font, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_no) AS text FROM l3 GROUP BY ALL"""
#: Up to f, each element's line n, that of its first element's y and size; s has the elements in order k.
ANCHORED = """s AS MATERIALIZED (SELECT doc_id, page_num, elem_seq, text, x, y, size, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y DESC, x, elem_seq) AS k FROM elements),
f AS (SELECT doc_id, page_num, k, 1 AS n, y, size FROM s WHERE k = 1 UNION ALL
SELECT s.doc_id, s.page_num, s.k, CASE WHEN abs(s.y - f.y) <= 0.5 * f.size THEN f.n ELSE f.n + 1 END, CASE WHEN abs(s.y - f.y) <= 0.5 * f.size THEN f.y ELSE s.y END, CASE WHEN abs(s.y - f.y) <= 0.5 * f.size THEN f.size ELSE s.size END
 FROM f JOIN s ON s.doc_id = f.doc_id AND s.page_num = f.page_num AND s.k = f.k + 1)"""


def merged_run_ctes(styled: bool) -> str:
    """Up to f, the run of each block of a document inside its island of one kind and font, and colour if styled."""
    style = ", 'b' || CAST(block_seq AS VARCHAR) AS text, CASE WHEN page_id % 3 = 0 THEN 'red' ELSE 'black' END AS color" if styled else ""
    other = " OR color <> lag(color) OVER w" if styled else ""
    return f"""d AS (SELECT *, CAST(page_id // 10 AS BIGINT) AS doc_id, CAST(page_id % 10 AS INT) AS page_num{style} FROM blocks),
c AS (SELECT *, CASE WHEN block_type = 'image' OR block_type <> lag(block_type) OVER w OR font <> lag(font) OVER w OR lag(font) OVER w IS NULL{other} THEN 1 ELSE 0 END AS brk FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, block_seq)),
i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id ORDER BY page_num, block_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM c),
k AS MATERIALIZED (SELECT doc_id, island, page_num, block_seq, font_size, row_number() OVER (PARTITION BY doc_id, island ORDER BY page_num, block_seq) AS k FROM i),
f AS (SELECT doc_id, island, page_num, block_seq, k, 1 AS run, font_size AS base FROM k WHERE k = 1 UNION ALL
SELECT k.doc_id, k.island, k.page_num, k.block_seq, k.k, CASE WHEN abs(k.font_size - f.base) <= 1 THEN f.run ELSE f.run + 1 END, CASE WHEN abs(k.font_size - f.base) <= 1 THEN f.base ELSE k.font_size END
 FROM f JOIN k ON k.doc_id = f.doc_id AND k.island = f.island AND k.k = f.k + 1)"""

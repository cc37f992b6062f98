"""Markdown layout and streaming of new files."""

from __future__ import annotations

from pageloom.operators import markdown as M
from pageloom.sources import pdf, pdfsink
from pageloom.streaming import pdf as stream

TEXT = "# Title #\nFirst *line*\nand `code` **second**\n\n- one [link](u)\n- two\n\n```\n# not a heading\n```\n> quoted\n### Third\n"


def nodes(spark, rows):
    return [tuple(r) for r in M.nodes(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "node_seq").collect()]


def test_nodes(spark):
    assert nodes(spark, [(1, TEXT), (2, None), (3, ""), (4, "plain")]) == [
        (1, 1, 1, "Title"), (1, 2, 0, "First line\nand  second"), (1, 3, 0, "one link"), (1, 4, 0, "two"), (1, 5, 0, "quoted"), (1, 6, 3, "Third"), (4, 1, 0, "plain"),
    ]


def test_layout_breaks_pages_and_becomes_a_file(spark):
    text = "# Head\n\n" + "\n\n".join(f"paragraph {i}" for i in range(60))
    placed = M.layout(M.nodes(spark.createDataFrame([(7, text)], "doc_id long, text string"))).cache()
    y, page, want = 842.0 - 72, 0, []
    for i in range(61):
        size, need, step = (36.0, 48.0, 48.0) if i == 0 else (12.0, 12.0 * 1.2 * 3, 12.0 * 1.2 + 12)
        if y - need < 72:
            y, page = 842.0 - 72, page + 1
        want.append((page, i + 1, y, size))
        y -= step
    assert [tuple(r) for r in placed.orderBy("elem_seq").select("page_num", "elem_seq", "y", "size").collect()] == want
    back = pdf.text_elements(pdfsink.to_pdf(placed), "doc_id").orderBy("page_num", "elem_seq").collect()
    assert [(r["page_num"], r["text"]) for r in back] == [(p, "Head" if k == 1 else f"paragraph {k - 2}") for p, k, _, _ in want]


def test_new_files_are_read_once(spark, tmp_path):
    inbox, out, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    (tmp_path / "in").mkdir()
    for n in "ab":
        (tmp_path / "in" / f"{n}.pdf").write_bytes(pdfsink.assembled([b"BT /F1 8 Tf 1 2 Td (%s) Tj ET" % n.encode()], ["F1"], {}, (595, 842)))
        stream.text_elements(spark, inbox, out, seen).awaitTermination(60)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a", "b"]

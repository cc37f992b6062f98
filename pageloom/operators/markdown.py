"""Markdown as headings and paragraphs placed on pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.operators.scan import segmented_scan


class Style(NamedTuple):
    """Sizes in points: headings from level 1 to 6, body text, spacing and margins."""

    headings: tuple[float, ...] = (36.0, 28.0, 22.0, 18.0, 14.0, 12.0)
    body: float = 12.0
    line_spacing: float = 1.2
    paragraph_spacing: float = 12.0
    margin: float = 72.0
    page_height: float = 842.0


#: Larger type and narrower margins, for slides.
SLIDES = Style((48.0, 36.0, 28.0, 24.0, 20.0, 18.0), 18.0, 1.3, 18.0, 50.0, 540.0)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each Markdown file of a folder or glob, one row a file, for nodes() with the key path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def inline_text(text: Column) -> Column:
    """Text without marks of emphasis, links and images; code spans go with what they hold."""
    for pattern, kept in ((r"`+[^`]*`+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*\*\*|\*\*|\*)(?=\S)(.+?)(?<=\S)\1", "$2"), (r"\b(__|_)(?=\S)(.+?)(?<=\S)\1\b", "$2"), (r"\\([\\`*_{}\[\]()#+.!-])", "$1")):
        text = F.regexp_replace(text, pattern, kept)
    return text


def nodes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, node_seq, level (0: a paragraph) and text of each block of the column text.

    Headings of one to six # and blank lines end a paragraph, list items and quotes are paragraphs
    of their own, fenced code is left out; null and empty texts have no nodes.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?ms)^ {0,3}(```|~~~).*?(^ {0,3}\1[^\n]*$|\z)", "\n")
    line = docs.select(key, F.posexplode(F.split(body, "\r?\n")).alias("i", "line"))
    line = line.withColumn("level", F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})[ \t]+\S", 1))).withColumn("item", F.col("line").rlike(r"^\s*([-*+]|\d+[.)]|>)[ \t]"))
    rows = Window.partitionBy(key).orderBy("i")
    begins = (F.col("level") > 0) | F.col("item") | (F.trim("line") == "") | (F.coalesce(F.lag("level").over(rows), F.lit(0)) > 0)
    line = line.withColumn("node", F.sum(begins.cast("int")).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s*([-*+]|\d+[.)]|>)[ \t]+|^ {0,3}#{1,6}[ \t]+", ""), r"[ \t]+#*[ \t]*$", "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", bare.alias("t")))), lambda r: r["t"]), "\n")
    got = line.where(F.trim("line") != "").groupBy(key, "node").agg(F.max("level").alias("level"), inline_text(text).alias("text"))
    got = got.where("level > 0 or text <> ''")
    return got.select(key, F.row_number().over(Window.partitionBy(key).orderBy("node")).alias("node_seq"), "level", "text")


def layout(nodes: DataFrame, key: str = "doc_id", style: Style = Style()) -> DataFrame:
    """Each node's page, place and size, as a scan down the page.

    A heading needs its own height, a paragraph three lines; what doesn't fit above the bottom
    margin starts a page. A paragraph is one line, however long.
    """
    size = F.when(F.col("level") == 0, style.body).otherwise(F.element_at(F.array(*map(F.lit, style.headings)), F.greatest("level", F.lit(1))))
    gap, row = style.paragraph_spacing, style.body * style.line_spacing
    n = nodes.withColumn("size", size).withColumn("need", F.when(F.col("level") == 0, row * 3).otherwise(F.col("size") + gap)).withColumn("step", F.when(F.col("level") == 0, row + gap).otherwise(F.col("size") + gap))
    top = style.page_height - style.margin

    def step(at, need, taken):
        page, y = at or (0, top)
        if y - need < style.margin:
            page, y = page + 1, top
        return (page, y - taken), (page, y)

    placed = segmented_scan(n, [key], ["node_seq"], ["need", "step"], step, "page_num int, y double")
    font = F.when(F.col("level") == 0, "Helvetica").otherwise("Helvetica-Bold")
    return placed.select(key, "page_num", F.col("node_seq").alias("elem_seq"), "text", F.lit(style.margin).alias("x"), "y", "size", font.alias("font"))

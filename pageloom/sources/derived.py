"""Layout tables derived from the star schema, for tests and queries: elements, images, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of text, and line items, about, that make one part of the derived elements and blocks.
PART, ROWS = 4_000_000, 500_000
#: Bytes of text in one part that is dealt out by page: its elements are sorted and gathered, in many times the memory, and should not spill.
PAGED = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, part: int | None = None) -> int:
    """A number of parts that grows with the bytes of all texts, as counted, so that what a task sorts doesn't grow."""
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, size // (part or PART) + 1)


def documents(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """doc_id and text of the documents, dealt out by doc_id in n parts, or parts(), before texts become rows.

    Pages and their elements are then where operators by page or document want them: texts move once, as
    they are, and no element does.
    """
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition(n or parts(spark, sf_dir), "doc_id")


def page_texts(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """doc_id, page_num and the text of each page of 100 words, dealt out by page in n parts: texts move once, as they are."""
    page = F.posexplode(F.expr("regexp_extract_all(text, '(?:[^ \\n]++[ \\n]*+){1,100}+', 0)")).alias("page_num", "text")
    return table(spark, sf_dir, "documents").select("doc_id", page).repartition(n, "doc_id", "page_num")


def elements(spark: SparkSession, sf_dir: str, n: int | None = None, paged: bool = False) -> DataFrame:
    """A text element for each word of a document, 100 to a page in rows of five; paged, dealt out by page and not by document."""
    split = "filter(split(text, '[ \\\\n]+'), w -> w <> '')"
    if paged:
        words = page_texts(spark, sf_dir, n or parts(spark, sf_dir, PAGED)).select("doc_id", "page_num", F.posexplode(F.expr(split)).alias("at", "text"))
        g = words.select("doc_id", "page_num", "text", F.expr("page_num * 100 + at as elem_seq"), F.expr("at % 5 as col"), F.expr("cast(floor(at / 5) as int) as row_no"))
    else:
        words = documents(spark, sf_dir, n).select("doc_id", F.posexplode(F.expr(split)).alias("i", "text"))
        g = words.select("doc_id", "text", F.col("i").alias("elem_seq"), F.expr("cast(floor(i / 100) as int) as page_num"), F.expr("cast(i % 5 as int) as col"), F.expr("cast(floor((i % 100) / 5) as int) as row_no"))
    return g.select(
        "doc_id", "page_num", "elem_seq", "text",
        F.expr("cast(50 + col * 80 + (doc_id % 7) * 5 + case when row_no = 4 then 60 else 0 end as double) as x"),
        F.expr("cast(800 - row_no * 16 - case when row_no >= 10 then 12 else 0 end - case when row_no >= 15 then 40 else 0 end as double) - case when doc_id % 4 = 0 then col * 1.75D else 0D end + ((elem_seq * 7 + doc_id) % 3) * 0.5D as y"),
        F.expr("octet_length(text) * (cast(10 + 2 * (doc_id % 2) as double) * 0.6D) as width"),
        F.expr("cast(10 + 2 * (doc_id % 2) as double) as height"), F.expr("cast(10 + 2 * (doc_id % 2) as double) as size"), F.expr("concat('F', cast(1 + doc_id % 2 as string)) as font"),
    )


def _seen(spark: SparkSession, sf_dir: str, n: int | None = None, paged: bool = False) -> DataFrame:
    """doc_id and page_num of pages with elements, from the number of words of each document; paged, dealt out by page."""
    docs = table(spark, sf_dir, "documents") if paged else documents(spark, sf_dir, n)
    count = docs.select("doc_id", F.expr("size(filter(split(text, '[ \\\\n]+'), w -> w <> '')) as n")).where("n > 0")
    seen = count.select("doc_id", F.expr("explode(sequence(0, cast((n - 1) div 100 as int))) as page_num"))
    return (seen.repartition(n or parts(spark, sf_dir, PAGED), "doc_id", "page_num") if paged else seen).distinct()


def images(spark: SparkSession, sf_dir: str, n: int | None = None, paged: bool = False) -> DataFrame:
    return _seen(spark, sf_dir, n, paged).where("doc_id % 3 = 0").withColumns({"y": F.lit(620.0), "placed_height": F.lit(20.0)})


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items dealt out by order, in parts that grow in number with the rows, as counted."""
    items = table(spark, sf_dir, "lineitem")
    return items.repartition(max(spark.sparkContext.defaultParallelism, items.count() // ROWS + 1), "l_orderkey")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content block for each line item, a page for each order."""
    return lineitems(spark, sf_dir).selectExpr(
        "l_orderkey as page_id", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as int) as block_seq",
        "case when l_returnflag = 'R' then 'image' else 'text' end as block_type", "cast(40 + (l_partkey % 5) * 90 as double) as x", "cast(60 + (l_suppkey * 37 + l_partkey * 11) % 600 as double) as y",
        "cast(100 + (l_partkey % 4) * 30 as double) as width", "cast(12 + l_linenumber * 6 as double) as height", "concat('F', cast(1 + l_suppkey % 2 as string)) as font", "cast(10 + (l_linenumber % 3) as double) as font_size",
    )


def pages(spark: SparkSession, sf_dir: str, n: int | None = None, paged: bool = False) -> DataFrame:
    """A4 pages of the documents; every fifth document's pages turn y upside down."""
    seen = _seen(spark, sf_dir, n, paged)
    turned = F.expr("named_struct('a', 1D, 'b', 0D, 'c', 0D, 'd', -1D, 'e', 0D, 'f', 842D)")
    return seen.select("doc_id", "page_num", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.when(F.col("doc_id") % 5 == 0, turned).alias("page_ctm"))


def placed_images(spark: SparkSession, sf_dir: str, n: int | None = None, paged: bool = False) -> DataFrame:
    """One image on each page of every third document, where images() has it."""
    seen = images(spark, sf_dir, n, paged)
    return seen.select(
        "doc_id", "page_num", F.lit(1).alias("image_seq"), F.lit("Im1").alias("name"), (F.col("page_num") % 3 * 40 + 60).cast("double").alias("x"), "y", F.lit(180.0).alias("placed_width"), "placed_height",
        (F.col("doc_id") % 50 + 100).cast("int").alias("pixel_width"), F.lit(40).alias("pixel_height"), F.when(F.col("page_num") % 2 == 0, "jpeg").otherwise("png").alias("format"),
        F.expr("named_struct('a', 180D, 'b', 0D, 'c', 0D, 'd', 20D, 'e', cast(page_num % 3 * 40 + 60 as double), 'f', 620D)").alias("transform"),
    )


def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing operator for each line item, a page for each order: saved states, matrices, widths and colours."""
    b = lineitems(spark, sf_dir).selectExpr("*", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as int) as op_seq")
    kind = F.expr("case (l_partkey + l_linenumber) % 7 when 0 then 'q' when 1 then 'Q' when 2 then 'w' when 3 then 'rg' when 4 then 'q' else 'cm' end").alias("op")
    turn = F.expr("array(1 + (l_suppkey % 3 - 1) * 0.5D, (l_partkey % 3 - 1) * 0.25D, l_linenumber % 2 * 0.5D, case when l_partkey % 2 = 0 then 1D else -1D end, cast(l_quantity as double), cast(l_partkey % 100 as double))")
    args = F.when(F.col("op") == "cm", turn).when(F.col("op") == "w", F.expr("array(cast(l_partkey % 8 as double))")).when(F.col("op") == "rg", F.expr("array(l_partkey % 4 / 4D, l_suppkey % 4 / 4D, 0.5D)"))
    b = b.withColumn("op", kind).withColumn("args", args)
    return b.selectExpr("l_orderkey div 10 as doc_id", "cast(l_orderkey % 10 as int) as page_num", "op_seq", "op", "args")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document as codes of one of two fonts; an empty text, which split() gives one empty part, has none."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('F', cast(1 + doc_id % 2 as string)) as font", "transform(filter(split(text, ''), c -> c <> ''), c -> cast(ascii(c) as bigint)) as codes")


def code_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of codes from parts, which overlap."""
    return table(spark, sf_dir, "part").selectExpr("concat('F', cast(1 + p_partkey % 2 as string)) as font", "cast(p_partkey as bigint) as range_seq", "cast(p_partkey * 37 % 400 as bigint) as low", "cast(p_partkey * 37 % 400 + p_partkey % 60 as bigint) as high", "cast(65 + p_partkey % 500 as bigint) as start")

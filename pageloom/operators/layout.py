"""Lines, blocks, reading order and page layout as windows and scans over one page's rows.

Operators on blocks take the columns that name a page: a table's own page_id, or PAGE for the blocks
of documents, those of text_blocks() and content.content_blocks().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import clean
from pageloom.operators.scan import segmented_scan

PAGE = ("doc_id", "page_num")
#: The columns of a text element inside a block.
ELEMENT = ("elem_seq", "text", "x", "y", "width", "height", "font", "size")


def banded(df: DataFrame, page: tuple[str, ...], key: str, gap: Column | float, strict: bool, *then: str) -> DataFrame:
    """Adds band and rank: a band starts where key falls by at least (strict: more than) gap.

    A comparator with a tolerance is not transitive; bands order the same way wherever it is.
    """
    down = Window.partitionBy(*page).orderBy(F.desc(key), *then)
    fall = F.lag(key).over(down) - F.col(key)
    new = (fall > gap) if strict else (fall >= gap)
    df = df.withColumn("band", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy("band", *then)))


def chained_lines(elements: DataFrame) -> DataFrame:
    """Elements with line_no: a line ends where y moves by half the mean size of two neighbours."""
    e = banded(elements, PAGE, "y", 1.0, False, "x", "elem_seq")
    w = Window.partitionBy(*PAGE).orderBy("band", "x", "elem_seq")  # the order of rank, and no further sort
    far = F.abs(F.col("y") - F.lag("y").over(w)) >= 0.5 * ((F.col("size") + F.lag("size").over(w)) / 2)
    return e.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("line_no", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("far")


def _joined(order: list[str], value: str, sep: str) -> Column:
    return F.array_join(_ordered(order, F.col(value)), sep)


def _ordered(order: list[str], value: Column) -> Column:
    """The values of a group in order."""
    return F.sort_array(F.collect_list(F.struct(*order, value.alias("v"))))["v"]


def lines(elements: DataFrame, nested: bool = False) -> DataFrame:
    """One row a line: bounds, mean size and text with a space at gaps over 0.35 sizes; nested: its elements too."""
    w = Window.partitionBy(*PAGE).orderBy("band", "x", "elem_seq")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    spaced = (F.lag("line_no").over(w) == F.col("line_no")) & (gap > 0.35 * F.lag("size").over(w))
    e = chained_lines(elements).withColumn("piece", F.concat(F.when(spaced, " ").otherwise(""), F.col("text")))
    return e.groupBy(*PAGE, "line_no").agg(
        F.min("x").alias("min_x"), F.max(F.col("x") + F.col("width")).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("height")).alias("max_y"),
        F.avg("size").alias("avg_size"), F.sum("size").alias("sum_size"), F.count("*").alias("n"), F.min_by("font", "rank").alias("font"), clean(_joined(["rank"], "piece", "")).alias("text"),
        *([_ordered(["rank"], F.struct(*ELEMENT)).alias("elements")] if nested else []),
    )


def text_blocks(elements: DataFrame, images: DataFrame | None = None, nested: bool = False, counted: bool = False) -> DataFrame:
    """Lines joined into blocks: spacing up to 1.5 sizes, left edges within 50, no image between.

    nested adds the elements of each block, in the order of its text, counted n_elements. Lines are made
    once; a page's images meet them as one list of ranges. Elements and images that were dealt out by
    page in one number of parts stay where they are.
    """
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    l = lines(elements, nested).withColumn("up", F.lag("min_y").over(w)).withColumn("up_x", F.lag("min_x").over(w)).withColumn("up_size", F.lag("avg_size").over(w))
    cut = F.lit(False)
    if images is not None:
        spans = images.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("y").alias("low"), (F.col("y") + F.col("placed_height")).alias("high"))).alias("spans"))
        l = l.join(spans, [*PAGE], "left")
        cut = (F.col("up") > F.col("max_y")) & F.coalesce(F.exists("spans", lambda s: (s["low"] <= F.col("up")) & (F.col("max_y") <= s["high"])), F.lit(False))
    joins = (F.col("up") - F.col("max_y") <= 1.5 * ((F.col("up_size") + F.col("avg_size")) / 2)) & (F.abs(F.col("up_x") - F.col("min_x")) <= 50) & ~cut
    l = l.withColumn("block_seq", F.sum(F.when(F.col("up").isNotNull() & ~joins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    return l.groupBy(*PAGE, "block_seq").agg(
        F.min("min_x").alias("x"), F.min("min_y").alias("y"), (F.max("max_x") - F.min("min_x")).alias("width"), (F.max("max_y") - F.min("min_y")).alias("height"),
        (F.sum("sum_size") / F.sum("n")).alias("font_size"), F.min_by("font", "line_no").alias("font"), F.count("*").alias("n_lines"), _joined(["line_no"], "text", "\n").alias("text"),
        *([F.flatten(_ordered(["line_no"], F.col("elements"))).alias("elements")] if nested else []),
        *([F.sum("n").alias("n_elements")] if counted else []),
    )


def page_text(elements: DataFrame) -> DataFrame:
    """The texts of a page in stream order, joined by spaces."""
    return elements.groupBy(*PAGE).agg(_joined(["elem_seq"], "text", " ").alias("text"))


def document_text(elements: DataFrame) -> DataFrame:
    """The page texts of a document, joined by blank lines."""
    return page_text(elements).groupBy("doc_id").agg(_joined(["page_num"], "text", "\n\n").alias("text"))


def anchored_lines(elements: DataFrame) -> DataFrame:
    """n_lines of each page where a line keeps within half a size of its first element.

    Each test is against the line's first element, so this is a fold over the sorted page.
    """
    at = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("down"), "x", "elem_seq", "y", "size")))
    fold = F.expr("aggregate(at, named_struct('n', 0, 'y', 0D, 's', 0D), (a, e) -> if(a.n > 0 and abs(e.y - a.y) <= 0.5D * a.s, a, named_struct('n', a.n + 1, 'y', e.y, 's', e.size)), a -> a.n)")
    return elements.groupBy(*PAGE).agg(at.alias("at")).select(*PAGE, fold.alias("n_lines"))


def sorted_elements(elements: DataFrame) -> DataFrame:
    """Elements with line_no and rank: lines as in anchored_lines from the top, each from left to right."""

    def step(line, y, size):
        if line is None or not abs(y - line[1]) <= 0.5 * line[2]:
            line = (1 if line is None else line[0] + 1, y, size)
        return line, (line[0],)

    placed = segmented_scan(elements, PAGE, [F.desc("y"), "x", "elem_seq"], ["y", "size"], step, "line_no int")
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no", "x", "elem_seq")))


def sorted_text(elements: DataFrame) -> DataFrame:
    """The text of each page's sorted elements: a line feed where y moves by over half a size, else a space."""
    w = Window.partitionBy(*PAGE).orderBy("rank")
    far = F.abs(F.col("y") - F.lag("y").over(w)) > F.col("size") * 0.5
    sep = F.when(F.col("rank") == 1, "").when(far, "\n").otherwise(" ")
    return sorted_elements(elements).withColumn("piece", F.concat(sep, "text")).groupBy(*PAGE).agg(_joined(["rank"], "piece", "").alias("text"))


def reading_order(blocks: DataFrame, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Blocks with rank: higher tops first, tops within 1.0 from left to right."""
    return _read(blocks, page).drop("band", "top")


def _read(blocks: DataFrame, page: tuple[str, ...]) -> DataFrame:
    return banded(blocks.withColumn("top", F.col("y") + F.col("height")), page, "top", 1.0, True, "x", "block_seq")


def overlaps(blocks: DataFrame, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pairs of blocks of one page, in reading order, that share an area; touching edges do not."""
    k = len(page)
    b = reading_order(blocks, page).select(*page, "block_seq", "rank", "x", "y", "width", "height")
    a, c = b.toDF(*page, *[f"l_{x}" for x in b.columns[k:]]), b.toDF(*page, *[f"r_{x}" for x in b.columns[k:]])
    wide = F.least(F.expr("l_x + l_width"), F.expr("r_x + r_width")) - F.greatest("l_x", "r_x")
    high = F.least(F.expr("l_y + l_height"), F.expr("r_y + r_height")) - F.greatest("l_y", "r_y")
    return a.join(c, [*page]).where("l_rank < r_rank").where((wide > 0) & (high > 0)).select(*page, F.col("l_block_seq").alias("left_block"), F.col("r_block_seq").alias("right_block"), (wide * high).alias("area"))


def compact(blocks: DataFrame, page_height: float = 842.0, spacing: float = 10.0, margin: float = 20.0, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Blocks in reading order stacked from the top margin: a running sum, no fold."""
    w = Window.partitionBy(*page).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return reading_order(blocks, page).withColumn("new_y", F.lit(page_height - margin) - F.sum("height").over(w) - (F.col("rank") - 1) * F.lit(spacing)).select(*page, "block_seq", "rank", "new_y")


def even_spacing(blocks: DataFrame, page_height: float = 842.0, spacing: float = 10.0, margin: float = 20.0, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Blocks spread over the page height, at least `spacing` apart; packed tight if they don't fit."""
    w, all_ = Window.partitionBy(*page).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*page)
    b = reading_order(blocks, page).withColumn("free", F.lit(page_height - 2 * margin) - F.sum("height").over(all_)).withColumn("n", F.count("*").over(all_))
    step = F.when(F.col("free") < 0, spacing).otherwise(F.greatest(F.col("free") / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(spacing)))
    return b.withColumn("new_y", F.lit(page_height - margin) - F.sum("height").over(w) - (F.col("rank") - 1) * step).select(*page, "block_seq", "rank", "new_y")


def flow_down(blocks: DataFrame, spacing: float = 10.0, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The first block stays; a later one moves down if its top comes nearer than `spacing`.

    A block's new y is the least of its own and the one before's less spacing and height. With the
    running sum of what blocks take, that is a running minimum: two windows of one order.
    """
    w = Window.partitionBy(*page).orderBy("band", "x", "block_seq").rowsBetween(Window.unboundedPreceding, 0)  # the order of rank, and no further sort
    b = _read(blocks, page).withColumn("taken", F.sum(F.col("height") + F.lit(float(spacing))).over(w))
    return b.withColumn("new_y", F.min(F.col("y") + F.col("taken")).over(w) - F.col("taken")).select(*page, "block_seq", "rank", "new_y")


def split_pages(blocks: DataFrame, page_height: float = 842.0, spacing: float = 10.0, margin: float = 20.0, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Blocks packed in reading order into pages; one that doesn't fit starts a page."""
    ordered = reading_order(blocks, page).select(*page, "block_seq", "rank", "height")
    return packed(ordered, page_height, spacing, margin, page).select(*page, "block_seq", "out_page", "new_y")


def packed(ordered: DataFrame, page_height: float, spacing: float, margin: float, page: tuple[str, ...]) -> DataFrame:
    """Rows with rank and height, all columns kept, with out_page and new_y as split_pages() has them."""
    top = float(page_height - margin)

    def step(at, height):
        number, y, any_ = at or (0, top, False)
        if any_ and y - height < margin:
            number, y = number + 1, top
        return (number, y - height - spacing, True), (number, y - height)

    return segmented_scan(ordered, page, ["rank"], ["height"], step, "out_page int, new_y double")


def merge_across_pages(blocks: DataFrame) -> DataFrame:
    """run for each block in document order: text of one font, and colour if there is one, within 1.0 of the run's first size.

    Islands of font and kind come from a window; the size test is against the first block of a
    run, so it is a scan inside each island.
    """
    w = Window.partitionBy("doc_id").orderBy("page_num", "block_seq")
    new = (F.col("block_type") != F.lag("block_type").over(w)) | (F.col("font") != F.lag("font").over(w)) | (F.col("block_type") == "image")
    if "color" in blocks.columns:
        new = new | ~F.col("color").eqNullSafe(F.lag("color").over(w))
    b = blocks.withColumn("island", F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def step(run, size):
        if run is None or size is None or not abs(size - run[1]) <= 1:
            run = (1 if run is None else run[0] + 1, size)
        return run, (run[0],)

    b = b.select("doc_id", "island", "page_num", "block_seq", "font_size")
    return segmented_scan(b, ("doc_id", "island"), ["page_num", "block_seq"], ["font_size"], step, "run int").drop("font_size")


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """One block for each run of merge_across_pages: joined text, extended bounds; images as they are."""
    b = blocks.join(merge_across_pages(blocks), ["doc_id", "page_num", "block_seq"])
    first = F.struct("page_num", "block_seq")
    return b.groupBy("doc_id", "island", "run").agg(
        F.min(first)["page_num"].alias("page_num"), F.min(first)["block_seq"].alias("block_seq"), F.min_by("block_type", first).alias("block_type"), F.min_by("font", first).alias("font"), F.min_by("font_size", first).alias("font_size"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
        F.count("*").alias("n_blocks"), _joined(["page_num", "block_seq"], "text", "\n").alias("text"),
    )


def _changed(blocks: DataFrame, kind: str, index: int, page: tuple[str, ...], **new: Column) -> DataFrame:
    """blocks with new values in the block of a kind at a place, from 0, in its page's order."""
    if kind not in ("text", "image"):
        raise ValueError(f"unsupported block type: {kind}")
    place = F.row_number().over(Window.partitionBy(*page, "block_type").orderBy("block_seq")) - 1
    b = blocks.withColumn("is_meant", (F.col("block_type") == kind) & (place == index))
    return b.withColumns({n: F.when(F.col("is_meant"), c).otherwise(F.col(n)) for n, c in new.items()}).drop("is_meant")


def move_block(blocks: DataFrame, kind: str, index: int, dx: float, dy: float, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One block of each page moved; pages without a block at that place stay as they are."""
    return _changed(blocks, kind, index, page, x=F.col("x") + dx, y=F.col("y") + dy)


def resize_block(blocks: DataFrame, kind: str, index: int, width: float, height: float, page: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One block of each page with a new size; pages without a block at that place stay as they are."""
    return _changed(blocks, kind, index, page, width=F.lit(float(width)), height=F.lit(float(height)))


def adjust_layout(blocks: DataFrame, strategy: str = "compact", page: tuple[str, ...] = ("page_id",), **options: float) -> DataFrame:
    """The page's columns, block_seq and new_y by the strategy of that name.

    fit_content moves nothing: it changes the sizes of texts, see content.fit_content().
    """
    if strategy in ("preserve_position", "fit_content"):
        return blocks.select(*page, "block_seq", F.col("y").alias("new_y"))
    how = {"flow_down": flow_down, "compact": compact, "even_spacing": even_spacing}
    if strategy not in how:
        raise ValueError(f"unsupported layout strategy: {strategy}")
    return how[strategy](blocks, page=page, **options).select(*page, "block_seq", "new_y")

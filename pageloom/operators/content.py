"""Content blocks: text and images of a page as rows of one type, in one stream, fitted and drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import fitting
from pageloom.operators.joins import translated
from pageloom.operators.layout import PAGE, packed, reading_order, text_blocks
from pageloom.operators.scan import segmented_scan

COLOR = "struct<r:double,g:double,b:double>"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
TEXT, IMAGE = "text", "image"
#: What a content block has besides its page; a text has no image, an image no text and no elements.
COLUMNS = ("block_seq", "block_type", "x", "y", "width", "height", "font", "font_size", "color", "text", "elements", "image")


def _black() -> Column:
    return F.struct(*[F.lit(0.0).alias(n) for n in "rgb"]).cast(COLOR)


def content_blocks(elements: DataFrame, images: DataFrame, pages: DataFrame, nested: bool = True, parts: int | None = None, by: tuple[str, ...] | None = PAGE) -> DataFrame:
    """PAGE and COLUMNS of every block: each page's text blocks, then its images, numbered from 1.

    elements are text elements; images have PAGE, image_seq, name, x, y, placed_width, placed_height,
    pixel_width, pixel_height, format and transform; pages have PAGE, height and page_ctm, the page's
    first matrix outside any saved state, or null. Where that matrix turns y upside down, blocks, their
    elements and images are turned back, so y grows upwards for all. A page that pages doesn't list
    is taken as it is; repeated pages count once. Without nested a text has n_elements in place of elements.
    A page's last text brings its images along. Where all three tables are dealt out by PAGE in one number of
    parts, no element moves until the blocks are dealt out, by `by` and in `parts` parts, which should grow
    with the input, for what follows; by=None leaves them where they are. Images of a null page are
    numbered for themselves.
    """
    held = "elements" if nested else "n_elements"
    texts = text_blocks(elements, images, nested=nested, counted=not nested)
    image = F.struct("name", "pixel_width", "pixel_height", "format", F.col("transform").cast(MATRIX).alias("transform"))
    placed = images.select(*PAGE, F.struct(F.col("image_seq").alias("seq"), "x", "y", F.col("placed_width").alias("width"), F.col("placed_height").alias("height"), image.alias("image")).alias("placed"))
    placed = placed.groupBy(*PAGE).agg(F.sort_array(F.collect_list("placed")).alias("placed"))
    turned = pages.where("page_ctm.d < 0").groupBy(*PAGE).agg(F.max("height").alias("turn"))

    def up(y: Column, height: Column) -> Column:
        return F.when(F.col("turn").isNotNull(), F.col("turn") - y - height).otherwise(y)

    text = texts.withColumn("is_last", F.lead("block_seq").over(Window.partitionBy(*PAGE).orderBy("block_seq")).isNull())
    text = text.join(placed, [*PAGE], "left").join(turned, [*PAGE], "left")
    own = {"block_seq": F.col("block_seq").cast("int"), "block_type": F.lit(TEXT), "x": F.col("x"), "y": up(F.col("y"), F.col("height")), "width": F.col("width"), "height": F.col("height"), "font": F.col("font"), "font_size": F.col("font_size"), "color": _black(), "text": F.col("text"), held: F.col(held)}
    if nested:
        own[held] = F.when(F.col("turn").isNotNull(), F.transform(held, lambda e: e.withField("y", F.col("turn") - e["y"]))).otherwise(F.col(held))
    kinds = {c: dict(texts.dtypes)[c] for c in ("x", "y", "width", "height", "font", "font_size", "text", held)} | {"block_seq": "int", "block_type": "string", "color": COLOR}
    own["image"] = F.lit(None).cast(placed.schema["placed"].dataType.elementType["image"].dataType)
    names = [held if c == "elements" else c for c in COLUMNS]

    def drawn_image(before: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            at = {"block_seq": (before + i + 1).cast("int"), "block_type": F.lit(IMAGE), "x": p["x"], "y": up(p["y"], p["height"]), "width": p["width"], "height": p["height"], "image": p["image"]}
            return F.struct(*[(at[c] if c in at else F.lit(None).cast(kinds[c])).alias(c) for c in names])

        return F.transform("placed", one)

    rows = F.concat(F.array(F.struct(*[own[c].alias(c) for c in names])), F.when(F.col("is_last") & F.col("placed").isNotNull(), drawn_image(F.col("block_seq"))).otherwise(F.array()))
    # pages of images alone; round robin, so that Spark 4.1 takes no union of like parts as dealt out: on its word content_overlaps lost pairs
    alone = placed.join(elements.select(*PAGE).distinct(), [*PAGE], "left_anti").join(turned, [*PAGE], "left").select(*PAGE, F.explode(drawn_image(F.lit(0))).alias("b"))
    both = text.select(*PAGE, F.explode(rows).alias("b")).unionByName(alone.repartition(elements.sparkSession.sparkContext.defaultParallelism)).select(*PAGE, "b.*")
    if by is None:
        return both
    return both.repartition(parts, *by) if parts else both.repartition(*by)


def page_layouts(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page: its size, first matrix, and its text blocks and images as lists; empty pages too."""
    lists = {n: F.array_sort(F.collect_list(F.when(F.col("block_type") == kind, F.struct(*COLUMNS)))) for n, kind in (("text_blocks", TEXT), ("images", IMAGE))}
    per = blocks.groupBy(*PAGE).agg(*[c.alias(n) for n, c in lists.items()])
    none = {n: F.coalesce(n, F.array().cast(per.schema[n].dataType)) for n in lists}
    return pages.select(*PAGE, "width", "height", "page_ctm").join(per, [*PAGE], "left").withColumns(none)


def listed(blocks: DataFrame) -> DataFrame:
    """Blocks with place: from the top by y alone, then in their order; no tolerance and no x."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("y"), "block_seq")))


def flattened(blocks: DataFrame) -> DataFrame:
    """The blocks of a document as one stream: stream_seq, from 1, by page and reading order."""
    ordered = reading_order(blocks, PAGE)
    return ordered.withColumn("stream_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "rank"))).drop("rank")


def merged_stream(blocks: DataFrame) -> DataFrame:
    """The stream of a document with texts of one style joined, across pages too.

    A text joins the one before it if both have one font and colour and its size is within 1.0 of that of the
    first of them; an image stands alone and ends a run. One scan numbers the runs; a run has the
    place, font and size of its first block, all texts joined by line feeds, all elements, or their number
    where blocks have n_elements in their place, and bounds around all of them.
    """

    def step(at, kind, font, size, color):
        if kind == TEXT and at and at[1] is not None and (font, color) == at[1] and (size is None) == (at[2] is None) and (size is None or abs(size - at[2]) <= 1.0):
            return at, (at[0],)
        at = ((at[0] if at else 0) + 1, (font, color) if kind == TEXT else None, size)
        return at, (at[0],)

    ordered = reading_order(blocks, PAGE)
    runs = segmented_scan(ordered.withColumn("ink", F.to_json("color")), ["doc_id"], ["page_num", "rank"], ["block_type", "font", "font_size", "ink"], step, "run int")
    place = F.struct("page_num", "rank")

    def in_order(value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("page_num", "rank", F.col(value).alias("v")))), lambda r: r["v"])

    first = [F.min_by(c, place).alias(c) for c in ("page_num", "block_seq", "block_type", "font", "font_size", "color", "image")]
    x, y = F.min("x"), F.min("y")
    return runs.groupBy("doc_id", "run").agg(
        *first, x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("width")) - x).alias("width"), (F.max(F.col("y") + F.col("height")) - y).alias("height"),
        F.count("*").alias("n_blocks"), F.when(F.min_by("block_type", place) == TEXT, F.array_join(in_order("text"), "\n")).alias("text"),
        F.flatten(F.filter(in_order("elements"), lambda e: e.isNotNull())).alias("elements") if "elements" in blocks.columns else F.coalesce(F.sum("n_elements"), F.lit(0)).alias("n_elements"),
    )


def split_stream(blocks: DataFrame, page_height: float = 842.0, spacing: float = 10.0, margin: float = 50.0) -> DataFrame:
    """A document's blocks packed into new pages, from the highest down whatever page they were on: out_page and y.

    Columns are as they were, with page_num kept and y that of the new page; elements keep theirs. All columns
    stream through the scan, so blocks are made once.
    """
    numbered = blocks.withColumn("was", F.col("block_seq")).withColumn("block_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "block_seq")))
    placed = packed(reading_order(numbered, ("doc_id",)), page_height, spacing, margin, ("doc_id",))
    return placed.withColumns({"y": F.col("new_y"), "block_seq": F.col("was")}).select(*blocks.columns, "out_page")


def fit_content(blocks: DataFrame, least: float = 6.0, spacing: float = 1.2) -> DataFrame:
    """Blocks with the font size at which their text fits their box.

    A size at which it fits already stays, as do those of images, of empty and null texts, and of texts that
    fit at no size tried; otherwise the first size that bisection from `least` to the block's own finds.
    """
    fit = fitting.Fit(least=least, spacing=spacing, padding=0.0)
    small = fitting.smaller_size(f"case when block_type = '{TEXT}' and text <> '' then text end", "width", "height", "font_size", fit)
    return blocks.withColumn("font_size", F.coalesce(small, "font_size"))


def drawn(blocks: DataFrame, fit: fitting.Fit = fitting.Fit(), keep_images: bool = True, keep_layout: bool = True) -> DataFrame:
    """What a page draws, in order: PAGE, rank, line_no, kind, text, x, y, size, width and height.

    Images are drawn in their box. A text is fitted into its box and drawn line by line from the top, empty
    lines left out, at the left edge, centred or at the right edge; one that fits at no size is drawn as
    it is at its box's corner in its own size, line_no 1. Baselines are a line's height apart.
    """
    if fit.align not in ("left", "center", "right"):
        raise ValueError(f"unsupported alignment: {fit.align}")
    kinds = [k for k, kept in ((TEXT, keep_layout), (IMAGE, keep_images)) if kept]
    if not kinds:
        raise ValueError("nothing is kept: neither texts nor images")
    b = reading_order(blocks.select(*PAGE, "block_seq", "block_type", "x", "y", "width", "height", "font_size", "text"), PAGE).where(F.col("block_type").isin(kinds))
    is_text = F.col("block_type") == TEXT
    b = b.withColumn("text", F.when(is_text, F.coalesce("text", F.lit("")))).withColumn("fits", fitting.fitted_lines("text", "width", "height", fit))
    rows = b.select(*PAGE, "rank", "block_type", "x", "y", "width", "height", "font_size", F.col("fits.size").alias("fitted"), F.posexplode("fits.lines").alias("i", "line"))
    step, slack = F.col("fitted") * F.lit(fit.spacing), F.col("width") - F.octet_length("line") * (F.col("fitted") * F.lit(0.6))
    x = F.col("x") + {"left": F.lit(0.0), "center": slack / 2, "right": slack}[fit.align]
    known = F.col("fitted").isNotNull()
    return rows.where(~known | (F.col("line") != "")).select(
        *PAGE, "rank", (F.col("i") + 1).alias("line_no"), F.col("block_type").alias("kind"), F.col("line").alias("text"), F.when(known, x).otherwise(F.col("x")).alias("x"),
        F.when(known, F.col("y") + F.col("height") - step * (F.col("i") + 1)).otherwise(F.col("y")).alias("y"), F.when(is_text, F.coalesce("fitted", "font_size")).alias("size"),
        F.when(~is_text, F.col("width")).alias("width"), F.when(~is_text, F.col("height")).alias("height"),
    )


def translated_pages(blocks: DataFrame, dictionary: DataFrame, fit: fitting.Fit = fitting.Fit(), keep_images: bool = True) -> DataFrame:
    """drawn() of blocks whose texts the dictionary (source, target) translates: a page in another language.

    A text without a translation is drawn as it is. Boxes stay, so a longer text gets a smaller size.
    """
    return drawn(translated(blocks, dictionary), fit, keep_images)


def report(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts by page, by document (page_num null) and over all (both null).

    n_elements, n_text_blocks, n_images; n_disordered: text blocks that lie higher than the one before
    them; n_control and n_unusual: elements with control characters, and with code points 128 to 159,
    which hint at a wrong encoding; n_problems: elements with either, or beyond the basic plane.
    """
    control, unusual = F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.col("text").rlike("[\\x80-\\x9F]")
    problem = control | unusual | F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]")
    e = elements.select(*PAGE, F.lit("e").alias("of"), control.alias("control"), unusual.alias("unusual"), problem.alias("problem"), F.lit(False).alias("disordered"))
    up = F.col("y") > F.lag("y").over(Window.partitionBy(*PAGE, "block_type").orderBy("block_seq"))
    no = F.lit(False)
    b = blocks.select(*PAGE, F.col("block_type").alias("of"), no.alias("control"), no.alias("unusual"), no.alias("problem"), (F.coalesce(up, no) & (F.col("block_type") == TEXT)).alias("disordered"))
    counts = {"n_elements": F.col("of") == "e", "n_text_blocks": F.col("of") == TEXT, "n_images": F.col("of") == IMAGE, "n_disordered": F.col("disordered"), "n_control": F.col("control"), "n_unusual": F.col("unusual"), "n_problems": F.col("problem")}
    return e.unionByName(b).rollup(*PAGE).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])

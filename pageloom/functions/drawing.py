"""Drawing operators, text layers and ruby runs as text, and page sizes and fonts by name."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions import values as V

#: What ends a path, by how it is painted.
PAINT = {"draw": "S", "fill": "f", "both": "B"}
CAPS, JOINS = {"butt": 0, "round": 1, "square": 2}, {"miter": 0, "round": 1, "bevel": 2}
RENDER = {"normal": 0, "stroke": 1, "fill_stroke": 2, "invisible": 3}
#: The standard fonts; the last two have an encoding of their own.
FONTS = (
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic",
    "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Symbol", "ZapfDingbats",
)
SYMBOLS = FONTS[-2:]


def written(form: str, *values: Column) -> Column:
    """Values in a printf form; numbers of %.2f are rounded half to even first, as exact binary ties are."""
    at = [i for i, p in enumerate(form.split("%")[1:]) if p.startswith(".2f")]
    return F.format_string(form, *[F.bround(v, 2) if i in at else v for i, v in enumerate(values)])


def is_standard_font(name: Column) -> Column:
    return F.coalesce(name.isin(*FONTS), F.lit(False))


def standard_font(name: Column) -> Column:
    """Struct (name, type, encoding) of a standard font; null for any other name."""
    encoding = F.when(name.isin(*SYMBOLS), "BuiltIn").otherwise("WinAnsiEncoding")
    return F.when(is_standard_font(name), F.struct(name.alias("name"), F.lit("Type1").alias("type"), encoding.alias("encoding")))


def oriented(width: Column, height: Column, landscape: Column) -> Column:
    """Struct (width, height) of a page; landscape swaps them."""
    return F.struct(F.when(landscape, height).otherwise(width).alias("width"), F.when(landscape, width).otherwise(height).alias("height"))


def line_width(width: Column) -> Column:
    return written("%.2f w", width)


def stroke_color(r: Column, g: Column, b: Column) -> Column:
    return written("%.2f %.2f %.2f RG", r, g, b)


def fill_color(r: Column, g: Column, b: Column) -> Column:
    return written("%.2f %.2f %.2f rg", r, g, b)


def line_cap(cap: str) -> str:
    return f"{CAPS[cap]} J"


def line_join(join: str) -> str:
    return f"{JOINS[join]} j"


def line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return written("%.2f %.2f m\n%.2f %.2f l\nS", x1, y1, x2, y2)


def rectangle(x: Column, y: Column, width: Column, height: Column, paint: str = "draw") -> Column:
    return written(f"%.2f %.2f %.2f %.2f re\n{PAINT[paint]}", x, y, width, height)


def circle(x: Column, y: Column, radius: Column, paint: str = "draw") -> Column:
    return F.concat(V.circle(x, y, radius), F.lit(f"\n{PAINT[paint]}"))


def image(name: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    return written("q\n%.2f %.2f %.2f %.2f %.2f %.2f cm\n/%s Do\nQ", width, F.lit(0.0), F.lit(0.0), height, x, y, name)


def shown(text: Column, x: Column, y: Column, font: Column, size: Column) -> Column:
    """Black text of a font resource at a place."""
    return written("BT\n0 0 0 rg\n/%s %.2f Tf\n%.2f %.2f Td\n(%s) Tj\nET", font, size, x, y, T.escape(text))


def layer_word(text: Column, x: Column, y: Column, height: Column, font: Column, mode: str = "invisible") -> Column:
    """A word of a text layer in the size of its height, 12 if that isn't positive; null for an empty word."""
    size = F.when(height > 0, height).otherwise(F.lit(12.0))
    return F.when(text != "", written(f"BT\n/%s %.2f Tf\n{RENDER[mode]} Tr\n%.2f %.2f Td\n(%s) Tj\nET", font, size, x, y, T.escape(text)))


def text_layer(words: DataFrame, key: list[str], image: tuple[Column, Column], page: tuple[Column, Column], font: str = "F1", opacity: float = 0.0, mode: str = "invisible", order: str = "word_seq") -> DataFrame:
    """key and content, the operators of a layer of recognised words over an image.

    words have key, word_seq, text and their box x, y, width and height in pixels from the top left;
    image and page are the sizes (width, height) in pixels and in points. Under full opacity the layer stands
    in a saved state of its own. Empty and null words are left out; a key without others has no row.
    """
    sx, sy = page[0] / image[0], page[1] / image[1]
    y = page[1] - F.col("y") * sy - F.col("height") * sy
    placed = words.select(*key, order, layer_word(F.col("text"), F.col("x") * sx, y, F.col("height") * sy, F.lit(font), mode).alias("drawn")).where("drawn is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "drawn"))), lambda w: w["drawn"]), "\n")
    return placed.groupBy(*key).agg(F.concat(F.lit("q\n/GS1 gs\n"), body, F.lit("\nQ")).alias("content") if opacity < 1 else body.alias("content"))


class Ruby(NamedTuple):
    """How ruby stands over its base: side, gap in points, size as a share of the base's, and what a copy takes."""

    align: str = "center"
    offset: float = 1.0
    ratio: float = 0.5
    copy: str = "base"


def ruby_pairs(texts: Column) -> Column:
    """A list of (base, ruby) of a list of texts that takes turns; a last one without a partner is left out."""
    at = F.sequence(F.lit(1), F.floor(F.size(texts) / 2).cast("int"))
    pairs = F.transform(at, lambda i: F.struct(F.element_at(texts, (i * 2 - 1).cast("int")).alias("base"), F.element_at(texts, (i * 2).cast("int")).alias("ruby")))
    return F.when(F.size(texts) < 2, F.array().cast("array<struct<base:string,ruby:string>>")).otherwise(pairs)


def ruby_run(pairs: DataFrame, key: list[str], x: Column, y: Column, size: Column, font: Column, style: Ruby = Ruby(), marked: bool = False) -> DataFrame:
    """pairs (key, pair_seq, base, ruby) placed one after another: base_x, ruby_x, ruby_y, advance and content.

    A pair takes the wider of its two texts, and the next one starts behind it: a running sum. content
    shows ruby, then base; marked adds the text that a copy takes.
    """
    small = size * F.lit(style.ratio)
    wide, over = T.width(F.col("base"), size), T.width(F.col("ruby"), small)
    advance = F.greatest(wide, over)
    before = Window.partitionBy(*key).orderBy("pair_seq").rowsBetween(Window.unboundedPreceding, -1)
    p = pairs.withColumns({"advance": advance, "base_x": x + F.coalesce(F.sum(advance).over(before), F.lit(0.0))})
    at = V.ruby_layout(F.col("base_x"), y, wide, over, size, style.offset, style.align)
    p = p.withColumns({"ruby_x": at["ruby_x"], "ruby_y": at["ruby_y"]})
    both = F.concat(shown(F.col("ruby"), F.col("ruby_x"), F.col("ruby_y"), font, small), F.lit("\n"), shown(F.col("base"), F.col("base_x"), y, font, size))
    if marked:
        both = F.concat(F.lit("/Span <</ActualText ("), T.escape(V.ruby_text(F.col("base"), F.col("ruby"), style.copy)), F.lit(")>> BDC\n"), both, F.lit("\nEMC"))
    return p.withColumn("content", both)

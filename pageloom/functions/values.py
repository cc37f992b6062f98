"""Dates, strings, text fitting and ruby geometry of PDF files as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import fitting
from pageloom.functions.text import escape

#: Fixed value: ratio of control points that makes four Bezier curves a circle.
KAPPA = 0.5522847498


def format_date(at: Column, offset_minutes: Column) -> Column:
    """D:YYYYMMDDhhmmss+hh'mm' of a local time and its offset from UTC; null gives an empty string."""
    size = F.abs(offset_minutes)
    zone = F.concat(F.when(offset_minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit("'"), F.lpad((size % 60).cast("string"), 2, "0"), F.lit("'"))
    return F.coalesce(F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), zone), F.lit(""))


def parse_date(text: Column) -> Column:
    """Struct (local timestamp_ntz, offset_minutes); null without a year.

    Missing parts are the least ones; parts out of range carry over, so month 13 is the next January.
    """
    body = F.regexp_replace(text, "^D:", "")

    def part(at: int, least: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(body, f"^\\d{{{at}}}(\\d{{2}})", 1), F.lit("")).cast("int"), F.lit(least))

    year = F.nullif(F.regexp_extract(body, r"^(\d{4})", 1), F.lit("")).cast("int")
    day = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(4, 1) - 1)
    local = F.date_add(day, part(6, 1) - 1).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), part(8, 0), part(10, 0), part(12, 0).cast("decimal(18,6)"))
    zone = F.regexp_extract(body, r"^\d{4,14}([^\d])(\d{2})'?(\d{2})?", 0)
    hours = F.regexp_extract(zone, r"[^\d](\d{2})", 1)
    minutes = F.regexp_extract(zone, r"[^\d]\d{2}'?(\d{2})", 1)
    size = F.coalesce(F.nullif(hours, F.lit("")).cast("int"), F.lit(0)) * 60 + F.coalesce(F.nullif(minutes, F.lit("")).cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(zone, r"^\d+([^\d])", 1) == "-", -1).otherwise(1)
    return F.when(year.isNotNull(), F.struct(local.alias("local"), (size * sign).alias("offset_minutes")))


def encode_string(text: Column) -> Column:
    """An escaped literal for ASCII, else UTF-16 big-endian with its mark as hexadecimal digits."""
    return F.when(F.octet_length(text) == F.char_length(text), F.concat(F.lit("("), escape(text), F.lit(")"))).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">")))


def decode_string(raw: Column) -> Column:
    """The text of encode_string; anything else comes back as it is."""
    inner = F.substring(raw, F.lit(2), F.char_length(raw) - 2)
    plain = F.regexp_replace(inner, r"\\([\\()])", "$1")
    return F.when(raw.startswith("<FEFF"), F.decode(F.unhex(F.regexp_extract(raw, "^<FEFF([0-9A-Fa-f]*)>$", 1)), "UTF-16BE")).when(raw.startswith("(") & raw.endswith(")"), plain).otherwise(raw)


def rgb(red: Column, green: Column, blue: Column) -> Column:
    """Components from 0 to 1 of bytes."""
    return F.struct((red / F.lit(255.0)).alias("r"), (green / F.lit(255.0)).alias("g"), (blue / F.lit(255.0)).alias("b"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Bytes, cut off, of ink shares from 0 to 1."""
    return F.struct(*[F.floor(F.lit(255.0) * (1 - ink) * (1 - k)).cast("int").alias(n) for n, ink in zip("rgb", (c, m, y))])


def position(y: Column, height: Column | float) -> Column:
    """top, middle or bottom third of a page."""
    share = y / (height if isinstance(height, Column) else F.lit(float(height)))
    return F.when(share > 0.66, "top").when(share > 0.33, "middle").otherwise("bottom")


def ruby_layout(x: Column, y: Column, base_width: Column, ruby_width: Column, size: Column, offset: Column | float = 0.0, align: str = "center") -> Column:
    """Struct (base_x, ruby_x, ruby_y, advance); ruby widths are those of the smaller size."""
    slack = {"left": F.lit(0.0), "center": (base_width - ruby_width) / 2, "right": base_width - ruby_width}[align]
    return F.struct(x.alias("base_x"), (x + slack).alias("ruby_x"), (y + size + offset).alias("ruby_y"), F.greatest(base_width, ruby_width).alias("advance"))


def ruby_text(base: Column, ruby: Column, copy: str = "both") -> Column:
    """What a reader copies from a ruby pair: base, ruby, or base(ruby)."""
    return {"base": base, "ruby": ruby, "both": F.concat(base, F.lit("("), ruby, F.lit(")"))}[copy]


def circle(x: Column, y: Column, radius: Column) -> Column:
    """Path operators of a circle: a move and four Bezier curves."""
    k = radius * F.lit(KAPPA)
    turns = [((0, 1), (1, 0)), ((-1, 0), (0, 1)), ((0, -1), (-1, 0)), ((1, 0), (0, -1))]
    pieces = [F.format_string("%.2f %.2f m", x + radius, y)]
    for end, start in turns:
        one = (x + radius * start[0] + k * end[0], y + radius * start[1] + k * end[1])
        two = (x + radius * end[0] + k * start[0], y + radius * end[1] + k * start[1])
        pieces.append(F.format_string("%.2f %.2f %.2f %.2f %.2f %.2f c", *one, *two, x + radius * end[0], y + radius * end[1]))
    return F.concat_ws("\n", *pieces)


def fit_size(text: str, width: float, height: float, least: float = 6.0, most: float = 24.0, spacing: float = 1.2, padding: float = 2.0, rounds: int = 20) -> Column:
    """The largest font size found by bisection at which the SQL expression `text` fits into a box; see fitting."""
    return fitting.fitted_size(text, f"{float(width)!r}D", f"{float(height)!r}D", fitting.Fit(least, most, spacing, padding, grow=True, rounds=rounds))

"""Scalar functions on text, numbers and dates as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Without control characters below 0x20, but for tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def normalize_space(text: Column) -> Column:
    """Each line trimmed, its runs of white space one space; line feeds stay."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), "\n")


def width(text: Column, size: Column | float) -> Column:
    """Estimated width: 0.6 sizes for each byte of UTF-8."""
    return F.octet_length(text) * ((size if isinstance(size, Column) else F.lit(float(size))) * F.lit(0.6))


def wrap(text: str, most: float, size: float) -> Column:
    """Lines of the SQL expression `text` that fit into `most`, greedily; a longer word stands alone."""
    unit = f"({float(size)!r}D * 0.6D)"
    fits = f"octet_length(concat(element_at(a, -1), ' ', w)) * {unit} <= {float(most)!r}D"
    words = "filter(split(p, '(?U)\\\\s+'), w -> w <> '')"
    fold = f"aggregate({words}, cast(array() as array<string>), (a, w) -> if(size(a) > 0 and {fits}, concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), ' ', w))), concat(a, array(w))))"
    return F.expr(f"flatten(transform(split({text}, '\\n'), p -> if(p = '', array(''), {fold})))")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")")), F.lit("\\\\"), F.lit("\\"))


#: Permission bits of the standard security handler, and the bits that are always set.
PERMISSION_BITS = {"print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill_forms": 8, "extract": 9, "assemble": 10, "print_high": 11}
PERMISSION_BASE = -3904


def permissions(flags: dict[str, Column]) -> Column:
    """The 32-bit permission word of boolean columns named as in PERMISSION_BITS."""
    out = F.lit(PERMISSION_BASE)
    for name, flag in flags.items():
        out = out.bitwiseOR(F.when(flag, 1 << PERMISSION_BITS[name]).otherwise(0))
    return out


def has_permission(word: Column, name: str) -> Column:
    return word.bitwiseAND(F.lit(1 << PERMISSION_BITS[name])) != 0


def pixel_rect(x: Column, y: Column, w: Column, h: Column, image: tuple[float, float], page: tuple[float, float]) -> list[Column]:
    """x, y, width, height in points, origin at the bottom left, of a pixel box from the top left."""
    sx, sy = page[0] / image[0], page[1] / image[1]
    return [x * F.lit(sx), F.lit(float(page[1])) - y * F.lit(sy) - h * F.lit(sy), w * F.lit(sx), h * F.lit(sy)]


#: Permissions by name: which flags a preset sets.
PRESETS = {"default": tuple(PERMISSION_BITS), "restricted": (), "print_only": ("print", "print_high")}


def preset(name: str) -> int:
    """The permission word of a preset."""
    return PERMISSION_BASE | sum(1 << PERMISSION_BITS[n] for n in PRESETS[name])


def permission_flags(word: Column) -> Column:
    """Struct of a boolean for each name in PERMISSION_BITS."""
    return F.struct(*[has_permission(word, n).alias(n) for n in PERMISSION_BITS])


def unprintable(text: Column) -> Column:
    """How many characters are none of letters, marks, numbers, punctuation, symbols, spaces, tabs and line ends."""
    return F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \t\n\r]"))

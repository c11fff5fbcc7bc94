"""Column functions with the text semantics that extraction and inference need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.model import PIXELS, SPACE, java


def trim_all(c: Column) -> Column:
    """Without any white space at the ends; Spark's own trim takes only spaces."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.startswith(c, F.lit(prefix))
    return found


def pixels(c: Column) -> Column:
    """The number of an unsigned `px` value, else null."""
    return F.nullif(F.regexp_extract(trim_all(c), PIXELS, 1), F.lit("")).cast("double")


def number_text(c: Column) -> Column:
    """A double as the shortest plain text: 16, 0.5, 20000000."""
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.when(short.contains("E"), plain).otherwise(short)


def hex_channel(c: Column) -> Column:
    """A colour channel from 0 to 1 as two hex digits; more than two are kept."""
    digits = F.lower(F.hex(F.floor(c * 255 + 0.5).cast("long")))
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def rgba_hex(r: Column, g: Column, b: Column, a: Column) -> Column:
    """#rrggbb, with the alpha channel appended only if it is under 1."""
    return F.concat(F.lit("#"), hex_channel(r), hex_channel(g), hex_channel(b), F.when(a < 1, hex_channel(a)).otherwise(F.lit("")))


def slug(c: Column) -> Column:
    """Lower case, with slashes and runs of white space as dashes."""
    return F.lower(F.regexp_replace(F.replace(c, F.lit("/"), F.lit("-")), java(r"\s+"), "-"))


def key_order(name: Column, first: Column) -> Column:
    """Sort key of object members: names like array indexes first, by number, then the others as first written."""
    index = name.rlike(r"^(0|[1-9]\d{0,9})$") & (F.try_to_number(F.when(name.rlike(r"^\d{1,10}$"), name), F.lit("9999999999")) < 4294967295)
    return F.struct(F.when(index, 0).otherwise(1).alias("kind"), F.when(index, F.try_to_number(F.when(name.rlike(r"^\d{1,10}$"), name), F.lit("9999999999")).cast("long")).otherwise(F.lit(0).cast("long")).alias("index"), first.alias("first"))

"""Natural order of names, stems and numbered file names."""

from __future__ import annotations

import re
import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.errors import ValidationError

_CHUNKS = "([0-9]+|[^0-9]+)"
_PREFIX = r"^(\p{Nd}+)_(.+)$"


@cache
def _digits() -> tuple[str, str]:
    """Decimal digits of all scripts, and their values as ASCII digits."""
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isdecimal()]
    return "".join(found), "".join(str(int(c)) for c in found)


def ascii_digits(text: Column | str) -> Column:
    """The text with digits of other scripts written as 0-9."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(column) == F.length(column), column).otherwise(F.translate(column, *_digits()))


def natural_key(name: str) -> list[tuple]:
    """Chunks of the lower-cased name: numbers by value, before text."""
    return [(0, int(c), "") if c.isdecimal() else (1, 0, c) for c in re.findall(r"\d+|\D+", name.lower())]


def natural_column(name: Column | str) -> Column:
    """array<struct<is_text, digits, number, text>>, which orders as `natural_key` does (numbers of any length)."""
    chunks = F.regexp_extract_all(ascii_digits(F.lower(name)), F.lit(_CHUNKS), F.lit(1))

    def chunk(c: Column) -> Column:
        number = F.regexp_replace(c, "^0+(?=[0-9])", "")
        text = ~c.rlike("^[0-9]")
        return F.struct(
            text.cast("int").alias("is_text"),
            F.when(text, 0).otherwise(F.length(number)).alias("digits"),
            F.when(text, "").otherwise(number).alias("number"),
            F.when(text, c).otherwise("").alias("text"),
        )

    return F.transform(chunks, chunk)


def sortable(key: Column) -> Column:
    """A string that orders, byte by byte, as its natural key does."""

    def chunk(c: Column) -> Column:
        number = F.concat(F.lit("0"), F.lpad(c["digits"].cast("string"), 10, "0"), c["number"])
        text = F.concat(F.lit("1"), F.replace(c["text"], F.lit("\0"), F.lit("\0\1")), F.lit("\0\0"))
        return F.when(c["is_text"] == 1, text).otherwise(number)

    return F.array_join(F.transform(key, chunk), "")


def stem(filename: str) -> str:
    """The name without its last suffix; a leading dot starts no suffix."""
    base = filename.rsplit("/", 1)[-1]
    at = base.rfind(".")
    return base[:at] if at > 0 and at < len(base) - 1 else base


def stem_column(filename: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, "^.*/", ""), r"(?<=.)\.[^.]+$", "")


def numeric_prefix(filename: Column | str) -> tuple[Column, Column]:
    """(number as digits without leading zeros, rest) of a stem like 12_name; empty where it has none."""
    s = stem_column(filename)
    number = ascii_digits(F.regexp_extract(s, _PREFIX, 1))
    return F.regexp_replace(number, "^0+(?=[0-9])", ""), F.regexp_extract(s, _PREFIX, 2)


def page_name(base: str, page: int, extension: str = "png") -> str:
    if page < 1:
        raise ValidationError("page must be positive")
    return f"{base}-page-{page:04d}.{extension}"


def safe_name(name: Column | str) -> Column:
    """A name of letters, digits, dots, dashes and underscores only, without dots or underscores at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")

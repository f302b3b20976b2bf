"""Hashes, encodings and ligatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Unicode presentation forms of ligatures and the letters they stand for.
LIGATURES = {
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\ufb05": "\u017ft",
    "\ufb06": "st",
    "\ufb13": "\u0574\u0576",
    "\ufb14": "\u0574\u0565",
    "\ufb15": "\u0574\u056b",
    "\ufb16": "\u057e\u0576",
    "\ufb17": "\u0574\u056d",
    "\ufb1f": "\u05f2\u05b7",
    "\ufb4f": "\u05d0\u05dc",
}


def xxh64(data: Column | str, seed: int = 0) -> Column:
    """Seeded 64-bit hash of binary data as decimal(20,0); Spark's own xxhash64 has a fixed seed."""

    @pandas_udf("decimal(20,0)")
    def run(values: pd.Series) -> pd.Series:
        from decimal import Decimal

        import xxhash

        return values.map(lambda v: None if v is None else Decimal(xxhash.xxh64_intdigest(bytes(v), seed=seed)))

    return run(data)


def base64_line(data: Column | str) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data), r"\s", "")


def data_uri(data: Column | str, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), base64_line(data))


def expand_ligatures(text: Column | str) -> Column:
    """Ligature characters spelled out; texts without any are left alone."""
    t = F.col(text) if isinstance(text, str) else text
    out = t
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.when(t.rlike("[\\x{FB00}-\\x{FB4F}]"), out).otherwise(t)


def strict_utf8(data: Column | str) -> Column:
    """Text of UTF-8 data; null where it does not decode strictly."""
    d = F.col(data) if isinstance(data, str) else data
    text = d.cast("string")
    return F.when(F.is_valid_utf8(text), text)

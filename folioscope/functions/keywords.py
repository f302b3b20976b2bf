"""Keyword matching as column expressions.

Two axes: whole words or substrings, case-sensitive or not. Word characters are Unicode letters, numbers and the
underscore, and a boundary needs a word character on exactly one side, so a keyword that ends in punctuation matches
only next to a word character.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.errors import ValidationError

WORD = r"[\p{L}\p{N}_]"
SNIPPET = 40


def normalise_keywords(keywords: str | Iterable[str] | None) -> list[str]:
    """Strip the keywords and drop repeats (case matters), keeping the first of each."""
    if keywords is None:
        raise ValidationError("no keywords given")
    if isinstance(keywords, str):
        keywords = [keywords]
    try:
        given = list(keywords)
    except TypeError:
        raise ValidationError(f"cannot read keywords from {keywords!r}") from None
    if not given:
        raise ValidationError("the list of keywords is empty")
    stripped = ["" if k is None else str(k).strip() for k in given]
    if not all(stripped):
        raise ValidationError("a keyword consists of white space only")
    return list(dict.fromkeys(stripped))


def pattern(keyword: str, case_sensitive: bool = False, whole_words: bool = True) -> str:
    """A Java pattern for the keyword."""
    body = re.escape(keyword)
    if whole_words:
        is_word = [c.isalnum() or c == "_" for c in (keyword[0], keyword[-1])]
        body = ("(?<!" if is_word[0] else "(?<=") + WORD + ")" + body + ("(?!" if is_word[1] else "(?=") + WORD + ")"
    return body if case_sensitive else "(?iu)" + body


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def count(text: Column | str, keyword: str, case_sensitive: bool = False, whole_words: bool = True) -> Column:
    """Non-overlapping matches (long); a null text counts as empty. Texts without the bare keyword are told at once."""
    t = _text(text)
    there = t.contains(keyword) if case_sensitive else t.rlike("(?iu)" + re.escape(keyword))
    found = F.regexp_count(t, F.lit(pattern(keyword, case_sensitive, whole_words))).cast("long")
    return F.when(there, found).otherwise(F.lit(0).cast("long"))


def contains(text: Column | str, keyword: str, case_sensitive: bool = False, whole_words: bool = True) -> Column:
    return _text(text).rlike(pattern(keyword, case_sensitive, whole_words))


def contains_any(text: Column | str, keywords: list[str], case_sensitive: bool = False, whole_words: bool = True) -> Column:
    """Whether any keyword matches; the keywords are tried in their order."""
    found = contains(text, keywords[0], case_sensitive, whole_words)
    for k in keywords[1:]:
        found = found | contains(text, k, case_sensitive, whole_words)
    return found


def strip(text: Column) -> Column:
    """Without white space at either end, by Unicode's notion of it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def snippet(text: Column | str, keyword: str, case_sensitive: bool = False, whole_words: bool = True, width: int = SNIPPET) -> Column:
    """The first match with ``width`` characters on either side, dots where text is cut off; null without a match."""
    t, p = _text(text), pattern(keyword, case_sensitive, whole_words)
    at = F.length(F.element_at(F.split(t, p, 2), 1))
    end = at + F.length(F.regexp_extract(t, p, 0))
    first, last = F.greatest(at - width, F.lit(0)), F.least(end + width, F.length(t))
    cut = F.concat(F.when(first > 0, "...").otherwise(""), strip(F.substring(t, first + 1, last - first)), F.when(last < F.length(t), "...").otherwise(""))
    return F.when(t.rlike(p), cut)


def counts(text: Column | str, keywords: list[str], case_sensitive: bool = False, whole_words: bool = True) -> Column:
    """array<struct<ord, keyword, n>> in the keywords' order: one scan of the text a keyword, no join with them."""
    return F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("keyword"), count(text, k, case_sensitive, whole_words).alias("n")) for i, k in enumerate(keywords)]
    )

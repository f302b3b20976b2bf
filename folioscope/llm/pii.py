"""Personal data by candidate gradient boosting, in DataFrame operations only.

Four strict patterns give the base spans. High-recall generators propose further, overlapping spans; boosted trees,
trained here on made-up sentences, score each by its format and its context, and those above a calibrated threshold
are added under kinds of their own. The trees run as SQL expressions inside the row.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.boosting import Boosted, boost

#: Base patterns in the order of the result. Possessive groups and the look-behind only spare retries within a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of further candidates; secrets and codes have any length, numbers up to 32 characters.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])[0-9][0-9 ().-]{5,30}[0-9](?![0-9A-Za-z])",
    "secret": r"(?i)(?<![a-z])(?:token|key|secret|password|passwd|pwd)[\"' ]{0,3}[=:][\"' ]{0,3}[a-z0-9+/_-]{8,}+",
    "code": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "address": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[a-z0-9-]{2,63}){1,4}",
}
CONTEXT = 24
#: Features as patterns whose matches in the value, or in the context before it, are counted.
VALUE_COUNTS = ("[0-9]", "[A-Za-z]", r"[ ().-]", "[=:]", r"(?i)\(at\)|\[at\]| at ", r"(?i)\(dot\)|\[dot\]| dot ", "[G-Zg-z]")
BEFORE_FLAGS = (
    r"(?i)tel|phone|call|mobile|fax|whatsapp",
    r"(?i)ssn|social security|passport|account|iban|licen[cs]e no|tax id|insurance",
    r"(?i)token|key|secret|passw|pwd",
    r"(?i)mail|contact|write|reach",
    r"[$€£]\s*$|(?i)price|total|version|order|page|year|isbn|size",
)
LONGEST_RUN = "[0-9]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas refer to it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, value>>, in code points; running sums take log2(matches) passes."""

    def doubled(sums: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.when(i >= by, F.get(sums, i - by)), F.lit(0)))

    def spans(s: Column) -> Column:
        values = s["values"]
        steps = F.transform(values, lambda v, i: F.length(F.get(s["parts"], i)) + F.length(v))
        passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int"))
        made = lambda v, ends, i: F.struct((F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"))
        return _let(F.aggregate(passes, steps, doubled), lambda ends: F.transform(values, lambda v, i: made(v, ends, i)))

    def located(values: Column) -> Column:
        none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
        return F.when(F.size(values) > 0, _let(F.struct(F.split(text, pattern, -1).alias("parts"), values.alias("values")), spans)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _flagged(pattern: str) -> str:
    """The pattern with its case flag in front, where it holds for all alternatives."""
    return "(?i)" + pattern.replace("(?i)", "") if "(?i)" in pattern else pattern


def features_of(value: str, before: str, generator: str) -> list[float]:
    """The features in Python, for training; `_features` gives the same in SQL."""
    out = [float(len(value))] + [float(len(re.findall(_flagged(p), value))) for p in VALUE_COUNTS]
    out += [float(bool(re.search(_flagged(p), before))) for p in BEFORE_FLAGS]
    out.append(float(max((len(x) for x in re.findall(LONGEST_RUN, value)), default=0)))
    return out + [float(generator == g) for g in GENERATORS]


def _features(value: Column, before: Column, generator: str) -> list[Column]:
    out = [F.length(value)] + [F.size(F.regexp_extract_all(value, F.lit(p), F.lit(0))) for p in VALUE_COUNTS]
    out += [F.when(F.regexp_like(before, F.lit(_flagged(p))), 1).otherwise(0) for p in BEFORE_FLAGS]
    out.append(F.array_max(F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(value, F.lit(LONGEST_RUN), F.lit(0)), F.length))))
    return [x.cast("double") for x in out] + [F.lit(float(generator == g)) for g in GENERATORS]


@lru_cache(maxsize=1)
def model(seed: int = 5, rows: int = 3000) -> Boosted:
    """Trees for the candidates in made-up sentences: each is built from a template that says whether it is private."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(3, 9)))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKabcdefghjkmnpqrstuvwxyz0123456789") for _ in range(n))
    private = (
        lambda: f"{word()} {rng.choice(['ssn', 'social security no', 'tax id'])} {digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"{rng.choice(['phone', 'call', 'tel', 'mobile', 'fax'])} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{rng.choice(['phone:', 'tel.', 'mobile'])} {digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{rng.choice(['passport', 'account', 'iban'])} {digits(rng.randint(8, 12))}",
        lambda: f"{word()} {rng.choice(['token', 'key', 'secret', 'password'])}{rng.choice([' = ', '=', ': '])}\"{hexes(rng.choice([32, 40, 64]))}\"",
        lambda: f"{word()} {rng.choice(['api key', 'secret', 'token'])} {mixed(rng.randint(24, 48))}",
        lambda: f"{rng.choice(['mail', 'contact', 'write to'])} {word()}.{word()} {rng.choice(['(at)', '[at]', 'at'])} {word()} {rng.choice(['(dot)', '[dot]', 'dot'])} com",
    )
    harmless = (
        lambda: f"{word()} {rng.choice(['total', 'price', 'order', 'version', 'page', 'isbn'])} {digits(rng.randint(7, 13))}",
        lambda: f"{word()} {digits(4)}-{digits(2)}-{digits(2)} {word()}",
        lambda: f"{word()} {digits(2)}.{digits(2)}.{digits(4)} {digits(2)}",
        lambda: f"{word()} {word()} {digits(rng.randint(7, 20))} {word()}",
        lambda: f"{word()} {digits(3)}-{digits(3)}-{digits(4)} {word()}",
        lambda: f"{word()} {digits(4)} {digits(4)} {word()}",
        lambda: f"{word()} {rng.choice(['the key', 'a token', 'no secret'])}: {word()}{word()}{word()} {word()}",
        lambda: f"{word()} {word()}_{word()}_{word()}_{digits(2)}_{word()}",
        lambda: f"{word()} {word()} at {word()}.{word()} {word()}",
        lambda: f"{word()} {word()} at {word()}. {word()} {word()}",
        lambda: f"{word()} img-{digits(8)}-{word()}-{digits(4)}-{word()} {word()}",
    )
    x, y = [], []
    for i in range(rows):
        good = i % 2 == 0
        text = f"{word()} {rng.choice(private if good else harmless)()} {word()}"
        for generator, pattern in GENERATORS.items():
            flags = re.I if "(?i)" in pattern else 0
            for m in re.finditer(pattern.replace("(?i)", ""), text, flags):
                x.append(features_of(m[0], text[max(0, m.start() - CONTEXT) : m.start()], generator))
                y.append(good)
    return boost(np.array(x), np.array(y))


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _scored(generator: str, trees: Boosted, text: Column) -> Callable[[Column], Column]:
    def chosen(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, first + 1, s["start"] - first)
        return trees.column(_features(s["value"], before, generator)) >= trees.threshold

    return chosen


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with spans: array<struct<kind, start, end>> by kind, then start; code points, end exclusive.

    Base kinds come first (leftmost, non-overlapping within a kind), then kinds added by the trees, which may overlap
    others. A null text has no spans, as an empty one; repeated rows are each searched; a column named spans is
    replaced, others pass through. Whole texts are searched, and matches may be of any length, but for
    numbers (32 characters) and the parts of addresses (64).
    """
    df = docs.drop("spans").withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    trees, parts = model(), []
    for kind, pattern in BASE.items():
        df = df.withColumn(f"__{kind}", F.filter(_found(F.col("__text"), pattern), _checked(kind)))
        parts.append(_as(kind, F.col(f"__{kind}")))
    for generator, pattern in GENERATORS.items():
        df = df.withColumn(f"__{generator}", _found(F.col("__text"), pattern))
        parts.append(_as(generator, F.filter(F.col(f"__{generator}"), _scored(generator, trees, F.col("__text")))))
    df = df.withColumn("spans", F.concat(*parts))
    return df.drop("__text", *[f"__{k}" for k in (*BASE, *GENERATORS)])


def _as(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each stretch covered by spans replaced by the kind of its first span, in brackets."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        gap = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(new, gap).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.aggregate(order, start, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Personal data in texts: validated spans, in JVM expressions.

A kind is a pattern and, where its numbers have one, a check: card numbers by Luhn's sum, IBANs by their remainder
modulo 97, addresses of the internet protocol by their parts. Spans that overlap become one, named after the one
that begins first (of those the longest, then the earliest in KINDS), so that no part of any is left. Places are code points from 0,
ends exclusive. Null has no spans; texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns as regular expressions; \b, at ends only, parts ASCII letters, digits and _ from all else.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]{2,4}){2,4}\b",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}
KINDS = tuple(PATTERNS)
#: What every match of a pattern has: texts without it are passed over by a plain search.
_HAS = {"email": "@", "phone": "+", "ip": "."}


def _java(pattern: str) -> str:
    """Java's own \\b goes by all letters."""
    word = "[A-Za-z0-9_]"
    return re.sub(r"^\\b", f"(?<!{word})", re.sub(r"\\b$", f"(?!{word})", pattern))


def luhn(text: Column) -> Column:
    """Whether the digits of `text` have a sum, every second one from the right doubled, that ten divides."""
    digits = F.split(F.reverse(F.regexp_replace(text, "[^0-9]", "")), "")

    def value(x: Column, i: Column) -> Column:
        n = x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.filter(digits, lambda x: x != ""), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    number = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(number, F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def address(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda x: x.cast("int") <= 255)


CHECKS = {"iban": mod97, "card": luhn, "ip": address}


def _of_kind(text: Column, kind: str) -> Column:
    """Array of (start, longest first, rank, end) of a kind's valid matches; what stands before and between the matches tells where they are."""
    found, between = F.regexp_extract_all(text, F.lit(_java(PATTERNS[kind])), 0), F.split(text, _java(PATTERNS[kind]), -1)
    steps = F.zip_with(found, F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), lambda m, b: F.struct(m.alias("m"), F.char_length(b).alias("b")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,shorter:int,rank:int,end:int>>").alias("spans"))

    def add(s: Column, x: Column) -> Column:
        start, n = s["at"] + x["b"], F.char_length(x["m"])
        span = F.struct(start.alias("start"), (-n).alias("shorter"), F.lit(KINDS.index(kind)).alias("rank"), (start + n).alias("end"))
        fits = CHECKS[kind](x["m"]) if kind in CHECKS else F.lit(True)
        return F.struct((start + n).alias("at"), F.when(fits, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    some = text.rlike(_java(PATTERNS[kind]))  # most texts end here
    if kind in _HAS:
        some = F.contains(text, F.lit(_HAS[kind])) & some
    return F.when(some, F.aggregate(F.filter(steps, lambda x: x["m"].isNotNull()), none, add, lambda s: s["spans"])).otherwise(none["spans"])


def spans(text: Column) -> Column:
    """Array of (start, end, kind), in order, none overlapping."""
    every = F.array_sort(F.concat(*(_of_kind(text, k) for k in KINDS)))
    kinds = F.array(*map(F.lit, KINDS))

    def merge(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        this = F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(kinds, x["rank"] + 1).alias("kind"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(last.isNotNull() & (x["start"] < last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(this)))

    return F.when(text.isNotNull(), F.aggregate(every, F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))


def redacted(text: Column, found: Column) -> Column:
    """The text with [KIND] for each span."""
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    add = lambda s, x: F.struct(F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end"].alias("at"))
    return F.aggregate(found, none, add, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))

"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

The base kinds stand as the contract has them. Further kinds are proposed with a prior score; a checksum or a context
word within reach raises it, and a span is added if its score reaches the threshold. All of it is one projection: no
shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spans import find_spans, joined, labelled, let

#: Base patterns, in the order of the contract. Lookbehinds and possessive quantifiers only save time: a match can't
#: start inside a run where it couldn't start at the run's beginning or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Four numbers up to 255; each may have zeros in front, and may be zero.
BYTES = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

THRESHOLD, REACH = 0.6, 60


@dataclass(frozen=True)
class Extra:
    """A proposed kind: its prior score, what a good checksum and a context word add."""

    kind: str
    pattern: str
    prior: float
    checksum: str | None
    confirmed: float
    context: str
    near: float


EXTRAS = (
    Extra("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", 0.1, "mod97", 0.6, r"(?i)iban|account|konto|compte|cuenta|bank", 0.2),
    Extra("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, None, 0.0, r"(?i)\b(?:ssn|social security)\b", 0.4),
    Extra("card13", r"(?<![0-9])[0-9]{13}(?![0-9])|(?<![0-9])[0-9]{12}(?![0-9])", 0.1, "luhn", 0.2, r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta)\b", 0.4),
    Extra("local_phone", r"(?<![0-9+().-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", 0.3, None, 0.0, r"(?i)\b(?:phone|call|tel|mobile|fax|telefon|téléphone|teléfono)\b", 0.4),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a good Luhn checksum."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    marks = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), value)
    return F.aggregate(marks, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        digit = F.ascii(c) - F.lit(48)
        return F.when(digit < 10, rest * 10 + digit).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.regexp_extract_all(moved, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), step) == 1


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the base kinds, failing matches dropped. A kind is looked for only in texts with its fixed sign."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    email = F.when(F.contains(text, F.lit("@")), find_spans(text, EMAIL)).otherwise(none)
    ip = F.filter(find_spans(text, IP), lambda s: F.rlike(s["text"], F.lit(BYTES)))

    def card_ok(s: Column) -> Column:
        return let(only_digits(s["text"]), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))

    def phone_ok(s: Column) -> Column:
        return F.length(only_digits(s["text"])).between(10, 15)

    # Fourteen digits, blanks and hyphens at least: a cheap sign of a card.
    long_run = F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}"))
    card = F.when(long_run, F.filter(find_spans(text, CARD), card_ok)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(find_spans(text, PHONE), phone_ok)).otherwise(none)
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def extra_spans(text: Column, extra: Extra, threshold: float, reach: int) -> Column:
    """The spans of a proposed kind whose score reaches the threshold."""

    def score(s: Column) -> Column:
        begin = F.greatest(s["start"] - reach, F.lit(0))
        around = F.concat(F.substr(text, begin + 1, s["start"] - begin), F.lit(" "), F.substr(text, s["end"] + 1, F.lit(reach)))
        near = F.when(F.rlike(around, F.lit(extra.context)), extra.near).otherwise(0.0)
        if extra.checksum == "mod97":
            confirmed = mod97(F.regexp_replace(s["text"], " ", ""))
        elif extra.checksum == "luhn":
            confirmed = luhn(only_digits(s["text"]))
        else:
            confirmed = F.lit(False)
        return F.lit(extra.prior) + near + F.when(confirmed, extra.confirmed).otherwise(0.0)

    return F.filter(find_spans(text, extra.pattern), lambda s: score(s) >= threshold)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", extras: tuple[Extra, ...] = EXTRAS, threshold: float = THRESHOLD, reach: int = REACH) -> DataFrame:
    """Spans of personal data in every text: counts and a digest of the base kinds, and all spans as a string.

    A null text is empty: no spans, empty strings. Rows are judged one by one: repeated rows give repeated results,
    an empty table an empty one; columns besides key and text are not read. Spans with the same start stand in the
    order of their kinds. Very long texts are searched whole; places are code points.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = base_spans(whole)
    kinds = [*base, *(e.kind for e in extras)]
    found = docs.select(
        F.col(key).alias("__key"),
        *[labelled(v, kinds.index(k), k).alias(k) for k, v in base.items()],
        *[labelled(extra_spans(whole, e, threshold, reach), kinds.index(e.kind), e.kind).alias(e.kind) for e in extras],
    )
    return found.select(
        F.col("__key").alias(key),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined([F.col(k) for k in base]), 256).alias("base_sha256"),
        joined([F.col(k) for k in kinds]).alias("spans"),
        F.lit(0).cast("long").alias("n_added") if not extras else sum((F.size(e.kind) for e in extras[1:]), F.size(extras[0].kind)).cast("long").alias("n_added"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.table(spark, sf_dir, "documents"))

"""String functions with the dialect's meaning: ASCII case, code points, NULL instead of errors."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.session import ship

from .core import ascii_lower, ascii_upper, col

lower, upper = ascii_lower, ascii_upper


def length(value) -> Column:
    """Code points of a text, bytes of a binary value, characters of a number's text."""
    return F.length(col(value))


def octet_length(value) -> Column:
    return F.octet_length(col(value).cast("string"))


def substr(text, start, count=None) -> Column:
    """start 0 takes one off the count, a negative one counts from the end, a negative count takes what stands before."""
    x = col(text).cast("string")
    p = start if isinstance(start, Column) else F.lit(start)
    size = F.length(x)
    begin = F.when(p < 0, p + size).when(p > 0, p - 1).otherwise(0)
    if count is None:
        return F.substr(x, F.greatest(begin, F.lit(0)) + 1, size)
    n = count if isinstance(count, Column) else F.lit(count)
    take = F.when((p < 0) & (begin < 0), F.when(n < 0, 0).otherwise(n + begin)).when((p == 0) & (n > 0), n - 1).otherwise(n)
    first = F.greatest(begin, F.lit(0))
    back = F.least(first, -take)
    return F.when(take < 0, F.substr(x, first - back + 1, back)).otherwise(F.substr(x, first + 1, F.greatest(take, F.lit(0))))


def instr(text, needle) -> Column:
    """The first place of the needle in code points from 1; 0 if it isn't there, 1 for an empty needle."""
    return F.call_function("instr", col(text), needle if isinstance(needle, Column) else F.lit(needle))


def replace(text, old: str, new: str) -> Column:
    return col(text) if old == "" else F.replace(col(text), F.lit(old), F.lit(new))


def trim(text, characters: str = " ") -> Column:
    return F.btrim(col(text), F.lit(characters)) if characters else col(text)


def ltrim(text, characters: str = " ") -> Column:
    return F.ltrim(col(text), F.lit(characters)) if characters else col(text)


def rtrim(text, characters: str = " ") -> Column:
    return F.rtrim(col(text), F.lit(characters)) if characters else col(text)


def char(*codes) -> Column:
    """The text of code points; U+FFFD for those out of range."""
    points = []
    for c in codes:
        value = col(c).cast("bigint") if not isinstance(c, int) else F.lit(c).cast("bigint")
        valid = value.between(0, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        wide = F.lpad(F.hex(F.when(valid, value).otherwise(F.lit(0xFFFD))), 8, "0")
        points.append(F.coalesce(wide, F.lit("00000000")))
    return F.decode(F.unhex(F.concat(*points)), "UTF-32")


def unicode(text) -> Column:
    """The first code point; NULL for an empty text."""
    return F.when(col(text) != "", F.ascii(col(text)))


def hex_(value) -> Column:
    """Upper-case hex of the bytes; an empty text for NULL. Numbers count as their text."""
    return F.coalesce(F.hex(F.encode(col(value).cast("string"), "UTF-8")), F.lit(""))


def unhex_(text, passed: str = "") -> Column:
    """Bytes of hex digits; NULL if anything else stands there, or an odd number of digits. Passed characters may
    stand between bytes."""
    plain = col(text)
    if passed:
        allowed = "[" + "".join("\\" + c if not c.isalnum() else c for c in passed) + "]*"
        whole = F.rlike(plain, F.lit(f"^(?:{allowed}[0-9A-Fa-f]{{2}})*+{allowed}\\z"))
        plain = F.when(whole, F.translate(plain, passed, ""))
    good = F.rlike(plain, F.lit(r"^(?:[0-9A-Fa-f]{2})*+\z"))
    return F.when(good, F.unhex(plain))


def concat(*values) -> Column:
    """NULL counts as an empty text."""
    return F.concat_ws("", *[col(v).cast("string") for v in values])


def concat_ws(separator: str | None, *values) -> Column:
    return F.lit(None).cast("string") if separator is None else F.concat_ws(separator, *[col(v).cast("string") for v in values])


def soundex_code(text: str | None) -> str:
    """?000 without an ASCII letter; else the first letter and three digits. Equal digits in a row count once; a
    vowel, h or w between them lets the second count again."""
    codes = dict(zip("BFPVCGJKQSXZDTLMNR", "111122222222334556", strict=True))
    letters = [c for c in (text or "").upper() if "A" <= c <= "Z"]
    if not letters:
        return "?000"
    out, last = letters[0], codes.get(letters[0], "")
    for c in letters[1:]:
        code = codes.get(c, "")
        if code and code != last:
            out += code
        last = code
    return (out + "000")[:4]


def _mapped(f, value: Column) -> Column:
    """A function of one text, in Arrow batches."""
    ship()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action=None)

    return run(value)


def soundex(text) -> Column:
    return _mapped(soundex_code, col(text).cast("string"))


_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})")


def unescape(text: str | None) -> str | None:
    r"""\uXXXX and \UXXXXXXXX to their characters; every other backslash stays, as do codes that are no characters."""

    def character(found: re.Match) -> str:
        code = int(found[1] or found[2], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else found[0]

    return None if text is None else _ESCAPED.sub(character, text)


def unistr(text) -> Column:
    return _mapped(unescape, col(text).cast("string"))

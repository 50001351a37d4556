"""Operators with the dialect's meaning as Column builders: nothing raises, whatever spark.sql.ansi.enabled is.

Integers are BIGINT, reals DOUBLE, truth is 0, 1 or NULL as BIGINT at the edges. Division by zero and overflow give NULL;
``wide=True`` gives the real result of an overflowing operation instead, as a DOUBLE column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The longest numeric prefix of a text.
NUMBER = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
INTEGER = r"^\s*([+-]?[0-9]+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row and named, not repeated, in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truth(c: Column) -> Column:
    """A condition as 1, 0 or NULL."""
    return c.cast("int").cast("bigint")


# Numbers -------------------------------------------------------------------------------------------------------------


def add(a, b, wide: bool = False) -> Column:
    a, b = col(a), col(b)
    return a.cast("double") + b.cast("double") if wide else F.try_add(a, b)


def subtract(a, b, wide: bool = False) -> Column:
    a, b = col(a), col(b)
    return a.cast("double") - b.cast("double") if wide else F.try_subtract(a, b)


def multiply(a, b, wide: bool = False) -> Column:
    a, b = col(a), col(b)
    return a.cast("double") * b.cast("double") if wide else F.try_multiply(a, b)


def int_divide(a, b) -> Column:
    """Integer division towards zero; NULL for a zero divisor and for the one quotient that overflows."""
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    # a less its remainder is a multiple of b, which decimals divide exactly.
    whole = F.try_divide((a.cast("decimal(20,0)") - F.try_mod(a, b).cast("decimal(20,0)")), b.cast("decimal(20,0)"))
    return whole.try_cast("bigint")


def divide(a, b) -> Column:
    """Real division; NULL for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def modulo(a, b) -> Column:
    """The remainder with the dividend's sign; reals are cut to integers first; NULL for a zero divisor."""
    return F.try_mod(col(a).cast("bigint"), col(b).cast("bigint"))


def bit_and(a, b) -> Column:
    return col(a).cast("bigint").bitwiseAND(col(b).cast("bigint"))


def bit_or(a, b) -> Column:
    return col(a).cast("bigint").bitwiseOR(col(b).cast("bigint"))


def bit_not(a) -> Column:
    return F.bitwise_not(col(a).cast("bigint"))


def _shift(a: Column, n: Column, left: bool) -> Column:
    kept = F.when(n < 63, n).when(n >= 63, 63).cast("int")  # NULL for NULL
    if left:
        return F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", a, kept))
    return F.when(n >= 64, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(F.call_function("shiftright", a, kept))


def shift_left(a, n) -> Column:
    """A negative count shifts the other way; 64 and more leave 0 (or -1 of a negative number to the right)."""
    a, n = col(a).cast("bigint"), col(n).cast("bigint")
    return F.when(a.isNotNull() & n.isNotNull(), F.when(n < 0, _shift(a, -n, False)).otherwise(_shift(a, n, True)))


def shift_right(a, n) -> Column:
    a, n = col(a).cast("bigint"), col(n).cast("bigint")
    return F.when(a.isNotNull() & n.isNotNull(), F.when(n < 0, _shift(a, -n, True)).otherwise(_shift(a, n, False)))


# Text and numbers ----------------------------------------------------------------------------------------------------


def to_number(text) -> Column:
    """The numeric prefix of a text as DOUBLE; 0 without one, NULL for NULL."""
    text = col(text)
    return F.when(text.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).try_cast("double"), F.lit(0.0)))


def to_integer(text) -> Column:
    """The integer prefix of a text as BIGINT; 0 without one, NULL for NULL."""
    text = col(text)
    return F.when(text.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(text, INTEGER, 1), F.lit("")).try_cast("bigint"), F.lit(0)))


def affinity(declared: str) -> str:
    """INTEGER, TEXT, BLOB, REAL or NUMERIC, by what a declared type's name contains, in this order."""
    name = declared.upper()
    if "INT" in name:
        return "INTEGER"
    if any(part in name for part in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if "BLOB" in name or not name.strip():
        return "BLOB"
    if any(part in name for part in ("REAL", "FLOA", "DOUB")):
        return "REAL"
    return "NUMERIC"


SPARK_TYPES = {"INTEGER": "bigint", "TEXT": "string", "BLOB": "binary", "REAL": "double", "NUMERIC": "double"}


def cast_as(value, declared: str, source: str) -> Column:
    """CAST by affinity; source is the Spark type of the value."""
    value, kind = col(value), affinity(declared)
    if kind == "TEXT":
        return value.cast("string")
    if kind == "BLOB":
        return F.encode(value.cast("string"), "UTF-8") if source != "binary" else value
    if source == "string":
        return to_integer(value) if kind == "INTEGER" else to_number(value)
    if source == "binary":
        return cast_as(F.decode(value, "UTF-8"), declared, "string")
    if kind == "INTEGER" and source in ("double", "float"):
        big = float(1 << 63)
        return F.when(value >= big, F.lit((1 << 63) - 1)).when(value <= -big, F.lit(-(1 << 63))).otherwise(F.when((value < big) & (value > -big), value).try_cast("bigint"))
    return value.cast(SPARK_TYPES[kind])


def compare_numeric(text) -> Column:
    """A text compared with a number under NUMERIC affinity: the number if all of it is one, else NULL here."""
    return col(text).try_cast("double")


def is_(a, b) -> Column:
    return col(a).eqNullSafe(col(b))


def is_not(a, b) -> Column:
    return ~col(a).eqNullSafe(col(b))


def ascii_lower(text) -> Column:
    return F.translate(col(text), UPPER, LOWER)


def ascii_upper(text) -> Column:
    return F.translate(col(text), LOWER, UPPER)


def like(text, pattern, escape: str | None = None, case_sensitive: bool = False) -> Column:
    """LIKE without regard to ASCII case. A backslash is an ordinary character unless it is the escape."""
    text = col(text)
    if escape is not None:
        # The escape is found before case is folded; Java's (?i) folds ASCII only.
        regex = F.lit(like_regex(pattern, escape)) if isinstance(pattern, str) else _like_regex(col(pattern), escape)
        return F.rlike(text, regex if case_sensitive else F.concat(F.lit("(?i)"), regex))
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    if not case_sensitive:
        text, pattern = ascii_lower(text), ascii_lower(pattern)
    # Spark's own default escape is the backslash; one that no pattern holds stands in for none.
    return F.like(text, F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("\\"))


def like_regex(pattern: str, escape: str) -> str:
    """A LIKE pattern as an anchored regular expression: the escape makes any character behind it an ordinary one, and
    at the end of the pattern it matches nothing."""
    out, plain = [], False
    for c in pattern:
        if c == escape and not plain:
            plain = True
            continue
        out.append(f"\\Q{c}\\E" if plain or c not in "%_" else ".*" if c == "%" else ".")
        plain = False
    return r"(?s)\A" + "".join(out) + (r"(?!)" if plain else "") + r"\z"


def _like_regex(pattern: Column, escape: str) -> Column:
    """The same of a column of patterns."""

    def step(done: Column, c: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), c, F.lit("\\E"))
        part = F.when(done["plain"], quoted).when(c == "%", ".*").when(c == "_", ".").otherwise(quoted)
        starts = ~done["plain"] & (c == escape)
        return F.struct(F.when(starts, done["out"]).otherwise(F.concat(done["out"], part)).alias("out"), starts.alias("plain"))

    characters = F.regexp_extract_all(pattern, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(r"(?s)\A").alias("out"), F.lit(False).alias("plain"))
    return F.aggregate(characters, start, step, lambda done: F.concat(done["out"], F.when(done["plain"], "(?!)").otherwise(""), F.lit(r"\z")))


def match_(text, pattern) -> Column:
    """MATCH has no meaning outside full-text tables."""
    raise ValueError("unable to use function MATCH in the requested context")


def literal(text: str) -> Column:
    """A number as it stands in a query: decimal, 0x and hexadecimal digits (as 64 bits), or real. An integer beyond
    64 bits is real."""
    if text[:2].lower() == "0x":
        value = int(text, 16)
        if value >= 1 << 64:
            raise ValueError(f"hex literal too big: {text}")
        return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")
    if text.isdigit():
        return F.lit(int(text)).cast("bigint") if int(text) < 1 << 63 else F.lit(float(text))
    return F.lit(float(text))


def compare(a, b, op: str, affinities: tuple[str, str] = ("BLOB", "BLOB"), sources: tuple[str, str] = ("string", "string")) -> Column:
    """A comparison (= == <> != < <= > >=) of columns with declared affinities: a text that meets a numeric column is read as
    a number if all of it is one; otherwise every number is less than every text. sources: the columns' Spark types."""
    numeric = ("INTEGER", "REAL", "NUMERIC")
    sides, texts = [col(a), col(b)], [s == "string" for s in sources]
    order = {"=": lambda x, y: x == y, "==": lambda x, y: x == y, "<>": lambda x, y: x != y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if texts[0] == texts[1]:
        return order(*sides)
    t = texts.index(True)
    if affinities[1 - t] not in numeric:  # a column with TEXT affinity reads the number as text; without, classes differ
        if affinities[t] == "TEXT":
            sides[1 - t] = sides[1 - t].cast("string")
            return order(*sides)
        number = F.lit(None).cast("double")
    else:
        number = compare_numeric(F.when(sides[t].rlike(NUMBER + r"\s*$"), F.btrim(sides[t])))
    as_numbers = [number, sides[1].cast("double")] if t == 0 else [sides[0].cast("double"), number]
    apart = F.when(sides[0].isNotNull() & sides[1].isNotNull(), order(F.lit(1 - t), F.lit(t)))
    return F.when(number.isNotNull(), order(*as_numbers)).otherwise(apart)


def glob_regex(pattern: str) -> str:
    """A GLOB pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            end = pattern.find("]", i + (pattern[i : i + 1] == "]"))
            if end < 0:
                return "(?!)"  # an open set matches nothing
            body = pattern[i:end]
            escaped = "".join("\\" + x if x in "\\[]^&~" else x for x in body)
            out.append(f"[{'^' if negated else ''}{escaped}]" if body else "(?!)")
            i = end + 1
        else:
            out.append("\\" + c if not c.isalnum() and c.isascii() else c)
    return "^" + "".join(out) + r"\z"


def glob(text, pattern: str) -> Column:
    """Case-sensitive; a pattern without wildcards before its last star becomes a prefix test that scans can use."""
    text = col(text)
    head = pattern[:-1]
    if pattern.endswith("*") and not any(c in "*?[" for c in head):
        return text.startswith(head)
    return F.rlike(text, F.lit(glob_regex(pattern)))


def collate(text, name: str) -> Column:
    """A key that compares as the collation does: BINARY, NOCASE (ASCII only) or RTRIM."""
    kind = name.upper()
    if kind == "BINARY":
        return col(text)
    if kind == "NOCASE":
        return ascii_lower(text)
    if kind == "RTRIM":
        return F.rtrim(col(text), F.lit(" "))
    raise ValueError(f"no such collation sequence: {name}")


def real_text(value) -> Column:
    """A DOUBLE as text with up to 15 significant digits, always with a point: 2.0, 1.0e+20, Inf."""
    value = col(value)
    plain = value.cast("string")
    mantissa, power = F.regexp_extract(plain, r"^(-?[0-9.]+)E", 1), F.regexp_extract(plain, r"E(-?[0-9]+)$", 1)
    exponent = power.try_cast("int")
    size = F.lpad(F.abs(exponent).cast("string"), 2, "0")
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.length(size) < 2, size).otherwise(F.greatest(size, F.abs(exponent).cast("string"))))
    positional = F.regexp_replace(F.regexp_replace(F.format_number(value, 17), ",", ""), r"(\.[0-9]+?)0+$", "$1")
    small = (exponent >= 7) & (exponent < 15)
    whole = F.concat(value.cast("decimal(38,1)").cast("string"))
    return F.when(F.isnan(value), F.lit(None).cast("string")).when(value == float("inf"), "Inf").when(value == float("-inf"), "-Inf").when(~plain.contains("E"), plain).when(small, whole).when((exponent < 0) & (exponent >= -4), positional).otherwise(scientific)


# NULLs and choices ---------------------------------------------------------------------------------------------------


def iif(condition: Column, yes, no=None) -> Column:
    return F.when(condition, yes).otherwise(F.lit(None) if no is None else no)


def scalar_min(*values) -> Column:
    """NULL if any value is NULL."""
    return _guarded(F.least(*map(col, values)), values)


def scalar_max(*values) -> Column:
    return _guarded(F.greatest(*map(col, values)), values)


def _guarded(found: Column, values) -> Column:
    present = F.lit(True)
    for v in values:
        present = present & col(v).isNotNull()
    return F.when(present, found)


def type_of(value, source: str) -> Column:
    """integer, real, text, blob or null, from the Spark type of the column."""
    names = {"string": "text", "binary": "blob", "double": "real", "float": "real", "boolean": "integer", "timestamp": "text", "date": "text"}
    name = "real" if source.startswith("decimal") else names.get(source, "integer")
    return F.when(col(value).isNull(), "null").otherwise(name)


def quote(value, source: str) -> Column:
    """An SQL literal of the value."""
    value = col(value)
    if source == "string":
        text = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    elif source == "binary":
        text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
    else:
        text = real_text(value) if source in ("double", "float") else value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


# Hints, blobs, chance and constants ----------------------------------------------------------------------------------

VERSION = "3.53.1"


def likely(value) -> Column:
    """Hints about how often a condition holds; Spark has its statistics, so the value passes as it is."""
    return col(value)


unlikely = likely


def likelihood(value, chance: float) -> Column:
    if not 0.0 <= chance <= 1.0:
        raise ValueError("second argument to likelihood() must be a constant between 0.0 and 1.0")
    return col(value)


def zeroblob(size: int) -> Column:
    return F.unhex(F.lit("00" * max(size, 0)))


def random_integer(seed: int | None = None) -> Column:
    """Any BIGINT, another for each row."""
    draw = lambda: F.floor((F.rand() if seed is None else F.rand(seed)) * (1 << 32)).cast("bigint")
    low = F.floor((F.rand() if seed is None else F.rand(seed + 1)) * (1 << 32)).cast("bigint")
    return F.call_function("shiftleft", draw(), F.lit(32)).bitwiseXOR(low)


def random_blob(size: int, seed: int | None = None) -> Column:
    """Random bytes, at least one."""
    parts = [F.lpad(F.hex(random_integer(None if seed is None else seed + 2 * k)), 16, "0") for k in range(-(-max(size, 1) // 8))]
    return F.unhex(F.substring(F.concat(*parts), 1, 2 * max(size, 1)))


def version() -> Column:
    return F.lit(VERSION)

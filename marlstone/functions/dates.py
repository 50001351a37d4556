"""Date and time functions over time values: ISO texts, Julian day numbers, Unix seconds, timestamps.

A time value is parsed to microseconds since 1970 (a BIGINT column); modifiers are arithmetic on it, so that days
past a month's end roll forward; renderers turn it to text. All in UTC, NULL for what isn't a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, let

DAY = 86_400_000_000
EPOCH_JULIAN = 2440587.5
#: The years 0000 to 9999, in days since 1970.
FIRST_DAY, LAST_DAY = -719528, 2932896
_ISO = r"^(-?[0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]+([0-9]{2}):([0-9]{2})(?::([0-9]{2})(\.[0-9]+)?)?\s*(Z|[+-][0-9]{2}:[0-9]{2})?)?\s*$"
_TIME = r"^([0-9]{2}):([0-9]{2})(?::([0-9]{2})(\.[0-9]+)?)?\s*(Z|[+-][0-9]{2}:[0-9]{2})?\s*$"
_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def days_of(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of the month's first day, plus day - 1: a day past the month's end rolls forward. Months
    outside 1 to 12 carry over to the years."""
    return let(year * 12 + month - 1, _first_day) + day - 1


def _first_day(m: Column) -> Column:
    """Of a month, counted from that of year 0."""
    y, mo = F.floor(m / 12).cast("int"), F.pmod(m, F.lit(12)).cast("int") + 1
    # Days from civil: years begin in March, so leap days are at the end.
    doy = F.floor((153 * F.pmod(mo + 9, F.lit(12)) + 2) / 5).cast("bigint")

    def days(year: Column) -> Column:
        era = F.floor(year / 400).cast("bigint")
        yoe = year - era * 400
        return era * 146097 + yoe * 365 + F.floor(yoe / 4).cast("bigint") - F.floor(yoe / 100).cast("bigint") - 719468

    return let(F.when(mo <= 2, y - 1).otherwise(y), days) + doy


def _zone(mark: Column) -> Column:
    """Minutes to take off for a zone's mark."""
    minutes = F.substring(mark, 2, 2).try_cast("int") * 60 + F.substring(mark, 5, 2).try_cast("int")
    return F.when(mark.isin("", "Z"), 0).otherwise(F.when(F.substring(mark, 1, 1) == "-", -minutes).otherwise(minutes))


def _clock(parts: list[Column]) -> Column:
    """Microseconds of hours, minutes, seconds and a fraction, each a text that may be empty; NULL out of range."""
    h, m, s, f = (F.coalesce(F.nullif(p, F.lit("")).try_cast("double" if i == 3 else "int"), F.lit(0)) for i, p in enumerate(parts))
    fraction = F.floor(f * 1_000_000 + 0.5).cast("bigint")
    return F.when((h <= 23) & (m <= 59) & (s <= 59), (h * 3600 + m * 60 + s).cast("bigint") * 1_000_000 + fraction)


def parse(value, source: str = "string") -> Column:
    """A time value as microseconds since 1970. Numbers are Julian days; 'now' is the current time."""
    value = col(value)
    if source in ("timestamp", "timestamp_ntz"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value.cast("timestamp_ntz"))
    if source == "date":
        return F.datediff(value, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY
    if source != "string":
        return julian(value.cast("double"))
    text = value
    part = [F.regexp_extract(text, _ISO, k) for k in range(1, 9)]
    year, month, day = (p.try_cast("int") for p in part[:3])
    days = F.when(month.between(1, 12) & day.between(1, 31), days_of(year, month, day))
    iso = days * DAY + _clock(part[3:7]) - _zone(part[7]).cast("bigint") * 60_000_000
    clock = [F.regexp_extract(text, _TIME, k) for k in range(1, 6)]
    timed = F.lit(10957 * DAY) + _clock(clock[:4]) - _zone(clock[4]).cast("bigint") * 60_000_000  # 2000-01-01
    return F.when(F.rlike(text, F.lit(_ISO)), iso).when(F.rlike(text, F.lit(_TIME)), timed).when(ascii_now(text), F.unix_micros(F.current_timestamp())).when(F.rlike(text, F.lit(_NUMBER)), julian(F.trim(text).try_cast("double")))


def ascii_now(text: Column) -> Column:
    return F.lower(text) == "now"


def julian(days: Column) -> Column:
    """Microseconds of a Julian day, to the millisecond; NULL outside the years 0 to 9999."""
    milli = F.floor((days - EPOCH_JULIAN) * 86_400_000 + 0.5).cast("bigint")
    return F.when((days >= 0) & (days < 5373484.5), milli * 1000)


def unix_seconds(seconds: Column) -> Column:
    return F.floor(seconds.cast("double") * 1_000_000 + 0.5).cast("bigint")


def _days(at: Column) -> Column:
    return F.floor(at / DAY).cast("int")


def _date(at: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _days(at))


def _clock_of(at: Column) -> Column:
    return at - _days(at).cast("bigint") * DAY


def _add_months(at: Column, months: Column) -> Column:
    return let(_date(at), lambda d: days_of(F.year(d), F.month(d) + months, F.day(d)) * DAY) + _clock_of(at)


_UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": DAY}
_STEP = re.compile(r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*(second|minute|hour|day|month|year)s?$")
_OFFSET = re.compile(r"^([+-])?([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?$")
_SPAN = re.compile(r"^([+-])([0-9]{4})-([0-9]{2})-([0-9]{2})(?:\s+([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?)?$")


def modify(at: Column, modifiers: tuple[str, ...]) -> Column:
    """Apply modifiers in order; one that isn't known makes the value NULL."""
    # With the days by which the last month step ran past a month's end, which floor takes back.
    state = F.struct(at.alias("at"), F.lit(0).alias("over"))
    for raw in modifiers:
        word = raw.strip().lower()
        if word in ("subsec", "subsecond", "utc", "localtime", "auto", "ceiling"):
            continue
        step = _step(word)
        if step is None:
            return F.lit(None).cast("bigint")
        state = let(state, step)
    return state["at"]


def _step(word: str):
    """A modifier as a function of the state; None if it isn't known."""

    def simple(f):
        return lambda s: F.struct(f(s["at"]).cast("bigint").alias("at"), F.lit(0).alias("over"))

    if word == "floor":
        return lambda s: F.struct((s["at"] - s["over"].cast("bigint") * DAY).alias("at"), F.lit(0).alias("over"))
    if word == "start of day":
        return simple(lambda at: _days(at).cast("bigint") * DAY)
    if word in ("start of month", "start of year"):
        return simple(lambda at: let(_date(at), lambda d: days_of(F.year(d), F.month(d) if word.endswith("month") else F.lit(1), F.lit(1)) * DAY))
    if m := re.match(r"^weekday\s+([0-6])(?:\.0*)?$", word):
        # 1970-01-01 was a Thursday (4).
        return simple(lambda at: at + F.pmod(F.lit(int(m[1])) - (_days(at) + 4), F.lit(7)).cast("bigint") * DAY)
    if m := _STEP.match(word):
        number, unit = float(m[1]), m[2]
        if unit in _UNITS:
            return simple(lambda at: at + round(number * _UNITS[unit]))
        whole, size = int(number), 12 if unit == "year" else 1
        rest = round((number - whole) * (365 if size == 12 else 30) * DAY)

        def months(s: Column) -> Column:
            def over(moved: Column) -> Column:
                day, was = F.day(_date(moved)), F.day(_date(s["at"]))
                return F.struct((moved + rest).alias("at"), F.when(day < was, day).otherwise(0).alias("over"))

            return let(_add_months(s["at"], F.lit(whole * size)), over)

        return months
    if m := _SPAN.match(word):
        sign = -1 if m[1] == "-" else 1
        more = sign * (int(m[4]) * DAY + _micros(m[5], m[6], m[7], m[8]))
        return simple(lambda at: _add_months(at, F.lit(sign * (int(m[2]) * 12 + int(m[3])))) + more)
    if m := _OFFSET.match(word):
        return simple(lambda at: at + (-1 if m[1] == "-" else 1) * _micros(m[2], m[3], m[4], m[5]))
    return None


def _micros(h: str | None, m: str | None, s: str | None, f: str | None) -> int:
    return (int(h or 0) * 3600 + int(m or 0) * 60 + int(s or 0)) * 1_000_000 + round(float(f"0.{f or 0}") * 1_000_000)


def moment(value, modifiers: tuple[str, ...] = (), source: str = "string") -> Column:
    """Parse and modify; NULL outside the years 0 to 9999. A first modifier may say how a number is read: unixepoch,
    julianday, or auto (a Julian day if it could be one, else Unix seconds)."""
    first = modifiers[0].strip().lower() if modifiers else ""
    if first in ("unixepoch", "auto", "julianday"):
        number = col(value).try_cast("double")
        as_unix = unix_seconds(number)
        at = as_unix if first == "unixepoch" else julian(number) if first == "julianday" else F.when(number.between(0, 5373484.499999), julian(number)).when(number.isNotNull(), as_unix)
        if first == "auto" and source == "string":
            at = F.coalesce(at, parse(value, source))
        modifiers = modifiers[1:]
    else:
        at = parse(value, source)
    return let(modify(at, modifiers), lambda a: F.when(_days(a).between(FIRST_DAY, LAST_DAY), a))


def _pad(value: Column, size: int, mark: str = "0") -> Column:
    return F.lpad(value.cast("string"), size, mark)


def _fine(modifiers: tuple[str, ...]) -> bool:
    return any(m.strip().lower() in ("subsec", "subsecond") for m in modifiers)


def _ymd(at: Column) -> Column:
    d = _date(at)
    return F.concat(_pad(F.year(d), 4), F.lit("-"), _pad(F.month(d), 2), F.lit("-"), _pad(F.day(d), 2))


def _hms(at: Column, fine: bool) -> Column:
    c = _clock_of(at)
    seconds = F.floor(c / 1_000_000).cast("bigint")
    out = F.concat(_pad(F.floor(seconds / 3600), 2), F.lit(":"), _pad(F.floor(seconds / 60) % 60, 2), F.lit(":"), _pad(seconds % 60, 2))
    return F.concat(out, F.lit("."), _pad(F.floor((c % 1_000_000) / 1000), 3)) if fine else out


def date(value, *modifiers: str, source: str = "string") -> Column:
    return let(moment(value, modifiers, source), _ymd)


def time(value, *modifiers: str, source: str = "string") -> Column:
    return let(moment(value, modifiers, source), lambda at: _hms(at, _fine(modifiers)))


def datetime(value, *modifiers: str, source: str = "string") -> Column:
    return let(moment(value, modifiers, source), lambda at: F.concat(_ymd(at), F.lit(" "), _hms(at, _fine(modifiers))))


def julianday(value, *modifiers: str, source: str = "string") -> Column:
    return moment(value, modifiers, source) / float(DAY) + EPOCH_JULIAN


def unixepoch(value, *modifiers: str, source: str = "string") -> Column:
    at = moment(value, modifiers, source)
    return F.round(at / 1_000_000, 3) if _fine(modifiers) else F.floor(at / 1_000_000).cast("bigint")


def strftime(fmt: str, value, *modifiers: str, source: str = "string") -> Column:
    """Rendered by specifiers; NULL for one that isn't known."""
    return let(moment(value, modifiers, source), lambda at: _rendered(fmt, at))


def _rendered(fmt: str, at: Column) -> Column:
    d, c = _date(at), _clock_of(at)
    seconds = F.floor(c / 1_000_000).cast("bigint")
    hour, minute, second = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    hour12 = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    weekday = F.pmod(_days(at) + 4, F.lit(7))  # Sunday is 0
    monday = F.pmod(_days(at) + 3, F.lit(7))
    yday = F.dayofyear(d) - 1
    thursday = F.date_add(F.date_sub(d, monday), 3)  # of the same ISO week
    parts = {
        "d": lambda: _pad(F.day(d), 2),
        "e": lambda: _pad(F.day(d), 2, " "),
        "f": lambda: F.concat(_pad(second, 2), F.lit("."), _pad(F.floor((c % 1_000_000) / 1000), 3)),
        "F": lambda: _ymd(at),
        "G": lambda: _pad(F.year(thursday), 4),
        "g": lambda: _pad(F.year(thursday) % 100, 2),
        "H": lambda: _pad(hour, 2),
        "I": lambda: _pad(hour12, 2),
        "j": lambda: _pad(yday + 1, 3),
        "J": lambda: (at / float(DAY) + EPOCH_JULIAN).cast("string"),
        "k": lambda: _pad(hour, 2, " "),
        "l": lambda: _pad(hour12, 2, " "),
        "m": lambda: _pad(F.month(d), 2),
        "M": lambda: _pad(minute, 2),
        "p": lambda: F.when(hour >= 12, "PM").otherwise("AM"),
        "P": lambda: F.when(hour >= 12, "pm").otherwise("am"),
        "R": lambda: F.substring(_hms(at, False), 1, 5),
        "s": lambda: F.floor(at / 1_000_000).cast("string"),
        "S": lambda: _pad(second, 2),
        "T": lambda: _hms(at, False),
        "u": lambda: (monday + 1).cast("string"),
        "U": lambda: _pad(F.floor((yday + 7 - weekday) / 7), 2),
        "V": lambda: _pad(F.weekofyear(d), 2),
        "w": lambda: weekday.cast("string"),
        "W": lambda: _pad(F.floor((yday + 7 - monday) / 7), 2),
        "Y": lambda: _pad(F.year(d), 4),
        "%": lambda: F.lit("%"),
    }
    out, i = [F.lit("")], 0
    while i < len(fmt):
        if fmt[i] != "%":
            j = fmt.find("%", i)
            j = len(fmt) if j < 0 else j
            out.append(F.lit(fmt[i:j]))
            i = j
            continue
        kind = fmt[i + 1 : i + 2]
        if kind not in parts:
            return F.lit(None).cast("string")
        out.append(parts[kind]())
        i += 2
    return F.when(at.isNotNull(), F.concat(*out))


def timediff(a, b, source: str = "string") -> Column:
    """What to add to b to get a, as a calendar difference: a sign, years, months, days and a clock."""
    return let(F.struct(moment(a, (), source).alias("x"), moment(b, (), source).alias("y")), _difference)


def _difference(pair: Column) -> Column:
    x, y = pair["x"], pair["y"]
    later, earlier, forward = F.greatest(x, y), F.least(x, y), x >= y
    dl, de = _date(later), _date(earlier)
    months = (F.year(dl) - F.year(de)) * 12 + F.month(dl) - F.month(de)
    # Whole months are counted from the second value: forward if it is the earlier one, else backward.
    fore = let(months, lambda m: m - F.when(_add_months(earlier, m) > later, 1).otherwise(0))
    back = let(months, lambda m: m - F.when(_add_months(later, -m) < earlier, 1).otherwise(0))

    def render(part: Column) -> Column:
        whole, rest = part["whole"], F.greatest(part["rest"], F.lit(0))
        shape = [_pad(F.floor(whole / 12), 4), F.lit("-"), _pad(whole % 12, 2), F.lit("-"), _pad(F.floor(rest / DAY), 2), F.lit(" ")]
        return F.concat(F.when(forward, "+").otherwise("-"), *shape, let(rest % DAY, lambda r: _hms(r, True)))

    def left(whole: Column) -> Column:
        rest = F.when(forward, later - _add_months(earlier, whole)).otherwise(_add_months(later, -whole) - earlier)
        return let(F.struct(whole.alias("whole"), rest.alias("rest")), render)

    return F.when(x.isNotNull() & y.isNotNull(), let(F.when(forward, fore).otherwise(back), left))


def current_date() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd")


def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def current_timestamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")

"""Mathematical functions: DOUBLE results, NULL outside the domain, infinities kept."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col


def real(value) -> Column:
    """A number; a text only if all of it is one."""
    return col(value).try_cast("double")


def _safe(value: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(value), value)


def _unary(f):
    return lambda x: _safe(f(real(x)))


sqrt, exp = _unary(F.sqrt), _unary(F.exp)
sin, cos, tan = _unary(F.sin), _unary(F.cos), _unary(F.tan)
asin, acos, atan = _unary(F.asin), _unary(F.acos), _unary(F.atan)
sinh, cosh, tanh = _unary(F.sinh), _unary(F.cosh), _unary(F.tanh)
asinh, acosh, atanh = _unary(F.asinh), _unary(F.acosh), _unary(F.atanh)
radians, degrees = _unary(F.radians), _unary(F.degrees)


def _positive(f):
    return lambda x: F.when(real(x) > 0, f(real(x)))


ln, log10, log2 = _positive(F.ln), _positive(F.log10), _positive(F.log2)


def log(x, y=None) -> Column:
    """log(x) is to base 10; log(b, x) to base b, NULL unless b > 1 and x > 0."""
    if y is None:
        return log10(x)
    return F.when((real(x) > 1) & (real(y) > 0), F.ln(real(y)) / F.ln(F.when(real(x) > 1, real(x))))


def atan2(y, x) -> Column:
    return _safe(F.atan2(real(y), real(x)))


def power(x, y) -> Column:
    return _safe(F.pow(real(x), real(y)))


def mod(x, y) -> Column:
    """The remainder of reals with the dividend's sign; NULL for a zero divisor."""
    return _safe(F.try_mod(real(x), real(y)))


def pi() -> Column:
    return F.lit(math.pi)


def sign(x) -> Column:
    return F.signum(real(x)).cast("bigint")


def _whole(f):
    """Integers stay integers, reals stay reals."""

    def build(x, source: str = "double") -> Column:
        return col(x).cast("bigint") if source in ("bigint", "int", "smallint", "tinyint") else f(real(x))

    return build


ceil = _whole(lambda x: F.ceil(x).cast("double"))
floor = _whole(lambda x: F.floor(x).cast("double"))
trunc = _whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def round_(x, digits: int = 0) -> Column:
    """Half away from zero, always DOUBLE; digits from 0 to 30."""
    return F.round(real(x), min(max(digits, 0), 30)).cast("double")


def abs_(x) -> Column:
    return F.abs(col(x))

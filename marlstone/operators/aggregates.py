"""Aggregate functions with the dialect's results on NULLs and empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.core import col
from marlstone.functions.jsons import json_quote


def total(x) -> Column:
    """The sum as DOUBLE; 0.0 of nothing."""
    return F.coalesce(F.sum(col(x).cast("double")), F.lit(0.0))


def sum_(x, wide: bool = False) -> Column:
    """NULL of nothing; overflow gives NULL, or a DOUBLE column with ``wide``."""
    return F.sum(col(x).cast("double")) if wide else F.try_sum(col(x))


def filtered(x, condition: Column) -> Column:
    """The argument of an aggregate with FILTER (WHERE condition)."""
    return F.when(condition, col(x))


def group_concat(x, order, separator: str = ",") -> Column:
    """Texts in the given order, NULLs skipped; NULL of nothing. Ordered by value within the group, since rows have
    no order of their own."""
    pairs = F.sort_array(F.collect_list(F.when(col(x).isNotNull(), F.struct(col(order).alias("o"), col(x).cast("string").alias("v")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["v"]), separator))


def json_group_array(x, order, source: str) -> Column:
    """NULLs are kept as null; [] of nothing."""
    pairs = F.sort_array(F.collect_list(F.struct(col(order).alias("o"), json_quote(x, source).alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: p["v"]), ","), F.lit("]"))


def json_group_object(key, x, order, source: str) -> Column:
    """NULL keys are skipped, order and repeated keys kept; {} of nothing."""
    member = F.concat(json_quote(col(key).cast("string")), F.lit(":"), json_quote(x, source))
    pairs = F.sort_array(F.collect_list(F.when(col(key).isNotNull(), F.struct(col(order).alias("o"), member.alias("v")))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["v"]), ","), F.lit("}"))

"""Compound selects: left-associative, all operators of one precedence, columns by place."""

from __future__ import annotations

from pyspark.sql import DataFrame


def compound(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """steps: (operator, arm). The result has the first arm's names; arms of other types meet as texts."""
    out = first
    for operator, arm in steps:
        if len(arm.columns) != len(out.columns):
            raise ValueError(f"SELECTs to the left and right of {operator.upper()} do not have the same number of result columns")
        out, arm = align(out, arm)
        match operator.lower():
            case "union all":
                out = out.union(arm)
            case "union":
                out = out.union(arm).distinct()
            case "intersect":
                out = out.intersect(arm)
            case "except":
                out = out.subtract(arm)
            case "intersect all":
                out = out.intersectAll(arm)
            case "except all":
                out = out.exceptAll(arm)
            case _:
                raise ValueError(f"no such compound operator: {operator}")
    return out


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def align(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the same types by place: the wider number, or text for a number against a text."""
    left, right = [], []
    for (name, x), (other, y) in zip(a.dtypes, b.dtypes, strict=True):
        if x == y or "void" in (x, y):
            kind = x if y == "void" else y
        elif x in _NUMBERS and y in _NUMBERS:
            kind = max(x, y, key=_NUMBERS.index)
        else:
            kind = "string"
        left.append(a[name].cast(kind).alias(name))
        right.append(b[other].cast(kind).alias(name))
    return a.select(left), b.select(right)

"""Joins. The strategy is Spark's to choose from sizes; these helpers only fix meaning: names and NULLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """USING: the shared columns once, coalesced, in front; then the others of both sides."""
    return left.join(right, columns, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """NATURAL: USING all columns of the same name; a cross join if there are none."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def join(left: DataFrame, right: DataFrame, how: str = "inner", on: Column | None = None, columns: list[str] | None = None, is_natural: bool = False) -> DataFrame:
    """A join with its modifiers checked: NATURAL goes with neither ON nor USING, and USING not with ON."""
    if is_natural and (on is not None or columns):
        raise ValueError("a NATURAL join may not have an ON or USING clause")
    if on is not None and columns:
        raise ValueError("cannot have both ON and USING clauses in the same join")
    for c in columns or []:
        if c not in left.columns or c not in right.columns:
            raise ValueError(f"cannot join using column {c} - column not present in both tables")
    if is_natural:
        return natural(left, right, how)
    return using(left, right, columns, how) if columns else left.join(right, on, how) if on is not None else left.crossJoin(right)


def semi(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """NOT EXISTS: rows whose key is NULL stay."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, of: str) -> DataFrame:
    """NOT IN with three-valued logic: nothing passes if the list has a NULL, all pass if it is empty, and a NULL
    passes only an empty list. One small aggregate decides; the rest is an anti join on the key."""
    state = right.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(of).isNull()).alias("__nulls"))
    keyed = left.join(right.select(F.col(of).alias("__of")).distinct(), F.col(column) == F.col("__of"), "left_anti")
    judged = keyed.join(F.broadcast(state))  # one row
    return judged.where((F.col("__nulls") == 0) & ((F.col("__n") == 0) | F.col(column).isNotNull())).drop("__n", "__nulls")


def first_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[Column]) -> DataFrame:
    """A scalar subquery's first row: of the right rows with the same key, the first in the given order. The right side
    is brought to one row a key before it meets the left one, whose rows move once."""
    first = right.groupBy(F.col(right_key).alias("__key")).agg(F.min_by(F.struct(*right.columns), F.struct(*order)).alias("__first"))
    joined = left.join(first, F.col(left_key) == F.col("__key"), "left")
    return joined.select(*left.columns, *[F.col(f"__first.{c}").alias(c) for c in right.columns])

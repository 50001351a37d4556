"""Window frames that Spark lacks, rewritten to those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marlstone.functions.core import col

PRECEDING, FOLLOWING = Window.unboundedPreceding, Window.unboundedFollowing


def spec(partition: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def with_group_rank(df: DataFrame, partition: list[str], order: list, name: str = "__group") -> DataFrame:
    """Peers numbered in order. A GROUPS frame is a RANGE frame over these numbers."""
    return df.withColumn(name, F.dense_rank().over(spec(partition, order)))


def groups(partition: list[str], start: int, end: int, name: str = "__group") -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(name).rangeBetween(start, end)


def sum_excluding_current(x, frame: WindowSpec) -> Column:
    """EXCLUDE CURRENT ROW for a frame that holds the row: what is left of the sum, NULL if nothing is."""
    x = col(x)
    left = F.count(x).over(frame) - x.isNotNull().cast("bigint")
    return F.when(left > 0, F.sum(x).over(frame) - F.coalesce(x, F.lit(0)))


def count_excluding_current(x, frame: WindowSpec) -> Column:
    x = col(x)
    return F.count(x).over(frame) - x.isNotNull().cast("bigint")


def sum_excluding_peers(x, frame: WindowSpec, peers: WindowSpec, ties_only: bool = False) -> Column:
    """EXCLUDE GROUP, or with ``ties_only`` EXCLUDE TIES, for a frame that holds all peers."""
    x = col(x)
    gone = F.coalesce(F.sum(x).over(peers), F.lit(0))
    n = F.count(x).over(frame) - F.count(x).over(peers)
    if ties_only:
        gone, n = gone - F.coalesce(x, F.lit(0)), n + x.isNotNull().cast("bigint")
    return F.when(n > 0, F.coalesce(F.sum(x).over(frame), F.lit(0)) - gone)


def extreme_excluding_current(kind: str, x, partition: list[str], order: list, start: int, end: int) -> Column:
    """min or max over ROWS start..end without the row itself: the frames before and after it. start < 0 < end."""
    x, base = col(x), spec(partition, order)
    pick, one = (F.greatest, F.max) if kind == "max" else (F.least, F.min)
    return pick(one(x).over(base.rowsBetween(start, -1)), one(x).over(base.rowsBetween(1, end)))


def count_distinct_over(x: str, partition: list[str], order: list | None = None) -> Column:
    """count(DISTINCT x) over a partition, or with an order over all rows up to the current peers: each value counts
    where it comes first. No row holds a partition's values."""
    if order is None:
        ranks = F.dense_rank().over(spec(partition, [F.col(x).asc_nulls_last()]))
        return F.coalesce(F.max(F.when(F.col(x).isNotNull(), ranks)).over(Window.partitionBy(*partition)), F.lit(0)).cast("bigint")
    first = F.row_number().over(spec([*partition, x], order)) == 1
    return F.sum(F.when(first & F.col(x).isNotNull(), 1).otherwise(0)).over(spec(partition, order)).cast("bigint")


def json_group_array_over(x, window: WindowSpec, source: str) -> Column:
    """json_group_array(x) OVER: the frame's values in the window's order, NULL as null. Every row holds its frame."""
    from marlstone.functions.jsons import json_quote

    return F.concat(F.lit("["), F.array_join(F.collect_list(json_quote(x, source)).over(window), ","), F.lit("]"))


def json_group_object_over(key, x, window: WindowSpec, source: str) -> Column:
    from marlstone.functions.jsons import json_quote

    member = F.concat(json_quote(key), F.lit(":"), json_quote(x, source))
    return F.concat(F.lit("{"), F.array_join(F.collect_list(member).over(window), ","), F.lit("}"))


def misuse(name: str, over: WindowSpec | None) -> None:
    """A function that only windows have needs one."""
    only = "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value".split()
    if over is None and name in only:
        raise ValueError(f"misuse of window function {name}()")

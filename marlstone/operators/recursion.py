"""Recursive common table expressions as loops over frontiers.

Each round is a table in the shared folder (spark.checkpoint.dir), so plans stay short and a lost executor costs a
reread. UNION keeps only rows that are new; UNION ALL keeps all, and ends when a round is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marlstone.session import staged


def recursive(start: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = False, limit: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """start, then step(frontier) until nothing comes (or, with ``limit``, at least so many rows have)."""
    frontier = staged(start.distinct() if distinct else start, "recursion")
    seen, have = frontier, frontier.count() if limit is not None else 0
    for _ in range(max_rounds):
        fresh = step(frontier).select(*start.columns)
        if distinct:
            fresh = fresh.distinct().subtract(seen)
        frontier = staged(fresh, "recursion")
        n = frontier.count() if limit is not None else frontier.limit(1).count()
        if not n:
            return seen
        seen = seen.union(frontier)
        have += n
        if limit is not None and have >= limit:
            return seen.limit(limit)
    raise RuntimeError(f"the recursion didn't end in {max_rounds} rounds")

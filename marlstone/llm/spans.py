"""Spans of regular expressions as DataFrame expressions.

Spark's functions give matched strings, not their places. A text split at a pattern alternates with the pattern's
matches, both leftmost and non-overlapping, so the places are sums of the lengths of what stands before. Lengths are
code points. Groups that repeat are written possessively in the patterns: Java matches those in a loop, without a
stack frame for each repeat, so that very long matches don't overflow the stack.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running sum appends one by one before it starts a new block.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(numbers: Column) -> Column:
    """Inclusive running sums of an array of ints, in blocks: appending costs a block's length for each element."""
    zero = F.array().cast("array<int>")

    def append(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x))

    def whole(array: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0)), F.lit(BLOCK))
        blocks = F.transform(places, lambda p: F.aggregate(F.slice(array, p + 1, BLOCK), zero, append))

        def shifted(parts: Column) -> Column:
            ends = F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0)))
            before = F.concat(F.array(F.lit(0)), F.aggregate(ends, zero, append))
            return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(p, lambda x: x + b)))

        return let(blocks, shifted)

    return let(numbers, whole)


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of the pattern in a text (not null) as array<struct<start, end, text>>; ends are exclusive and
    text is the given group. Only texts with a match are split."""
    span = "array<struct<start:int,end:int,text:string>>"

    def places(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        lengths = F.transform(hits, lambda h: F.length(h))
        before = F.concat(F.array(F.lit(0)), lengths)
        steps = F.zip_with(gaps, F.slice(before, F.lit(1), F.size(hits)), lambda g, b: F.length(g) + b)
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        ends = F.zip_with(running_sum(steps), lengths, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))
        return F.zip_with(ends, inner, lambda e, t: F.struct(e["start"].alias("start"), e["end"].alias("end"), t.alias("text")))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(span))


def labelled(spans: Column, rank: int, kind: str) -> Column:
    """Spans as array<struct<start, rank, kind, end>>, which sorts by start, then by rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(arrays: Sequence[Column]) -> Column:
    """kind:start:end of all labelled spans, by start, then rank, comma-joined."""
    parts = F.transform(F.array_sort(F.concat(*arrays)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")

"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of all words by its weight, at most ``max_repeats`` times its own size; what it can't take
is shared out again by weight. Documents are interchangeable if they have the same length, so the budget is fitted over
the histogram of exact lengths, each document up to ``max_repeats`` times: every length gives its proportional part, and
the budget that is left is fitted by a bounded-knapsack dynamic program. A length's repeats are dealt evenly to its
documents; which of them take one more is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 20
#: Parts into which the documents of one source and length are dealt, so that no task ranks all of a hot group.
SALTS = 32
#: Words of a source that the dynamic program deals anew.
WINDOW = 1 << 16


def fit_subset(lengths: Sequence[int], counts: Sequence[int], budget: int, over: int = 0) -> list[int]:
    """How many documents of each length (of at most counts[i]) to take, so that their words come as near to the
    budget as the lengths allow; they exceed it by at most ``over``.

    Proportional parts first, then largest first while that fits, then a dynamic program over the attainable sums:
    the shorter documents that were taken are given back up to WINDOW words, which lets it reach the sums that greed
    has missed. A source of up to WINDOW words is fitted as a whole.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if lengths[i] > 0:
            more = min(counts[i] - taken[i], left // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    if left == 0:
        return taken
    window = left
    positive = [i for i in reversed(order) if lengths[i] > 0]
    for i in positive:
        if window >= WINDOW:
            break
        back = min(taken[i], -(-(WINDOW - window) // lengths[i]))
        taken[i] -= back
        window += back * lengths[i]
    items = [(lengths[i], min(counts[i] - taken[i], (window + over) // lengths[i]), i) for i in positive if lengths[i] <= window + over]
    for i, more in _knapsack(items, window, over).items():
        taken[i] += more
    return taken


def _knapsack(items: list[tuple[int, int, int]], budget: int, over: int) -> dict[int, int]:
    """Bounded knapsack over sums up to the budget and ``over``, as bits of an integer: the attainable sum that is
    nearest to the budget (of two the lower one) and how.

    Counts are split into powers of two; the set of sums is kept after each part, to walk back from the best one.
    It stops as soon as the budget itself is attainable.
    """
    full, sums = (1 << (budget + over + 1)) - 1, 1
    before: list[tuple[int, int, int, int]] = []
    for length, count, key in items:
        part = 1
        while count > 0 and not sums >> budget & 1:
            some = min(part, count)
            before.append((sums, length * some, some, key))
            sums |= (sums << (length * some)) & full
            count -= some
            part *= 2
        if sums >> budget & 1:
            break
    above = sums >> budget
    at, out = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1, {}
    if above and (above & -above).bit_length() - 1 < budget - at:
        at = budget + (above & -above).bit_length() - 1
    for earlier, step, some, key in reversed(before):
        if not earlier >> at & 1:
            at -= step
            out[key] = out.get(key, 0) + some
    return out


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources: one row for each source (source, source_size). Adds the target of each.

    Water filling: with ratio r = max_repeats * size / weight ascending, the sources up to some place are capped and
    the rest share what is left by weight; the place is the first whose level doesn't exceed the next ratio. The
    windows run over one row for each source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    named = sources.select("source", "source_size", F.row_number().over(by_name).alias("place"))
    named = named.withColumn("weight", F.get(table, (F.col("place") - 1) % len(weights)))
    named = named.withColumn("cap", F.col("source_size") * float(max_repeats))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "place")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = named.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(rest).alias("open"),
    )
    # The level if this source and all later ones are open; it stands from the first source that it leaves uncapped.
    level = level.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    stands = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place_by", "level"))).over(everything)
    level = level.withColumn("place_by", F.row_number().over(by_ratio)).withColumn("stands", stands)
    target = F.least(F.col("stands.level") * F.col("weight"), F.col("cap"))
    return level.select("source", "source_size", F.coalesce(target, F.col("cap"), F.lit(0.0)).alias("target"))


def _fit(key: tuple, rows: pd.DataFrame, max_repeats: int) -> pd.DataFrame:
    """For one source: rows (size, n) and its target. Of each length: the whole repeats of its documents and how many
    of them take one more. Every document may be taken up to max_repeats times."""
    lengths, n, target = rows["size"].tolist(), rows["n"].to_numpy(), float(rows["target"].iloc[0])
    shortest = min((x for x in lengths if x > 0), default=0)
    taken = fit_subset(lengths, (n * max_repeats).tolist(), min(round(target), max_repeats * int((rows["size"] * n).sum())), shortest)
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "whole": taken // n, "more": taken % n})


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """Each document with its source's size and target and the words that the mix takes of it.

    docs: doc_id, text, source. The result has doc_id, size, source_size, target, taken; taken is a whole number of
    repeats of the document, from 0 to max_repeats. Sources count in the order of their code points, null as the last
    one. A null or empty text has size 0 and is taken 0 times; repeated rows are documents of their own; ties are
    broken by a seeded hash of id and text, so reruns agree; an empty table gives an empty result; other columns
    are not read.
    """
    return _mixed(docs, weights, max_repeats, seed).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def _mixed(docs: DataFrame, weights: Sequence[float], max_repeats: int, seed: int) -> DataFrame:
    """doc_id, text_hash, rank, size, source_size, target, repeats: staged rows without texts."""
    common.ship(docs.sparkSession)
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), common.word_count(F.col("text")).alias("size"), hashed.alias("order"))
    sized = common.staged(sized, "mix-sizes")
    salted = sized.withColumn("salt", F.pmod(F.shiftrightunsigned("order", 17), F.lit(SALTS)))
    parts = salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, max_repeats)
    grouped = lengths.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source_size")
    fitted = grouped.groupBy("source").applyInPandas(lambda key, rows: _fit(key, rows, max_repeats), "source string, size long, whole long, more long")
    fitted = common.staged(fitted, "mix-fit")
    # Where in its source and length each salt begins, and so how many of its documents take one more.
    seen = F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.withColumn("begins", F.coalesce(seen, F.lit(0)))
    plan = begins.alias("b").join(fitted.alias("f"), F.expr("b.source <=> f.source AND b.size = f.size"))
    plan = plan.join(targets.alias("t"), F.expr("b.source <=> t.source"))
    plan = plan.select("b.source", "b.size", "b.salt", "whole", "source_size", "target", F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("begins"))).alias("quota"))
    plan = plan.select([F.col(c).alias(f"p_{c}") for c in plan.columns])
    place = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("order", "doc_id"))
    ranked = salted.withColumn("place", place)
    joined = ranked.join(plan, F.expr("source <=> p_source AND size = p_size AND salt = p_salt"))
    repeats = F.col("p_whole") + F.when(F.col("place") <= F.col("p_quota"), 1).otherwise(0)
    return joined.select("doc_id", "order", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), F.when(F.col("size") > 0, repeats).otherwise(0).alias("repeats"))


def sample(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, with the columns of docs.

    Rows alike in id and text share what the mix takes of them evenly; what is left over goes to the ones whose other
    columns have the least hash (columns with maps don't count). Names of columns never clash: docs is carried whole, as one struct.
    """
    chosen = _mixed(docs, weights, max_repeats, seed).where("repeats > 0")
    chosen = chosen.groupBy(F.col("doc_id").cast("string").alias("of_id"), F.col("order").alias("of_key")).agg(F.sum("repeats").alias("repeats"))
    hashed = [F.col(f"`{c.name}`") for c in docs.schema if "map<" not in c.dataType.simpleString()]
    keyed = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key"), F.xxhash64(*hashed).alias("content"), F.struct("*").alias("row"))
    # Of rows that are alike in everything only the number matters.
    alike = keyed.groupBy("id", "key", "content").agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("id", "key")
    before = F.coalesce(F.sum("n").over(same.orderBy("content").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = alike.select("*", F.sum("n").over(same).alias("m"), before.alias("before")).join(chosen, F.expr("id <=> of_id AND key = of_key"))
    times = F.expr("(repeats DIV m) * n + greatest(0, least(n, repeats % m - before))")
    # One name of one type on both sides, so that the rows are dealt once: by it they are made distinct and joined.
    name = "struct<id:string,key:bigint,content:bigint>"
    times = dealt.select(F.struct("of_id", "of_key", "content").cast(name).alias("name"), times.cast("long").alias("times")).where("times > 0")
    whole = keyed.select(F.struct("id", "key", "content").cast(name).alias("name"), "row")
    joined = whole.dropDuplicates(["name"]).join(times, "name")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))

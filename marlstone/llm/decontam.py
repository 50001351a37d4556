"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (the whole item if it has fewer); a document holds it or not, so
the containment is 1 and the prefix of each window is one shingle: its rarest by the number of windows that hold it
(ties: the lesser hash). Only these prefix shingles are probed, for all lengths in one pass over the documents; in the
same task bounds on place and length drop what can't hold the window, and a hash of the words at its place drops what
doesn't. What is left is compared word by word. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .spans import let

WINDOW, SHINGLE = 10, 5
#: Windows (four numbers each) that are broadcast at once; a larger benchmark is probed in several parts.
BROADCAST_ROWS = 1_000_000
SALTS = 8
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), _GAP, -1), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """The hash of every k consecutive words."""

    def over(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - k)
        found = F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))
        return F.when(F.size(hashes) >= k, found).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def item_windows(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """item (string), words, length of every window of every item."""
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), item_words(F.col(text)).alias("all"))
    length = F.least(F.size("all"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("all") - length)
    cut = F.transform(starts, lambda i: F.slice("all", i + 1, length))
    return items.where(F.size("all") > 0).select("item", F.explode(cut).alias("words")).withColumn("length", F.size("words"))


def _probe(docs: DataFrame, prefix: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """Where documents hold windows by the hash of all their words, with those words; with ``first``, a row without a
    class for every document as well."""
    own = [shingle_hashes(F.col("words"), k) for k in lengths]
    marked = F.concat(F.array(F.lit(None).cast("bigint")), *own)
    exploded = docs.select("row", "key", "words", F.size("words").alias("n_words"), F.posexplode(marked).alias("pos", "hash"))
    met = exploded.join(F.broadcast(prefix.withColumnRenamed("hash", "known")), F.col("hash") == F.col("known"), "left")
    at, before = F.lit(None).cast("int"), F.lit(1)  # the lists of all lengths lie one behind the other
    places = []
    for k in lengths:
        end = before + F.greatest(F.col("n_words") - k + 1, F.lit(0))
        places.append((end, F.col("pos") - before))
        before = end
    for end, place in reversed(places):
        at = F.when(F.col("pos") < end, place).otherwise(at)
    start = at - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    held = F.when(fits, F.slice("words", start + 1, F.col("length")))
    same = F.coalesce(F.col("known").isNotNull() & (F.xxhash64(held) == F.col("class")), F.lit(False))
    kept = met.where((F.col("pos") == 0) | same if first else same)
    return kept.select("row", "key", "n_words", F.when(same, F.col("class")).alias("class"), F.when(same, start).alias("start"), F.when(same, held).alias("held"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Of every document: key, n_words, n_hit (words inside an occurrence of a window), n_items (items with such a
    window), items_sha256 (of their ids as strings, sorted and comma-joined) and contaminated (n_hit > 0).

    A null or empty text has no words and holds nothing; items without words have no window; a null item id is the
    empty string. Repeated documents give a row each; items that repeat under one id count once. Empty tables give
    empty results, or documents without hits. Columns besides the four named are not read. Texts are compared whole.
    """
    windows = common.staged(item_windows(benchmark, item, item_text), "windows")
    classes = windows.select("words", "length").distinct().withColumn("class", F.xxhash64("words"))
    k = F.least(F.col("length"), F.lit(SHINGLE))
    by_length = [F.when(k == n, shingle_hashes(F.col("words"), n)) for n in range(1, SHINGLE + 1)]
    shingles = common.staged(classes.select("class", "length", k.alias("k"), F.posexplode(F.coalesce(*by_length)).alias("offset", "hash")), "window-shingles")

    rarity = shingles.groupBy("hash").agg(F.count_distinct("class").alias("n"))
    rarest = shingles.join(rarity, "hash").groupBy("class", "length", "k").agg(F.min(F.struct("n", "hash", "offset")).alias("r"))
    prefix = common.staged(rarest.select("class", "length", "k", "r.hash", "r.offset"), "window-prefixes")
    counts = {r["k"]: r["n"] for r in prefix.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = sorted(counts.keys() | {SHINGLE}, reverse=True)
    parts = max(1, -(-sum(counts.values()) // BROADCAST_ROWS))

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), item_words(F.col(text)).alias("words"))
    found = None
    for p in range(parts):
        part = prefix.where(F.pmod("class", F.lit(parts)) == p) if parts > 1 else prefix
        probe = _probe(texts, part.drop("k"), lengths, p == 0)
        found = probe if found is None else found.unionByName(probe)
    found = common.staged(found, "benchmark-hits")

    wanted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("class", "salt", F.col("words").alias("wanted"), "length")
    near = found.where(F.col("class").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    held = near.join(wanted, ["class", "salt"]).where(F.col("held") == F.col("wanted"))
    matches = common.staged(held.select("row", "class", "start", (F.col("start") + F.col("length")).alias("end")), "benchmark-matches")

    earlier = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    n_hit = matches.select("row", F.greatest(F.col("end") - reached, F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    owners = windows.select(F.xxhash64("words").alias("class"), "item").distinct()
    of_row = matches.select("row", "class").distinct().join(owners, "class").select("row", "item").distinct()
    items = of_row.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))

    out = found.where("class IS NULL").select("row", "key", "n_words").join(n_hit, "row", "left").join(items, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of the benchmark; rows that share an id are told apart by their texts.
    Names of columns never clash: docs is carried whole, as one struct."""
    named = docs.select(common.row_name("doc_id", "text").alias("name"), "text")
    bad = contamination(named, benchmark, key="name").where("contaminated").select("name").distinct()
    return common.named_rows(docs, "doc_id", "text").join(bad, "name", "left_anti").select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

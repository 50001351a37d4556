"""Quality rules: a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words, word pairs and word endings are hashed to buckets. One multinomial over the buckets is counted from trusted
documents (a bounded sample of labelled rows), one from all documents. A document's score is the mean log ratio of
its n-grams; documents under a fixed threshold fail, as do those that break the base rules. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spans import let

BUCKETS = 1 << 14
#: Trusted rows that the target is counted from, those with the least hashes of their ids.
TRUSTED_ROWS = 20_000
PRIOR = 1.0
THRESHOLD = -0.5
LEAST_WORDS = 50


def _bucket(hashed: Column, buckets: int) -> Column:
    """buckets is a power of two."""
    return hashed.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _ending(word: Column, buckets: int) -> Column:
    return _bucket(F.xxhash64(F.lit(3), F.substring(word, -3, 3)), buckets)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_hashes(hashes: Column) -> Column:
    """Of every word's hash and the following one, which is null at the end."""
    after = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.zip_with(hashes, after, lambda a, b: F.xxhash64(a, b))


def bucket_counts(docs: DataFrame, trusted: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """docs counted by bucket: raw (all) and target (those whose key is in trusted, a bounded set of distinct keys)."""
    worded = docs.select(F.col(key).alias("key"), common.words(F.col(text)).alias("words"))
    marked = worded.join(F.broadcast(trusted.select(F.col(key).alias("trusted"))), F.col("key") == F.col("trusted"), "left")

    hashed = marked.select(F.col("trusted").isNotNull().alias("target"), "words", word_hashes(F.col("words")).alias("hashes"))
    placed = hashed.select("target", "words", "hashes", F.posexplode("hashes").alias("at", "hash"))
    grams = F.array(_bucket(F.col("hash"), buckets), _bucket(F.xxhash64("hash", F.get("hashes", F.col("at") + 1)), buckets), _ending(F.get("words", F.col("at")), buckets))
    exploded = placed.select("target", F.explode(grams).alias("bucket"))
    return exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log(target / raw) of every bucket; all zero without trusted documents.

    The raw counts are brought to the target's total, then both get the same prior: where little has been counted the
    ratio is near 1, however small the corpus.
    """
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():  # one row for each bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    scale = sum(target) / max(sum(raw), 1)
    return [math.log((t + prior) / (n * scale + prior)) if scale else 0.0 for t, n in zip(target, raw, strict=True)]


def score(words: Column, hashes: Column, pairs: Column, ratios: list[float]) -> Column:
    """The mean log ratio of a text's n-grams, from its words, their hashes and those of the pairs; 0 without words."""
    buckets = len(ratios)
    # As one string literal that the optimizer folds to an array.
    table = F.split(F.lit(",".join(f"{x:.5g}" for x in ratios)), ",").cast("array<double>")
    each = F.zip_with(hashes, pairs, lambda a, p: F.get(table, _bucket(a, buckets)) + F.get(table, _bucket(p, buckets)))
    total = F.aggregate(each, F.lit(0.0), lambda done, x: done + x) + F.aggregate(words, F.lit(0.0), lambda done, w: done + F.get(table, _ending(w, buckets)))
    return F.when(F.size(words) > 0, total / (3 * F.size(words))).otherwise(0.0)


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """Words, given by their hashes and those of the pairs, that lie in 3-word windows found twice or more in the text.

    Windows are hashed and sorted with their places; equal neighbours give the places, and places in order give the
    words that they cover. Only texts with a repeated window are sorted.
    """

    def of(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(ordered: Column) -> Column:
            after = F.slice(ordered, F.lit(2), F.size(ordered) - 1)
            both = F.zip_with(ordered, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

        def covered(at: Column) -> Column:
            gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda done, x: done + x)

        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(let(marked, places), covered)).otherwise(0)

    def windows(n: Column) -> Column:
        return F.zip_with(F.slice(pairs, F.lit(1), n), F.slice(hashes, F.lit(3), n), lambda p, c: F.xxhash64(p, c))

    return F.when(F.size(hashes) > 3, let(windows(F.size(hashes) - 2), of)).otherwise(0)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(common.WORD)))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def ratios_of(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """The log ratios for docs, trusting those with quality 1 that aren't toxic."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct()
    trusted = good.orderBy(F.xxhash64(key), key).limit(trusted_rows)
    return log_ratios(bucket_counts(docs, trusted, key, text, buckets), buckets)


def judge(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column ``__quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept.

    Words and their hashes are bound by name inside one expression: wherever the optimizer moves it (a filter goes
    below the projection), they are found once for a row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        measures = [m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        kept = ~failed & (m["score"] >= threshold)
        return F.struct(*measures, failed.alias("base_failed"), m["score"].alias("score"), kept.alias("kept"))

    def measured(words: Column, hashes: Column, pairs: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            repeated_lines(whole).cast("long").alias("n_dup_lines"),
            repeated_words(hashes, pairs).cast("long").alias("n_repeat_words"),
            F.round(score(words, hashes, pairs, ratios), 9).alias("score"),
        )

    found = let(common.words(whole), lambda w: let(word_hashes(w), lambda h: let(pair_hashes(h), lambda p: let(measured(w, h, p), verdict))))
    return docs.withColumn("__quality", found)


def rate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Measures, base rules, score and verdict of every document.

    A null or empty text has no words and fails the base rules. Rows are judged one by one against the corpus, so
    repeated rows give repeated results; equal scores have equal verdicts, and one at the threshold is kept. Without
    trusted labels every score is 0. Empty tables give empty results. Other columns are not read. Texts are read
    whole.
    """
    slim = docs.select(F.col(key).alias(key), F.col(text).alias(text))
    ratios = ratios_of(slim, labels, key, text)
    return judge(slim, ratios, text, threshold).select(key, "__quality.*")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, as they are. Names of columns never clash: docs is carried whole, as one struct."""
    carried = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return judge(carried, ratios_of(docs, labels), "text", threshold).where("__quality.kept").select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document has a 64-bit SimHash of its word shingles. Each bit position gets a non-zero vector of radius + 1 bits,
in turn; for each non-zero vector v of that length there is a mask of the positions whose vector has an odd inner
product with v. Two fingerprints that differ in at most ``radius`` positions agree under one mask at least: the
vectors of those positions span at most ``radius`` dimensions, so some v is orthogonal to them all. No pair within the
radius is lost, whatever the data.

Fingerprints that share a masked value are compared in one bucket. A bucket that is large is dealt out again by the
same construction over the bits that its mask left open; after that few bits are open, so a bucket is small whatever
the data. Buckets give a spanning forest of their links, never all pairs. Components are then found by alternating
star contraction over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a bucket up to which it is compared as it is; beyond, it is dealt out once more.
LARGE = 2048
#: Texts that a Python worker gets at once: with long texts the default number of rows would fill its memory.
TEXT_ROWS = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    begins = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(begins, ends[shingle - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        octets = hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def covering_masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """Masks over the given bit positions (64 by default): any differences in at most ``radius`` of them miss one."""
    positions = list(range(64)) if positions is None else positions
    vectors = (1 << (radius + 1)) - 1
    given = {p: 1 + i % vectors for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in given.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key and fp (a signed 64-bit integer) of every row."""
    common.ship(docs.sparkSession)
    slim = docs.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    return slim.mapInArrow(run, f"key {kind}, fp long")


def bucket_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius, of distinct fingerprints in one bucket (uint64)."""
    left, right = [], []
    todo = np.arange(len(fps))
    while len(todo):
        # Grow one tree, breadth first: rows of a block against all that aren't in a tree yet.
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            block, front = front[:64], front[64:]
            near = np.bitwise_count(fps[block][:, None] ^ fps[todo][None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                new = todo[hit]
                left.append(block[near[:, hit].argmax(axis=0)])
                right.append(new)
                front, todo = np.concatenate([front, new]), todo[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _buckets(frame: DataFrame, names: list[str], radius: int, large: int | None) -> DataFrame:
    """frame: the bucket's key columns and fp, sorted by them within partitions. Links a, b of every bucket; of a
    bucket over ``large``, its fingerprints instead, with b null."""
    schema = ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in names) + ", a long, b long"

    def finish(keys: tuple, fps: np.ndarray) -> pa.RecordBatch | None:
        if len(fps) < 2:
            return None
        if large is not None and len(fps) > large:
            a, b = fps.view(np.int64), np.zeros(len(fps), np.int64)
            rest = pa.nulls(len(fps), pa.int64())
        else:
            i, j = bucket_links(fps, radius)
            if not len(i):
                return None
            a, b = fps[i].view(np.int64), fps[j].view(np.int64)
            rest = pa.array(b)
        return pa.RecordBatch.from_arrays([*[pa.array(np.full(len(a), k)) for k in keys], pa.array(a), rest], names=[*names, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(len(names))]
            fps = batch.column(len(names)).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            change = np.zeros(len(fps) - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            begins = np.concatenate([[0], np.flatnonzero(change) + 1])
            ends = np.concatenate([begins[1:], [len(fps)]])
            for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
                here = tuple(c[lo] for c in columns)
                if here != held:
                    if held is not None and (done := finish(held, np.concatenate(parts))):
                        yield done
                    held, parts = here, []
                parts.append(fps[lo:hi])
        if held is not None and (done := finish(held, np.concatenate(parts))):
            yield done

    return frame.mapInArrow(run, schema)


def near_links(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """distinct: one row for each fingerprint (fp). Links a, b that connect all pairs within the radius."""
    spark = distinct.sparkSession
    common.ship(spark)
    masks = covering_masks(radius)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for t, m in enumerate(masks)])).alias("k"))
    keyed = keyed.select("k.t", "k.part", "fp").repartition("t", "part").sortWithinPartitions("t", "part")
    first = common.staged(_buckets(keyed, ["t", "part"], radius, large), "simhash-buckets")
    links = first.where("b IS NOT NULL").select("a", "b")
    inner = {t: covering_masks(radius, [p for p in range(64) if not m >> p & 1]) for t, m in enumerate(masks)}
    table = F.array(*[F.array(*[F.lit(_signed(x)) for x in inner[t]]) for t in range(len(masks))])
    again = first.where("b IS NULL").select("t", "part", F.col("a").alias("fp"), F.posexplode(F.get(table, F.col("t"))).alias("u", "mask"))
    again = again.select("t", "part", "u", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp")
    again = again.repartition("t", "part", "u", "rest").sortWithinPartitions("t", "part", "u", "rest")
    return links.unionByName(_buckets(again, ["t", "part", "u", "rest"], radius, None).select("a", "b"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition, contracted to a star at the least node of each of its trees."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    if not a:
        return
    nodes, places = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    half = sum(map(len, a))
    left, right, label = places[:half], places[half:], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], names=["a", "b"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: a, b (longs). node and root (the least node of its component) of every node in a link.

    Alternating stars: each node links all its greater neighbours to its least one, then all its lesser ones. Trees
    within a partition are contracted first. Each round is a table in the shared folder; the rounds are logarithmic.
    """
    spark = links.sparkSession
    common.ship(spark)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = F.least(F.min("b"), F.first("a")).alias("m")
        around = both.groupBy("a").agg(least)
        # The neighbours meet their node's least one; AQE splits the join where a node has very many.
        met = both.join(around, "a")
        if large:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(around.select("a", F.col("m").alias("b")).where("a <> b")).distinct()

    edges = common.staged(links.repartition("a").mapInArrow(_forest, "a long, b long"), "components")
    for _ in range(max_rounds):
        # Done when no node has two parents and no parent has a parent.
        parents = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        many = parents.where("n > 1").limit(1).count()
        if not many and not edges.select(F.col("b").alias("a")).join(parents, "a", "left_semi").limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = common.staged(star(star(edges, True), False), "components")
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (the least key that links reach) of every row.

    Fingerprints within the radius are linked. A null or empty text has fingerprint zero, linked like any other;
    repeated rows have the same fingerprint and so the same component; a component whose keys are all null has a
    null id; an empty table gives an empty result; other columns are not read. Very long texts are hashed whole.
    """
    with common.arrow_rows(docs.sparkSession, TEXT_ROWS):
        marked = common.staged(fingerprints(docs, key, text, shingle), "simhash-fingerprints")
    classes = marked.groupBy("fp").agg(F.min("key").alias("least"))
    found = components(near_links(classes.select("fp"), radius))
    # Classes without a link are components of their own.
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = common.staged(rooted, "simhash-classes")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_class = rooted.select("fp", "root").join(named, "root").select("fp", "component")
    out = marked.join(by_class, "fp")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least doc_id (null last, then by the hash of
    the text), as it is. Rows that share an id, or have none, are told apart by their texts; of rows alike in both,
    one stays. Names of columns never clash: docs is carried whole, as one struct."""
    chosen = near_duplicates(docs.select(common.row_name("doc_id", "text").alias("name"), "text"), key="name")
    chosen = chosen.select(F.col("component_id").alias("name")).distinct()
    return common.named_rows(docs, "doc_id", "text").join(chosen, "name", "left_semi").dropDuplicates(["name"]).select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))

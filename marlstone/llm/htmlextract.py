"""Main text of web pages: leaf blocks, labelled by a recurrent network, joined in page order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .blocklabel import Labeller, features, trained
from .htmlblocks import read_blocks

#: An exact check after the labels: a block inside one of these elements is never main text. Elements that may hold a
#: whole page, or parts of an article, such as forms and asides, are left to the network.
NEVER = frozenset("nav footer dialog menu button select option".split())
#: Characters of markup that are labelled together.
BATCH_CHARS = 4 << 20


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page: its blocks labelled as such, one a line; empty if there are none."""
    blocks = [read_blocks(p) for p in pages]
    logits = labeller.logits([features(b) for b in blocks])
    return ["\n".join(b.text for b, x in zip(own, found, strict=True) if x > 0 and not any(e.tag in NEVER for e in b.path)) for own, found in zip(blocks, logits, strict=True)]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """key, url, text and n_chars (code points of text) of every page.

    Null or empty markup has an empty text, as a page without main blocks has. Character references are decoded,
    white space inside a block is one blank, blocks are joined by a line break; nothing else is dropped or cut. Pages
    are read one by one: repeated rows give repeated results, an empty table an empty one; other columns are not
    read. Very long pages are read whole; the network runs over them in pieces.
    """
    spark = pages.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(labeller or trained())  # of the network's fixed size
    slim = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lo = 0
            while lo < len(batch):
                some, size = [], 0
                while lo + len(some) < len(batch) and size < BATCH_CHARS:
                    some.append(batch.column(2)[lo + len(some)].as_py())
                    size += len(some[-1] or "")
                texts = main_texts(some, own)
                rows = batch.slice(lo, len(some))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])
                lo += len(some)

    return slim.mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))

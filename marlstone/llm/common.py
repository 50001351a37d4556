"""What the operators of this subpackage share: word patterns, table readers, staging in the shared folder."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import new_path, shared_dir, ship, staged

__all__ = ["SPACE", "WORD", "arrow_rows", "ascii_lower", "named_rows", "new_path", "row_name", "shared_dir", "ship", "spread", "staged", "table", "word_count", "words"]

#: One run of ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once in what is run inside: long texts would fill their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small table is often one file with one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def row_name(key: str, text: str) -> Column:
    """What tells rows apart whose key is null or repeated: the key (nulls last in order) and the text's hash."""
    return F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"))


def named_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The name and the whole row, as a struct, of every row of docs.

    The name is cast to the type that it has once it was staged, with nullable fields: a join would cast it otherwise,
    and the rows, dealt by the cast, would be dealt again by the name."""
    kind = f"struct<missing:boolean,id:{docs.schema[key].dataType.simpleString()},hash:bigint>"
    return docs.select(row_name(key, text).cast(kind).alias("name"), F.struct("*").alias("row"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}++", -1), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")

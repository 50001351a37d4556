"""Sessions, and how Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])
#: For values of up to some MB: by default a page or row group has 100 rows at least, which writers and readers hold whole.
_BODIES = {"parquet.block.size": 8 << 20} | {f"parquet.{x}.size.row.check.{m}": n for x in ("page", "block") for m, n in (("min", 1), ("max", 32))}


def local_session(threads: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, in UTC."""
    return (
        SparkSession.builder.master(f"local[{threads}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package, whatever folder they are started in. On a cluster of several machines
    the package is shipped as usual (``--py-files``)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what the context was given. Where neither is set, a
    local session gets a temporary one; on a cluster that is an error, as no folder of one machine is shared."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marlstone-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str, bodies: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again: it cuts the lineage, so that a lost executor
    costs a reread, not a recomputation, and a result that is used twice is computed once. bodies: values are long."""
    path = new_path(df.sparkSession, name)
    df.write.options(**(_BODIES if bodies else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the setting is missing and the session is local is a
    temporary folder made for it; on a cluster a machine-local folder would
    lose data with its executor, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    Later reads survive the loss of executors, prune columns and know the
    table's size. The table is removed where a ``scratch`` scope ends, at
    ``release``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    remember(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    """Have a path removed when the driver's Python ends."""
    if not _written:
        atexit.register(release)
    _written.append((spark, path))


@contextmanager
def scratch() -> Iterator[None]:
    """A scope at whose end the tables written in it are removed; use up (write, collect) its DataFrames inside."""
    kept = len(_written)
    try:
        yield
    finally:
        release(kept)


def release(kept: int = 0) -> None:
    """Remove the tables written so far, but for the first ``kept`` ones."""
    while len(_written) > kept:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing more can be done from here
            pass

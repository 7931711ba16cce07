"""Tables written on the way, to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors share.

    Where it is unset a temporary folder stands in, but only on a local master: the executors of a cluster
    would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def together(df: DataFrame, *keys: str | Column) -> DataFrame:
    """`df` with all rows of a key in one task.

    Partitioned by a hash of the keys instead of the keys: Spark drops a repartition by keys that a join below has
    dealt by already, and may then split that join's hot keys over tasks.
    """
    return df.repartition(F.xxhash64(*keys))


def durable(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Cut the lineage of `df` by writing it as a table to the shared folder.

    The table is read back with the written schema, so a lost executor costs no more than reading it again.
    It stays until the folder's owner clears it, like a checkpoint, as results may be read at any time, unless
    it was written inside `written`. A reader holds a batch of up to 4,096 rows of a file at a time: of rows that are large
    themselves let a file have no more than `file_rows`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that durable() writes inside, at the end: for work that stores its results elsewhere, like a micro-batch's."""
    before, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, before
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

"""Keyed tables on disk that take changes: rows lie in buckets of their key's hash, and only buckets that change are written.

A table is a folder of Parquet partitions `bucket=n`. An upsert reads the buckets of its changes, works out
which rows really differ, and replaces just the buckets of those by dynamic partition overwrite. A batch that
runs again finds nothing that differs and writes nothing. One writer at a time, as streams have it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.operators.ledger import latest_by_key
from plumbline.tables import durable, written

#: Buckets of a table; a table's own number is that of its first write and must be given alike at each later one.
BUCKETS = 256


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def stored(folder: str, like: DataFrame) -> DataFrame:
    """The table in `folder` with a column bucket; an empty one with the columns of `like` where there is none yet."""
    spark = like.sparkSession
    schema = StructType([*like.schema.fields, StructField("bucket", IntegerType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def upsert(folder: str, changes: DataFrame, key: str, *order: str, buckets: int = BUCKETS, deleted: str | None = None) -> list[int]:
    """Writes the changes that are newest by `order` over the rows with their keys; returns the buckets that were written.

    A change as old as the stored row or older loses, unless it differs at the same place in the order, where the
    later batch wins. With `deleted`, a boolean column of the changes, the rows of true ones go. At most `buckets` numbers are collected.
    """
    spark = changes.sparkSession
    with written(spark):
        columns = [c for c in changes.columns if c != deleted]
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        new = durable(latest_by_key(changes.select(*columns, gone.alias("__gone")), key, *order).withColumn("bucket", bucket(key, buckets)))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        table = stored(folder, changes.select(*columns))
        old = table.filter(F.col("bucket").isin(touched)) if touched else table.limit(0)
        body = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in columns))
        at = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in order))
        met = new.alias("new").join(old.alias("old"), F.col(f"new.{key}").eqNullSafe(F.col(f"old.{key}")) & (F.col("new.bucket") == F.col("old.bucket")), "left")
        there = F.col("old.bucket").isNotNull()
        differs = F.when(F.col("new.__gone"), there & (at("new") >= at("old"))).otherwise(~there | ((at("new") >= at("old")) & ~body("new").eqNullSafe(body("old"))))
        real = durable(met.filter(differs).select("new.*"))
        changed = sorted(r["bucket"] for r in real.select("bucket").distinct().collect())
        if changed:
            kept = table.filter(F.col("bucket").isin(changed)).alias("old").join(real.alias("new"), F.col(f"new.{key}").eqNullSafe(F.col(f"old.{key}")) & (F.col("new.bucket") == F.col("old.bucket")), "left_anti")
            # written aside first, as the buckets are read and replaced
            whole = durable(kept.select(*columns, "bucket").unionByName(real.filter("not __gone").select(*columns, "bucket")))
            whole.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
            emptied = set(changed) - {r["bucket"] for r in whole.select("bucket").distinct().collect()}
            for number in emptied:  # a bucket without rows is no part of what is written
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={number}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        return changed


def upsert_sink(folder: str, key: str, *order: str, buckets: int = BUCKETS, deleted: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts each micro-batch; one that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(folder, batch, key, *order, buckets=buckets, deleted=deleted)

    return write


def refresh_cache(folder: str, current: DataFrame, embed: Callable[[DataFrame], DataFrame], backbone: str, key: str = "image_id", buckets: int = BUCKETS) -> list[int]:
    """An incremental run of a feature cache: only rows of `current` (key, sha256, ...) whose content is new are embedded, and only their buckets written.

    `embed` takes such rows and gives (key, embedding). The cache holds (key, sha256, backbone, embedding); rows that `current`
    no longer has, and those of another backbone, are deleted. Returns the buckets that were written.
    """
    kind = f"{key} {current.schema[key].dataType.simpleString()}, sha256 string, backbone string, embedding array<double>"
    cache = stored(folder, current.sparkSession.createDataFrame([], kind)).drop("bucket")
    known = cache.filter(F.col("backbone") == backbone).select(key, "sha256")
    stale = current.join(known, [key, "sha256"], "left_anti")
    fresh = embed(stale).join(stale.select(key, "sha256"), key).select(key, "sha256", F.lit(backbone).alias("backbone"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(False).alias("gone"))
    left = cache.join(current.select(key), key, "left_anti").select(key, "sha256", "backbone", "embedding", F.lit(True).alias("gone"))
    return upsert(folder, fresh.unionByName(left), key, key, buckets=buckets, deleted="gone")

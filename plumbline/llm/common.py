"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from plumbline.tables import durable

__all__ = ["durable", "mapped", "small_batches", "table", "text_of", "whole_groups"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def mapped(documents: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str | None = None, kind: DataType | None = None) -> DataFrame:
    """`documents` through an Arrow function that keeps the columns, and may put one named `added` behind them.

    The function sees doc_id and text by name and all others by neutral names, as column names may hold dots, backticks or clash.
    """
    plain = documents.toDF(*(name if name in ("doc_id", "text") else f"column{i}" for i, name in enumerate(documents.columns)))
    schema = StructType([*plain.schema.fields, *([] if added is None else [StructField("added", kind)])])
    return plain.mapInArrow(rows, schema).toDF(*documents.columns, *([] if added is None else [added]))


def small_batches(spark: SparkSession, rows: int = 512, megabytes: int = 8) -> None:
    """Hand texts to Python in batches of few rows and few bytes (a longer text is a batch of its own), which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, enough: int, weight=lambda rows: rows.num_rows) -> Iterator[pa.Table]:
    """Sorted rows in portions that never part rows with equal keys."""
    held: list[pa.RecordBatch] = []
    total = 0
    for rows in batches:
        if not rows.num_rows:
            continue
        held.append(rows)
        total += weight(rows)
        if total >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table[key].to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                total = sum(map(weight, held))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

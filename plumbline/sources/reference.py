"""Reference batteries: embeddings with a manifest of digests that loading checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.profile import digest
from plumbline.operators.validate import guard_vectors


def _digests(rows: DataFrame) -> DataFrame:
    """(rows, dim, source_digest, embedding_digest) of (sample_id, sha256, embedding)."""
    source = digest(rows, "sample_id", "sha256").select(F.col("n").alias("rows"), F.col("digest").alias("source_digest"))
    hashed = rows.select("sample_id", F.xxhash64("embedding").cast("string").alias("h"))
    vectors = digest(hashed, "sample_id", "h").select(F.col("digest").alias("embedding_digest"))
    return source.crossJoin(vectors).crossJoin(rows.agg(F.max(F.size("embedding")).alias("dim")))


def build(rows: DataFrame, folder: str, backbone: str) -> None:
    """Write a reference (sample_id, sha256, embedding) and its one-row manifest."""
    guard_vectors(rows, "sample_id", "embedding")
    rows.write.mode("overwrite").parquet(f"{folder}/embeddings")
    kept = rows.sparkSession.read.parquet(f"{folder}/embeddings")
    named = _digests(kept).withColumn("backbone", F.lit(backbone))
    named.withColumn("reference_id", F.concat(F.lit("ref-"), F.substring(F.sha2(F.concat_ws("|", "source_digest", "embedding_digest", "backbone"), 256), 1, 12))).write.mode("overwrite").parquet(f"{folder}/manifest")


def load(spark: SparkSession, folder: str, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The embeddings and the manifest; raises if they are not what the manifest says, or of another dimension."""
    rows, manifest = spark.read.parquet(f"{folder}/embeddings"), spark.read.parquet(f"{folder}/manifest")
    said, found = manifest.first(), _digests(rows).first()
    wrong = [name for name in ("rows", "dim", "source_digest", "embedding_digest") if said[name] != found[name]]
    if dim is not None and said["dim"] != dim:
        wrong.append("dim")
    if wrong:
        raise ValueError(f"the reference in {folder} differs from its manifest in {', '.join(wrong)}")
    return rows, manifest
